"""Written tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: list[str] = []
_seen: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, removed when the session ends. Where that is unset, in a temporary folder in local mode; elsewhere an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="quotewright-"))
        top = _own[0]
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, **seen: Column) -> DataFrame:
    """df, written once and read back: it is not made again, and a lost executor costs a reread.

    seen: aggregates over all rows, taken on the way; observed(df) has them for the frame that is returned.
    """
    path = shared_path(df.sparkSession, "table")
    notes = Observation() if seen else None
    (df.observe(notes, *[c.alias(name) for name, c in seen.items()]) if seen else df).write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if seen:
        _seen[back] = notes.get
    return back


def observed(df: DataFrame) -> dict | None:
    """What written() saw of exactly this frame."""
    return _seen.get(df)
