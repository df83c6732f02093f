"""Content fingerprints: of an event stream, and of files."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the record format: big-endian time, sequence, type code, side, price, quantity.
RECORD = struct.Struct(">qqbbqq")
TYPE_CODES = {"ADD": 1, "CANCEL": 2, "TRADE": 3, "RESET": 4, "SNAPSHOT": 5}


def record_hex() -> Column:
    """The event's record in hex; a null side is 0."""
    wide = lambda c: F.lpad(F.hex(F.col(c)), 16, "0")
    code = F.create_map(*[x for k, v in TYPE_CODES.items() for x in (F.lit(k), F.lit(f"{v:02X}"))])[F.col("event_type")]
    side = F.when(F.col("side").isNull(), "00").when(F.col("side") == 1, "01").otherwise("FF")
    return F.concat(wide("timestamp_ns"), wide("sequence_number"), code, side, wide("price_ticks"), wide("quantity"))


def record_bytes(timestamp_ns: int, sequence_number: int, event_type: str, side: int | None, price_ticks: int, quantity: int) -> bytes:
    return RECORD.pack(timestamp_ns, sequence_number, TYPE_CODES[event_type], side or 0, price_ticks, quantity)


def stream_sha256(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: SHA-256 over the records in sequence order, and their count.

    A hash is a fold over the whole stream, so a key is one task; that task streams its sorted rows and holds a batch.
    """
    n = len(keys)

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now, sha, count, done = None, None, 0, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(n)]
            records = batch.column(n).to_pylist()
            for i, r in enumerate(records):
                key = tuple(c[i] for c in cols)
                if key != now:
                    if now is not None:
                        done.append((*now, sha.hexdigest(), count))
                    now, sha, count = key, hashlib.sha256(), 0
                sha.update(bytes.fromhex(r))
                count += 1
        if now is not None:
            done.append((*now, sha.hexdigest(), count))
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, d)) for d in done], pa_schema)

    ordered = events.select(*keys, record_hex().alias("record"), "sequence_number").repartition(*keys).sortWithinPartitions(*keys, "sequence_number").select(*keys, "record")
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*ordered.select(*keys).schema.fields, T.StructField("stream_sha256", T.StringType()), T.StructField("n_events", T.LongType())])
    pa_schema = to_arrow_schema(schema)
    return ordered.mapInArrow(fold, schema)


def file_sha256(path: str, chunk: int = 1 << 20) -> str:
    """SHA-256 of a local file, read in chunks."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def files_sha256(spark, paths: str) -> DataFrame:
    """(path, size_bytes, sha256) of files in any store Spark reads; a file is one task."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))
