"""Canonical event files: scans with the fixed schema, and sinks."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SchemaError, coerce, violation

#: Texts that stand for a null in CSV files.
NULLS = ("", "null", "NULL", "None")


class LoadError(ValueError):
    """A file of an unknown kind, or one that cannot be read."""


def read_csv(spark: SparkSession, path: str, allow_extra: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """A CSV file with a header; cells are read as text, null tokens become null, casts are exact."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return coerce(raw.select(*[F.when(~F.col(c).isin(*NULLS), F.col(c)).alias(c) for c in raw.columns]), allow_extra, keys)


def read_parquet(spark: SparkSession, path: str, allow_extra: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    return coerce(spark.read.parquet(path), allow_extra, keys)


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """By suffix: .csv, .parquet or .pq, in any case."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return read_csv(spark, path, **options)
    if suffix in (".parquet", ".pq"):
        return read_parquet(spark, path, **options)
    raise LoadError(f"unsupported file type {suffix!r}: {path}")


def load_events(spark: SparkSession, path: str, **options) -> DataFrame:
    """load, after a check of the row contract that raises on the first broken rule."""
    df = load(spark, path, **options)
    bad = df.withColumn("violation", violation()).where("violation is not null").limit(1).collect()
    if bad:
        raise SchemaError(f"{bad[0].violation}: {bad[0]}")
    return df


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_vendor_csv(spark: SparkSession, path: str, header: bool) -> DataFrame:
    """All cells as text, with row: the file order from 0, files in the order of their paths.

    Vendor files may have no key, so lines are numbered: within each split as they are read, plus the lines of all splits
    before it. Splits may be read in any order and by any task.
    """
    raw = spark.read.option("header", header).option("inferSchema", False).csv(path)
    cells = raw.columns
    df = raw.select(*cells, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = df.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))  # a row for each split
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = df.join(F.broadcast(splits.select("_file", "_start", "_first", before.alias("_before"))), ["_file", "_start"])
    return numbered.select(*cells, (F.col("_before") + F.col("_id") - F.col("_first")).cast("bigint").alias("row"))
