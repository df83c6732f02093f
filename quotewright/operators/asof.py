"""As-of joins: the nearest market row at or before, or at or after, a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import carried

#: Nanoseconds in a bucket: a day.
WIDTH = 86_400 * 10**9


def _asof(left: DataFrame, right: DataFrame, keys: list[str], at: Column, payload: list[str], right_first: bool, backward: bool, width: int) -> DataFrame:
    a = left.select(*keys, at.cast("bigint").alias("_t"), F.lit(1 if right_first else 0).alias("_kind"), F.lit(0).cast("bigint").alias("_seq"), F.struct(*[F.col(c) for c in left.columns]).alias("_left"), F.lit(None).cast(right.select(F.struct(*payload)).schema[0].dataType).alias("_right"))
    b = right.select(*keys, F.col("timestamp_ns").alias("_t"), F.lit(0 if right_first else 1).alias("_kind"), F.col("sequence_number").alias("_seq"), F.lit(None).cast(a.schema["_left"].dataType).alias("_left"), F.struct(*payload).alias("_right"))
    found = carried(a.unionByName(b), keys, ["_t", "_kind", "_seq"], F.col("_right"), "_found", "_t", width, backward)
    return found.where(F.col("_left").isNotNull()).select("_left.*", "_found")


def forward_asof(left: DataFrame, right: DataFrame, keys: list[str], at: Column, payload: list[str], width: int = WIDTH) -> DataFrame:
    """left with struct _found: the first right row at or after at; among equal times the earliest. Null where there is none.

    right has timestamp_ns and sequence_number; filter out rows whose payload must not match before.
    """
    return _asof(left, right, keys, at, payload, False, False, width)


def backward_asof(left: DataFrame, right: DataFrame, keys: list[str], at: Column, payload: list[str], width: int = WIDTH) -> DataFrame:
    """left with struct _found: the last right row at or before at; among equal times the latest."""
    return _asof(left, right, keys, at, payload, True, True, width)
