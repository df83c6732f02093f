"""Running values over long ordered streams, in two levels.

A window over a whole symbol runs in one task however long the stream is. Here a stream is cut into buckets of its order
column: each bucket is scanned on its own, one row per bucket is scanned once more, and what comes before a bucket is
added to what is inside it. The largest task is a bucket or the list of buckets. Rows are dealt by bucket already when they meet
the list, so that is a merge join: neither side is broadcast, however small it looks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows (of a dense order column) in a bucket.
BUCKET = 1 << 20


def same_keys(rows: DataFrame, few: DataFrame, keys: list[str], hint: bool = False) -> DataFrame:
    """rows joined with few by keys, where null is a key like others; hint: few may be broadcast, as its size was checked."""
    few = few.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    few = F.broadcast(few) if hint else few
    on = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys]
    return rows.join(few, on).drop(*[f"_key_{k}" for k in keys]) if keys else rows.crossJoin(few)


def _bucket(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width)).cast("bigint")


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column], width: int = BUCKET) -> DataFrame:
    """df with a column for each of values: its sum over rows of the same keys up to and including this one, by the unique order column. One pass for all."""
    df = df.withColumns({"_b": _bucket(order, width), **{f"_v{i}": v for i, v in enumerate(values.values())}})
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    n = range(len(values))
    totals = df.groupBy(*keys, "_b").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in n])
    totals = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_before{i}") for i in n])
    joined = df.withColumns({f"_v{i}": F.sum(f"_v{i}").over(inside) for i in n}).join(totals.hint("merge"), [*keys, "_b"])
    out = {name: (F.col(f"_v{i}") + F.col(f"_before{i}")).cast("bigint") for i, name in enumerate(values)}
    return joined.withColumns(out).drop("_b", *[f"_v{i}" for i in n], *[f"_before{i}" for i in n])


def running_sum(df: DataFrame, keys: list[str], order: str, value: Column, out: str, width: int = BUCKET) -> DataFrame:
    """df with out: the sum of value over rows of the same keys up to and including this one, by the unique order column."""
    return running_sums(df, keys, order, {out: value}, width)


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str, bucket_by: str, width: int) -> DataFrame:
    """df with out: the row's place from 0 in a total order of its keys' rows that bucket_by leads: rows in buckets before, and the place inside."""
    df = df.withColumn("_b", _bucket(bucket_by, width))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, "_b").agg(F.count("*").alias("_t"))
    counts = counts.select(*keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order)) - 1
    return df.withColumn("_in", inside).join(counts.hint("merge"), [*keys, "_b"]).withColumn(out, (F.col("_in") + F.col("_before")).cast("bigint")).drop("_b", "_in", "_before")


def with_halo(df: DataFrame, at: Column, width: int, reach: int) -> DataFrame:
    """df with _cell (at divided by width) and _halo: rows whose at lies within reach of the next cells stand there once more, as halo.

    A window of reach or less then needs no row of another cell; results are those of rows that aren't halo. at is an integer.
    """
    cell = F.floor(at / F.lit(width)).cast("bigint")
    last = F.floor((at + F.lit(reach)) / F.lit(width)).cast("bigint")
    spread = df.withColumn("_own", cell).withColumn("_cell", F.explode(F.sequence(cell, last)))
    return spread.withColumn("_halo", F.col("_cell") != F.col("_own")).drop("_own")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket_by: str, width: int = BUCKET) -> DataFrame:
    """df with out: the largest value so far; order is a total order that bucket_by leads."""
    df = df.withColumn("_b", _bucket(bucket_by, width)).withColumn("_v", value)
    totals = df.groupBy(*keys, "_b").agg(F.max("_v").alias("_t"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_b", F.max("_t").over(before).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_in", F.max("_v").over(inside)).join(totals.hint("merge"), [*keys, "_b"]).withColumn(out, F.greatest("_in", "_before")).drop("_b", "_v", "_in", "_before")


def carried(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket_by: str, width: int, backward: bool = True) -> DataFrame:
    """df with out: the nearest non-null value at or before (backward) or at or after this row, in a total order that bucket_by leads."""
    df = df.withColumn("_b", _bucket(bucket_by, width)).withColumn("_v", value)
    rank = F.struct(*[F.col(c) for c in order])
    ends = df.groupBy(*keys, "_b").agg((F.max_by if backward else F.min_by)(F.col("_v"), F.when(F.col("_v").isNotNull(), rank)).alias("_e"))
    buckets = Window.partitionBy(*keys).orderBy(F.col("_b") if backward else F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, "_b", F.last("_e", ignorenulls=True).over(buckets).alias("_far"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*[F.col(c) if backward else F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_near", F.last("_v", ignorenulls=True).over(inside)).join(ends.hint("merge"), [*keys, "_b"]).withColumn(out, F.coalesce("_near", "_far")).drop("_b", "_v", "_near", "_far")


def lagged(df: DataFrame, keys: list[str], order: list[str], value: Column, out: str, bucket_by: str, width: int, ahead: bool = False) -> DataFrame:
    """df with out: value in the row before this one (ahead: after it), in a total order that bucket_by leads; null where there is none."""
    df = df.withColumn("_b", _bucket(bucket_by, width)).withColumn("_v", value)
    ends = df.groupBy(*keys, "_b").agg((F.min_by if ahead else F.max_by)("_v", F.struct(*[F.col(c) for c in order])).alias("_e"))
    ends = ends.select(*keys, "_b", F.lag("_e").over(Window.partitionBy(*keys).orderBy(F.desc("_b") if ahead else F.col("_b"))).alias("_far"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*[F.desc(c) if ahead else F.col(c) for c in order])
    near = df.withColumns({"_near": F.lag("_v").over(inside), "_i": F.row_number().over(inside)})
    return near.join(ends.hint("merge"), [*keys, "_b"]).withColumn(out, F.when(F.col("_i") == 1, F.col("_far")).otherwise(F.col("_near"))).drop("_b", "_v", "_near", "_i", "_far")
