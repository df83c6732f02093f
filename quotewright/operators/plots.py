"""Data sets of plots, reduced to what a picture can show.

A series of any length is drawn in so many pixel columns; what it shows in a column is its first, last, lowest and highest
value. One aggregation gives them, combined before the shuffle, so the result has a fixed size a series. Histograms take
their number of bins from the counts and ranges of all values, in the plan, without a pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import BUCKET, running_max, same_keys

COLUMNS = 900


def finite(c: Column | str) -> Column:
    """The value as double, null unless finite."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def pixel_columns(series: DataFrame, keys: list[str], x: str = "timestamp_ns", y: str = "y", order: str = "sequence_number", columns: int = COLUMNS) -> DataFrame:
    """Per keys and column: x0 (the smallest x of the keys), first, last, lowest and highest y and n; rows without finite y are left out.

    order is unique among a key's rows and agrees with x. A step series is drawn from last to first between columns.
    """
    rows = series.select(*keys, F.col(x).cast("bigint").alias("_x"), finite(y).alias("_y"), F.col(order).alias("_o")).where("_x is not null and _y is not null")
    ends = rows.groupBy(*keys).agg(F.min("_x").alias("x0"), F.max("_x").alias("_x1"))
    place = F.floor((F.col("_x") - F.col("x0")).cast("double") / (F.col("_x1") - F.col("x0") + 1).cast("double") * columns).cast("bigint")
    cut = same_keys(rows, ends, keys).withColumn("column", F.least(place, F.lit(columns - 1).cast("bigint")))
    return cut.groupBy(*keys, "x0", "column").agg(F.min_by("_y", "_o").alias("first"), F.max_by("_y", "_o").alias("last"), F.min("_y").alias("lowest"), F.max("_y").alias("highest"), F.count("*").alias("n"))


def falls(pnl: DataFrame, value: str, order: str, width: int = BUCKET) -> DataFrame:
    """pnl with fall: how far value is below its running high, by the unique integer order, per symbol."""
    return running_max(pnl, ["symbol"], [order], finite(value), "_high", order, width).withColumn("fall", F.col("_high") - finite(value)).drop("_high")


def points(rows: DataFrame, keys: list[str], x: str, y: str, columns: int = COLUMNS) -> DataFrame:
    """Markers: per keys, pixel column and y how many rows there are. Equal prices in a column are one marker."""
    p = rows.select(*keys, F.col(x).cast("bigint").alias("_x"), finite(y).alias("y")).where("_x is not null and y is not null")
    ends = p.groupBy(*keys).agg(F.min("_x").alias("x0"), F.max("_x").alias("_x1"))
    place = F.floor((F.col("_x") - F.col("x0")).cast("double") / (F.col("_x1") - F.col("x0") + 1).cast("double") * columns).cast("bigint")
    return same_keys(p, ends, keys).groupBy(*keys, "x0", F.least(place, F.lit(columns - 1).cast("bigint")).alias("column"), "y").agg(F.count("*").alias("n"))


def side_name(side: Column) -> Column:
    """bid or ask, for 1, -1 and the names in either case; null otherwise."""
    text = F.upper(side.cast("string"))
    return F.when(text.isin("1", "BID"), "bid").when(text.isin("-1", "ASK"), "ask")


#: Numbers of bins: by the count of values, and by the range of whole numbers.
def root_bins(n: Column, low: Column, high: Column) -> Column:
    return F.least(F.lit(30), F.greatest(F.lit(5), F.bround(F.sqrt(n), 0))).cast("bigint")


def whole_bins(n: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(40), F.ceil(high) - F.floor(low) + 1)).cast("bigint")


def distributions(rows: DataFrame, keys: list[str], value: str, bins=root_bins) -> DataFrame:
    """Per keys and bin: its edges and n. Bins are equal from the smallest to the largest value, which the last one holds; equal values stand in the middle of a range of one."""
    v = rows.select(*keys, finite(value).alias("_v")).where("_v is not null")
    ends = v.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.count("*").alias("_n"))
    flat = F.col("_a") == F.col("_b")
    ends = ends.select(*keys, bins(F.col("_n"), F.col("_a"), F.col("_b")).alias("bins"), F.when(flat, F.col("_a") - 0.5).otherwise(F.col("_a")).alias("low"), F.when(flat, F.col("_b") + 0.5).otherwise(F.col("_b")).alias("high"))
    place = F.least(F.floor((F.col("_v") - F.col("low")) * F.col("bins") / (F.col("high") - F.col("low"))), F.col("bins") - 1).cast("bigint")
    return same_keys(v, ends, keys).groupBy(*keys, "bins", "low", "high", place.alias("bin")).agg(F.count("*").alias("n"))


def sensitivity(table: DataFrame, x: tuple[str, ...] = ("latency_ns", "order_entry_latency_ns", "market_data_latency_ns"), y: tuple[str, ...] = ("mean_absolute_inventory", "fill_rate", "net_pnl", "markout_ticks"), by: tuple[str, ...] = ("strategy", "queue_allocation", "ablation", "fee_multiplier")) -> DataFrame:
    """Lines of a latency sweep: label (the grouping columns there are), latency_us and y, by the first x and y column that the table has."""
    first = lambda names: next((c for c in names if c in table.columns), None)
    a, b = first(x), first(y)
    if a is None or b is None:
        return table.sparkSession.createDataFrame([], "label string, latency_us double, y double")
    groups = [c for c in by if c in table.columns]
    label = F.concat_ws(" · ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in groups]) if groups else F.lit("configured case")
    return table.select(label.alias("label"), (finite(a) / 1000).alias("latency_us"), finite(b).alias("y")).where("latency_us is not null and y is not null")
