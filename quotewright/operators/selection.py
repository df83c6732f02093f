"""Exact order statistics of large groups, by counts that are refined until the rank is found.

An exact percentile aggregate holds a group's distinct values in one task. Here each round cuts the range that holds a rank
into CELLS cells, counts the values in each (combined before the shuffle), and goes on with the cell that the rank falls in.
Smooth values need two or three rounds. Cells come from the value by monotone arithmetic, so however it rounds, a cell's
values lie below the next cell's, and the result is a value of the table, exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .running import same_keys

CELLS = 1 << 14
#: Targets (groups times percentiles) that may be broadcast, by their count; more are joined by key.
FEW = 10_000


def nearest_ranks(df: DataFrame, keys: list[str], value: str, percentiles: dict[str, float], cells: int = CELLS) -> DataFrame:
    """Per keys a column for each percentile p: ordered[max(0, ceil(p * n) - 1)] of the values that are neither null nor NaN; groups without any are left out."""
    x = F.col("_x")
    rows = df.select(*keys, F.col(value).alias("_x")).where(x.isNotNull() & ~F.isnan(x.cast("double")))
    ends = rows.groupBy(*keys).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_n"))
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(p)).alias("_p")) for i, p in enumerate(percentiles.values())]))
    rank = F.greatest(F.lit(0), F.ceil(F.col("_p") * F.col("_n")) - 1).cast("bigint")
    targets = ends.select(*keys, "_lo", "_hi", "_n", which.alias("_t")).select(*keys, "_t.*", "_lo", "_hi", "_n").where("_n > 0")
    targets = written(targets.withColumn("_rank", rank).drop("_p", "_n"))
    n = targets.count()
    lo, hi = F.col("_lo").cast("double") / 2, F.col("_hi").cast("double") / 2  # halves: the range of the largest values stays finite
    share = F.when(hi > lo, (x.cast("double") / 2 - lo) / F.nullif(hi - lo, F.lit(0.0))).otherwise(0.0)
    inner = F.least(F.lit(cells - 2), 1 + F.floor(share * (cells - 2))).cast("int")
    cell = F.when(x == F.col("_lo"), 0).when(x == F.col("_hi"), cells - 1).otherwise(inner)  # the ends stand alone, so that every round gets on
    below = Window.partitionBy(*keys, "_i").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    found = []
    while True:
        open_ = targets.where("_lo < _hi")
        found.append(targets.where("_lo = _hi").select(*keys, "_i", F.col("_lo").alias("_value")))
        if open_.isEmpty():
            break
        counted = same_keys(rows, open_, keys, n <= FEW).where(x.between(F.col("_lo"), F.col("_hi"))).groupBy(*keys, "_i", "_rank", cell.alias("_cell")).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.count("*").alias("_n"))
        counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(below), F.lit(0))).where("_before <= _rank and _rank < _before + _n")
        targets = written(counted.select(*keys, "_i", "_lo", "_hi", (F.col("_rank") - F.col("_before")).alias("_rank")))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    columns = [F.max(F.when(F.col("_i") == i, F.col("_value"))).alias(name) for i, name in enumerate(percentiles)]
    return every.groupBy(*keys).agg(*columns) if keys else every.agg(*columns)
