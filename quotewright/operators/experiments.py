"""Experiment grids, their aggregates, run comparison and plot data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, **dimensions: list) -> DataFrame:
    """One row per combination of the dimensions' values, with a case name; the grid is given by its user and small."""
    cases = spark.range(1).select()
    for name, values in dimensions.items():
        cases = cases.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return cases.withColumn("case_name", F.concat_ws("__", *[F.col(c).cast("string") for c in dimensions]))


def group_mean(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of the non-null values by the key as text, in the key's order."""
    return df.where(F.col(value).isNotNull()).groupBy(F.col(key).cast("string").alias("group_key")).agg(F.avg(value).alias("mean")).orderBy("group_key")


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median, smallest and largest value per group."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.min(value).alias("smallest"), F.max(value).alias("largest"))


def differs(df: DataFrame, by: list[str], policy: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Per group whether two or more policies give different values."""
    g = df.groupBy(*by).agg(F.count_distinct(policy).alias("n_policies"), (F.max(value) - F.min(value)).alias("spread"))
    return g.withColumn("differs", (F.col("n_policies") >= 2) & (F.col("spread") > tolerance))


def identity(runs: DataFrame, fields: list[str]) -> DataFrame:
    """Whether all runs agree in each field and none lacks it."""
    checks = [F.struct(F.lit(f).alias("field"), F.count_distinct(f).alias("n_values"), F.count_if(F.col(f).isNull()).alias("n_null")) for f in fields]
    one = runs.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks)])
    return one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(fields))])).alias("c")).select("c.*").withColumn("same", (F.col("n_values") == 1) & (F.col("n_null") == 0))


def bins(n: int) -> int:
    return min(30, max(5, round(math.sqrt(n))))


def histogram(df: DataFrame, value: Column, n_bins: int) -> DataFrame:
    """Counts in equal bins between the smallest and largest value; the last bin holds the largest."""
    v = df.select(value.cast("double").alias("v")).where("v is not null")
    low, high = v.agg(F.min("v"), F.max("v")).first()
    place = F.lit(0) if low == high else F.least(F.floor((F.col("v") - F.lit(low)) * n_bins / (F.lit(high) - F.lit(low))), F.lit(n_bins - 1))
    binned = v.select(place.cast("bigint").alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))
