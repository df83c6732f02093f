"""Comparison of completed runs: one row a run, after a check that the runs may be compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .artifacts import ArtifactError
from .plots import finite

#: Where a column of the comparison comes from in a run's documents.
SOURCES = {
    "events_processed": ("bigint", "metrics.engineering.events_processed"), "fill_events": ("bigint", "metrics.trading_activity.fill_events"), "fill_rate": ("double", "metrics.trading_activity.fill_rate"),
    "turnover": ("double", "metrics.trading_activity.turnover"), "gross_pnl": ("double", "metrics.pnl.gross_pnl"), "fees": ("double", "metrics.pnl.fees"), "rebates": ("double", "metrics.pnl.rebates"), "net_pnl": ("double", "metrics.pnl.net_pnl"),
    "maximum_drawdown": ("double", "metrics.pnl.maximum_drawdown"), "end_inventory": ("bigint", "metrics.inventory.end_of_session"), "mean_absolute_inventory": ("double", "metrics.inventory.mean_absolute"),
    "time_near_limits_fraction": ("double", "metrics.inventory.time_near_limits_fraction"), "risk_event_count": ("bigint", "metrics.risk.event_count"), "scheduler_events_per_market_event": ("double", "diagnostics.scheduler_events_processed"),
    "realized_spread_ticks": ("double", "metrics.execution_quality.realized_spread_ticks"),
}


def has(schema: T.StructType, path: str) -> bool:
    """Whether a column or nested field is there."""
    kind: T.DataType = schema
    for part in path.split("."):
        if not isinstance(kind, T.StructType) or part not in kind.names:
            return False
        kind = kind[part].dataType
    return True


def _at(runs: DataFrame, path: str):
    return F.col(path) if has(runs.schema, path) else F.lit(None)


def _named(runs: DataFrame, *paths: str, default: str = "unknown"):
    return F.coalesce(*[F.nullif(_at(runs, p).cast("string"), F.lit("")) for p in paths], F.lit(default))


def table(runs: DataFrame) -> DataFrame:
    """The 18 columns of a comparison from runs (folder, metrics, summary, diagnostics, config: structs, any field may be absent), ordered by run_name.

    Numbers that aren't finite and fields that aren't there are null.
    """
    number = lambda kind, path: finite(_at(runs, path)).cast(kind)
    columns = [number(kind, path).alias(name) for name, (kind, path) in SOURCES.items()]
    names = [_named(runs, "summary.run_name", "folder").alias("run_name"), _named(runs, "summary.strategy", "config.strategy.name").alias("strategy"), _named(runs, "summary.symbol", "config.instrument.symbol").alias("symbol")]
    rows = runs.select(*names, *columns)
    ratio = F.when(F.col("events_processed") > 0, F.col("scheduler_events_per_market_event") / F.col("events_processed"))
    return rows.withColumn("scheduler_events_per_market_event", ratio).orderBy("run_name")


def identity(runs: DataFrame) -> DataFrame:
    """field, n_values and n_missing of what runs must share: the stream's SHA-256, symbol, event count and provenance."""
    text = lambda *paths: F.coalesce(*[F.nullif(_at(runs, p).cast("string"), F.lit("")) for p in paths])
    provenance = F.to_json("summary.dataset_provenance") if has(runs.schema, "summary.dataset_provenance") else F.lit(None).cast("string")
    fields = {
        "event_stream_sha256": text("summary.event_stream_sha256", "diagnostics.event_stream_sha256"), "symbol": _named(runs, "summary.symbol", "config.instrument.symbol"),
        "event_count": text("summary.event_count", "metrics.engineering.events_processed"), "dataset_provenance": provenance,
    }
    rows = runs.select(*[c.alias(name) for name, c in fields.items()])
    one = rows.agg(*[F.struct(F.lit(f).alias("field"), F.count_distinct(f).alias("n_values"), F.count_if(F.col(f).isNull()).alias("n_missing")).alias(f) for f in fields])
    return one.select(F.explode(F.array(*fields)).alias("c")).select("c.*")


def compare(runs: DataFrame) -> DataFrame:
    """table(runs), if the runs share stream, symbol, event count and provenance; a single run needs none of it."""
    n = runs.limit(2).count()
    if not n:
        raise ArtifactError("a comparison needs at least one run")
    for r in identity(runs).where("n_values <> 1 or n_missing > 0").orderBy("field").limit(1).collect() if n > 1 else ():
        raise ArtifactError(f"runs that are compared must share {r.field}: {r.n_values} values, missing in {r.n_missing}")
    return table(runs)


def ranked(cases: DataFrame, order: list[str], most: int = 100) -> DataFrame:
    """The first rows of a report's table in order, with n_cases, how many there are in all."""
    total = cases.agg(F.count("*").alias("n_cases"))
    return cases.orderBy(*order).limit(most).crossJoin(F.broadcast(total))  # one row
