"""Completed runs on disk: documents and tables, some optional, under one of several names, with columns under one of several names.

Which file and which column is meant is settled on schemas, before anything is planned. What is absent becomes a typed empty
frame or a typed null, so that reports are written once, for whole runs.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import shared_path


class RunError(ValueError):
    """A run folder that can't be read."""


@dataclass(frozen=True)
class Table:
    """files: names, the first that exists is read. columns: type and names of each column. rest: further columns of the file stay."""

    files: tuple[str, ...]
    columns: dict[str, tuple[str, tuple[str, ...]]]
    rest: bool = False


def _own(**kinds: str) -> dict:
    return {name: (kind, (name,)) for name, kind in kinds.items()}


_AHEAD = {"queue_ahead": ("double", ("queue_ahead_estimate", "queue_ahead", "external_ahead"))}
_FILLED = {"timestamp_ns": ("bigint", ("exchange_fill_timestamp_ns", "timestamp_ns"))}
TABLES = {
    "orders": Table(("orders.parquet",), _own(symbol="string", order_id="string", timestamp_ns="bigint") | _AHEAD, True),
    "fills": Table(("fills.parquet",), _own(symbol="string", side="string", price_ticks="double", quantity="bigint") | _FILLED | _AHEAD),
    "inventory": Table(("inventory.parquet",), _own(symbol="string", timestamp_ns="bigint", row_no="bigint", inventory="double")),
    "pnl": Table(("pnl.parquet",), _own(symbol="string", timestamp_ns="bigint", row_no="bigint", gross_pnl="double", net_pnl="double")),
    "quotes": Table(("quotes.parquet", "quote_messages.parquet"), _own(symbol="string", timestamp_ns="bigint", price_ticks="double", side="string", action="string")),
    "risk_events": Table(("risk_events.parquet",), _own(symbol="string", timestamp_ns="bigint"), True),
    "market": Table(("market.parquet", "market_states.parquet"), _own(symbol="string", timestamp_ns="bigint", sequence_number="bigint", midpoint_ticks="double", spread_regime="string", liquidity_regime="string", volatility_regime="string")),
    "markouts": Table(("markouts.parquet",), _own(symbol="string", horizon_ns="bigint", markout_ticks="double")),
    "latency_sensitivity": Table(("latency_sensitivity.parquet",), {}, True),
}
DOCUMENTS = {"metrics": "metrics.json", "summary": "summary.json", "diagnostics": "diagnostics.json", "config": "run_config.yaml"}


def resolve(df: DataFrame, table: Table) -> DataFrame:
    """df with table's columns under their own names and types: each from the first name that df has, else null; a cell that can't be cast is null."""
    made = []
    for name, (kind, names) in table.columns.items():
        found = next((c for c in names if c in df.columns), None)
        made.append((F.col(f"`{found}`").try_cast(kind) if found else F.lit(None).cast(kind)).alias(name))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in table.columns] if table.rest else []
    return df.select(*made, *rest)


def empty(spark: SparkSession, table: Table) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, (kind, _) in table.columns.items()]))


def _path(spark: SparkSession, *parts: str):
    where = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, *parts: str) -> bool:
    where, fs = _path(spark, *parts)
    return fs.exists(where)


@dataclass(frozen=True)
class Run:
    folder: str
    tables: dict[str, DataFrame]
    metrics: dict = field(default_factory=dict)
    summary: dict = field(default_factory=dict)
    diagnostics: dict = field(default_factory=dict)
    config: dict = field(default_factory=dict)

    def _of(self, key: str, section: str, name: str) -> str:
        if self.summary.get(key) not in (None, ""):
            return str(self.summary[key])
        part = self.config.get(section)
        return str(part[name]) if isinstance(part, dict) and part.get(name) not in (None, "") else "unknown"

    @property
    def name(self) -> str:
        given = self.summary.get("run_name")
        return str(given) if given not in (None, "") else self.folder.rstrip("/").rsplit("/", 1)[-1]

    @property
    def strategy(self) -> str:
        return self._of("strategy", "strategy", "name")

    @property
    def symbol(self) -> str:
        return self._of("symbol", "instrument", "symbol")


def document(spark: SparkSession, folder: str, name: str, required: bool = False) -> dict:
    """A document of a run, a mapping; an absent one is empty unless it is required."""
    if not exists(spark, folder, name):
        if required:
            raise RunError(f"{folder} has no {name}")
        return {}
    text = spark.read.option("wholetext", True).text(f"{folder.rstrip('/')}/{name}").first()
    text = text[0] if text else ""
    try:
        if name.endswith(".json"):
            found = json.loads(text)
        else:
            import yaml

            found = yaml.safe_load(text) or {}
    except ImportError:
        return {}  # no reader of YAML here; what else says strategy and symbol is the summary
    except Exception as e:
        raise RunError(f"{folder}/{name} can't be read: {e}") from e
    if not isinstance(found, dict):
        raise RunError(f"{folder}/{name} must hold a mapping")
    return found


def tables(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The tables of a run: the first of each one's files that exists, with its own columns; a typed empty frame where there is none."""
    found = {}
    for name in names:
        t = TABLES[name]
        file = next((f for f in t.files if exists(spark, folder, f)), None)
        try:
            found[name] = resolve(spark.read.parquet(f"{folder.rstrip('/')}/{file}"), t) if file else empty(spark, t)
        except Exception as e:
            raise RunError(f"{folder}/{file} can't be read: {e}") from e
    return found


def load(spark: SparkSession, folder: str) -> Run:
    """A completed run; only metrics.json must be there."""
    if not exists(spark, folder):
        raise RunError(f"no run folder at {folder}")
    documents = {k: document(spark, folder, name, k == "metrics") for k, name in DOCUMENTS.items()}
    bare = Run(folder, {}, **documents)
    own = lambda df: df.withColumn("symbol", F.coalesce("symbol", F.lit(bare.symbol))) if "symbol" in df.columns else df  # noqa: E731  tables of one instrument need not name it
    return Run(folder, {name: own(df) for name, df in tables(spark, folder).items()}, **documents)


def documents(spark: SparkSession, folders: list[str]) -> DataFrame:
    """folder, metrics, summary, diagnostics and config (structs) of many runs, for comparison; documents are small, one row a run."""
    rows = [json.dumps({"folder": f.rstrip("/").rsplit("/", 1)[-1]} | {k: document(spark, f, name, k == "metrics") for k, name in DOCUMENTS.items()}) for f in folders]
    if not rows:
        return spark.createDataFrame([], "folder string")
    path = shared_path(spark, "documents")
    spark.createDataFrame([(r,) for r in rows], "value string").write.text(path)
    return spark.read.json(path)


#: Lines of a summary: title, section and key of the metrics.
LINES = (
    ("Net P&L", "pnl", "net_pnl"), ("Gross P&L", "pnl", "gross_pnl"), ("Fees", "pnl", "fees"), ("Rebates", "pnl", "rebates"), ("Maximum drawdown", "pnl", "maximum_drawdown"), ("Fill events", "trading_activity", "fill_events"),
    ("Fill rate", "trading_activity", "fill_rate"), ("End inventory", "inventory", "end_of_session"), ("Events processed", "engineering", "events_processed"),
)


def shown(value) -> str:
    if value is None or isinstance(value, float) and not -float("inf") < value < float("inf"):
        return "n/a"
    if isinstance(value, bool):
        return "yes" if value else "no"
    return f"{value:,}" if isinstance(value, int) else f"{value:,.6g}" if isinstance(value, float) else str(value)


def summary(run: Run) -> str:
    """A run in a few lines; what is not known is n/a."""
    nested = lambda s, k: run.metrics[s].get(k) if isinstance(run.metrics.get(s), dict) else None
    lines = [f"Run: {run.name}", f"Strategy: {run.strategy}", f"Instrument: {run.symbol}", *[f"{title}: {shown(nested(s, k))}" for title, s, k in LINES]]
    note = run.metrics.get("research_disclaimer")
    return "\n".join([*lines, "", f"Research disclaimer: {note}"] if note else lines)
