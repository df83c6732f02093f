"""Simulated sessions in parallel: one task runs one (case, symbol) at a time.

The loop inside a session can't be split, so cases and symbols are what scale out. A task streams its rows sorted by
case, symbol, time and sequence; a session takes them one by one and lets its rows go as soon as they are final, so that a task
holds neither. Rows of all tables leave in one frame as JSON and are split afterwards, so that a session runs once whatever
tables are asked for; write the frame before splitting it more than once. row_no orders a table, the frame does not.

Where only figures are wanted (figures), no row leaves a session but its last, and a task runs several cases of a symbol beside each
other: they read the same events and replay the book once. There are as many tasks as keep all cores busy.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain, groupby, islice
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .config import Config, from_json
from .kernel import FIGURES, TABLES, Session, Tally, Tape, follows

LONG = "case_name string, symbol bigint, table string, row_no bigint, row string"
FLUSH, MOST_TASKS = 4_000, 20_000
CHUNK, TASKS_PER_CORE = 2_000, 5
SHARED_SYMBOLS = 10_000  # of so many at most, one row each is broadcast


def latency_scaled(config: Config, factor: float) -> Config:
    """All latencies times the factor, rounded half to even."""
    t = config.latency
    return config.with_(latency={f: round(getattr(t, f) * factor) for f in t.__dataclass_fields__})


def fees_scaled(config: Config, factor: str) -> Config:
    from decimal import Decimal

    t = config.fees
    return config.with_(fees={f: str(Decimal(getattr(t, f)) * Decimal(factor)) for f in t.__dataclass_fields__})


#: What an ablation switches off.
ABLATIONS = {"none": {}, "no_inventory": {"inventory_penalty_ticks": 0.0}, "no_imbalance": {"imbalance_coefficient_ticks": 0.0}, "no_volatility": {"volatility_multiplier": 0.0}}


def grid(base: Config, strategies=("fixed_spread",), latencies=(1.0,), allocations=("back_of_queue",), fees=("1",), ablations=("none",)) -> dict[str, Config]:
    """Every combination as a named case."""
    out = {}
    for s in strategies:
        for a in ablations:
            for x in latencies:
                for q in allocations:
                    for f in fees:
                        c = fees_scaled(latency_scaled(base, x), f).with_(quoting={"name": s} | ABLATIONS[a], venue={"cancellation_allocation": q})
                        out["__".join((s, a, f"{x:g}".replace(".", "p").replace("-", "m"), q, f.replace(".", "p")))] = c
    return out


def _symbols(events: DataFrame) -> tuple[DataFrame, int]:
    """Numbered symbols with the times of their first and last event, and how many there are."""
    symbols = events.groupBy("symbol").agg(F.min_by("timestamp_ns", "sequence_number").alias("_start"), F.max_by("timestamp_ns", "sequence_number").alias("_end"))
    n = symbols.count()
    numbered = symbols.withColumn("_s", F.row_number().over(Window.orderBy("symbol")) - 1)  # a row for each symbol
    return F.broadcast(numbered) if n <= SHARED_SYMBOLS else numbered, n


def _dealt(events: DataFrame, numbered: DataFrame, n: int, shares: int) -> DataFrame:
    """Every event once for each of so many shares of the cases (_k); sessions are dealt out one to a partition, so that none waits for another."""
    parts = min(n * shares, MOST_TASKS)
    each = events.join(numbered, "symbol").withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    each = each.withColumn("_p", F.pmod(F.col("_k") * n + F.col("_s"), F.lit(parts)).cast("int"))
    return each.repartitionById(parts, F.col("_p")).sortWithinPartitions("_k", "symbol", "timestamp_ns", "sequence_number").select("_k", "symbol", "_start", "_end", "timestamp_ns", "sequence_number", "event_type", "side", "price_ticks", "quantity")


def _sessions(batches: Iterator) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(share, symbol, start, end) and the events of each session in a task's rows."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    for _, own in groupby(rows, itemgetter(0, 1)):
        first = next(own)
        yield first[:4], (r[4:] for r in chain([first], own))


def run_cases(events: DataFrame, cases: dict[str, Config]) -> DataFrame:
    """LONG rows of every case over every symbol's session (events: symbol and the canonical columns)."""
    names = [x.split()[0] for x in LONG.split(", ")]
    settings = [(k, c.to_json()) for k, c in cases.items()]

    def sessions(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

        def batch_of(part):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds)], names)

        part = []
        for (k, symbol, *span), own in _sessions(batches):
            name, config = settings[k]
            for table, i, r in Session(from_json(config), own, span).stream():
                part.append((name, symbol, table, i, json.dumps(dict(zip(COLUMNS[table], r)))))
                if len(part) >= FLUSH:
                    yield batch_of(part)
                    part = []
        if part:
            yield batch_of(part)

    numbered, n = _symbols(events)
    if not n:
        return events.sparkSession.createDataFrame([], LONG)
    return _dealt(events, numbered, n, len(settings)).mapInArrow(sessions, LONG)


def figures(events: DataFrame, cases: dict[str, Config], near_limit: float = 0.8) -> DataFrame:
    """results() of run_cases() and the last gross_pnl, without the rows between. events are read twice."""
    ddl = f"case_name string, symbol bigint, {FIGURES}"
    numbered, n = _symbols(events)
    if not n:
        return _rates(events.sparkSession.createDataFrame([], ddl).drop("orders", "submitted"))
    each = -(-len(cases) // max(1, -(-TASKS_PER_CORE * events.sparkSession.sparkContext.defaultParallelism // n)))
    shares = -(-len(cases) // each)
    settings = [(k, c.to_json()) for k, c in cases.items()]

    def sessions(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        columns = [c.split() for c in ddl.split(", ")]
        for (k, symbol, *span), own in _sessions(batches):
            tape = Tape(own)
            run = []
            for name, config in settings[k::shares]:
                c = from_json(config)
                run.append((name, Tally(c, (), span, tape if follows(c) else None, near_limit * c.limits.max_abs_inventory)))
            for _, s in run:
                s.begin()
            items = iter(tape)
            while chunk := list(islice(items, CHUNK)):
                plain = [(*x[:6], 0, 0, None, None, None) for x in chunk] if any(s.tape is None for _, s in run) else []
                for _, s in run:
                    s.advance(chunk if s.tape else plain)
            for _, s in run:
                s.finish()
            rows = [(name, symbol, *s.figures()) for name, s in run]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(columns)], [c for c, _ in columns])

    return _rates(_dealt(events, numbered, n, shares).mapInArrow(sessions, ddl).drop("orders", "submitted"))


def _rates(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fill_rate", F.coalesce(F.try_divide("filled", "submitted_orders"), F.lit(0.0))).withColumn("agenda_per_event", F.col("agenda_events") / F.col("market_events"))


COLUMNS = {t: [c.split()[0] for c in ddl.split(", ")] for t, ddl in TABLES.items()}


def table(long: DataFrame, name: str) -> DataFrame:
    """One table of run_cases' rows: case_name, symbol, row_no and its columns."""
    return long.where(F.col("table") == name).select("case_name", "symbol", "row_no", F.from_json("row", TABLES[name]).alias("r")).select("case_name", "symbol", "row_no", "r.*")


def limit_of(cases: dict[str, Config] | None) -> Column:
    """The max_abs_inventory of a row's case."""
    if not cases:
        return F.lit(Config().limits.max_abs_inventory)
    return F.element_at(F.create_map(*[F.lit(x) for k, c in cases.items() for x in (k, c.limits.max_abs_inventory)]), F.col("case_name"))


def results(long: DataFrame, near_limit: float = 0.8, cases: dict[str, Config] | None = None) -> DataFrame:
    """One row per case and symbol: activity, inventory, P&L and drawdown figures. cases: whose limits say what is near."""
    pnl = table(long, "pnl")
    high = F.max("net_pnl").over(Window.partitionBy("case_name", "symbol").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0))
    p = pnl.withColumn("_limit", limit_of(cases)).withColumn("fall", high - F.col("net_pnl")).groupBy("case_name", "symbol").agg(
        F.avg(F.abs("inventory")).alias("mean_abs_inventory"), F.avg((F.abs("inventory") >= near_limit * F.col("_limit")).cast("double")).alias("near_limit_fraction"), F.max("fall").alias("max_drawdown"), F.max_by("net_pnl", "row_no").alias("net_pnl"), F.max_by("inventory", "row_no").alias("final_inventory"), F.max_by("fees", "row_no").alias("fees"), F.max_by("rebates", "row_no").alias("rebates")
    )
    o = table(long, "orders").groupBy("case_name", "symbol").agg(F.count_distinct("order_id").alias("submitted_orders"), F.count_if(F.col("new_status") == "filled").alias("filled"))
    s = table(long, "summary").drop("row_no", "orders", "submitted")
    out = s.join(p, ["case_name", "symbol"]).join(o, ["case_name", "symbol"], "left")
    return _rates(out)
