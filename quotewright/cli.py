"""Command line: python -m quotewright.cli COMMAND ...; exit code 1 where a command fails."""

from __future__ import annotations

import argparse
import json
import math
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .deploy import ship
from .operators import book, comparison, metrics, plots, validation
from .simulation import sessions
from .simulation.config import Config, from_dict
from .sources import canonical, runs
from .sources.fingerprint import stream_sha256
from .sources.incremental import IncrementalAdapter
from .sources.paired import PairedAdapter
from .sources.synthetic import Settings, synthetic_events


def _session() -> SparkSession:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def _config(path: str | None) -> Config:
    if not path:
        return Config()
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return from_dict(yaml.safe_load(f) or {})
        return from_dict(json.load(f))


def _events(spark: SparkSession, path: str):
    df = spark.read.parquet(path)
    return df if "symbol" in df.columns else df.withColumn("symbol", F.lit(0).cast("bigint"))


def generate(a) -> dict:
    spark = _session()
    e = synthetic_events(spark, Settings(a.events, regime_length=a.regime_length, reset_interval=a.reset_interval), [a.seed + i for i in range(a.symbols)])
    canonical.write_parquet(e, a.output)
    return {r.symbol: r.stream_sha256 for r in stream_sha256(_events(spark, a.output), ["symbol"]).collect()}


def ingest_incremental(a) -> dict:
    spark = _session()
    adapter = IncrementalAdapter(a.tick, a.multiplier)
    b = canonical.read_vendor_csv(spark, a.book, True)
    t = canonical.read_vendor_csv(spark, a.trades, True) if a.trades else None
    canonical.write_parquet(adapter.to_canonical(b, t), a.output)
    return adapter.diagnostics(b, t)


def ingest_paired(a) -> dict:
    spark = _session()
    adapter = PairedAdapter(a.tick, a.date, a.levels, a.timezone)
    out = adapter.to_canonical(canonical.read_vendor_csv(spark, a.messages, False), canonical.read_vendor_csv(spark, a.book, False))
    canonical.write_parquet(out, a.output)
    return {"events": spark.read.parquet(a.output).count()}


def validate(a) -> dict:
    e = _events(_session(), a.input).withColumn("event_index", F.col("sequence_number"))
    v = validation.validate(e, strict=not a.lenient)
    return {"valid": v.valid, "diagnostics": v.diagnostics}


def backtest(a) -> dict:
    spark = _session()
    cases = {a.name: _config(a.config)}
    long = sessions.run_cases(_events(spark, a.input), cases)
    long.write.mode("overwrite").partitionBy("table").parquet(f"{a.output}/{a.name}")
    back = spark.read.parquet(f"{a.output}/{a.name}")
    return {r.symbol: r.asDict() for r in sessions.results(back, cases=cases).collect()}


def experiment(a) -> dict:
    spark = _session()
    cases = sessions.grid(_config(a.config), a.strategies.split(","), [float(x) for x in a.latencies.split(",")], a.policies.split(","), a.fees.split(","))
    r = sessions.results(sessions.run_cases(_events(spark, a.input), cases).persist(), cases=cases)
    canonical.write_parquet(r, a.output)
    return {"cases": len(cases)}


def compare(a) -> dict:
    spark = _session()
    runs = [spark.read.parquet(x) for x in a.runs]
    out = None
    for r in runs:
        s = sessions.results(r)
        out = s if out is None else out.unionByName(s)
    return {f"{r.case_name}/{r.symbol}": {"fills": r.fills, "fill_rate": r.fill_rate, "max_drawdown": r.max_drawdown} for r in out.orderBy("case_name", "symbol").collect()}


def report(a) -> dict:
    """Writes the data sets of a run's plots beside it, and its summary; prints where they are."""
    spark = _session()
    run = runs.load(spark, a.folder)
    t = run.tables
    top = a.output or f"{a.folder.rstrip('/')}/plots"
    one = lambda df, series, y, order: df.select("symbol", F.lit(series).alias("series"), "timestamp_ns", F.col(order).alias("sequence_number"), F.col(y).alias("y"))
    pnl = plots.falls(t["pnl"].where(plots.finite("net_pnl").isNotNull() & F.col("row_no").isNotNull()), "net_pnl", "row_no")
    series = one(t["market"], "midpoint", "midpoint_ticks", "sequence_number").union(one(t["inventory"], "inventory", "inventory", "row_no"))
    series = series.union(one(t["pnl"], "gross_pnl", "gross_pnl", "row_no")).union(one(t["pnl"], "net_pnl", "net_pnl", "row_no")).union(one(pnl, "drawdown", "fall", "row_no"))
    submitted = t["quotes"].where(F.lower(F.coalesce("action", F.lit("submit"))).isin("submit", "replace", "new"))
    marks = lambda df, kind: df.select("symbol", F.lit(kind).alias("kind"), plots.side_name(F.col("side")).alias("side"), "timestamp_ns", "price_ticks").where("side is not null")
    ahead = t["orders"].where("queue_ahead is not null").select("queue_ahead")
    ahead = t["fills"].select("queue_ahead") if ahead.isEmpty() else ahead
    v = lambda df, name, c: df.select(F.lit(name).alias("series"), F.col(c).cast("double").alias("v"))
    made = {
        "series": plots.pixel_columns(series, ["symbol", "series"], columns=a.columns),
        "points": plots.points(marks(submitted, "quote").union(marks(t["fills"], "fill")), ["symbol", "kind", "side"], "timestamp_ns", "price_ticks", a.columns),
        "distributions": plots.distributions(v(t["markouts"], "markout_ticks", "markout_ticks").union(v(ahead, "queue_ahead", "queue_ahead")), ["series"], "v").union(plots.distributions(v(t["inventory"], "inventory", "inventory"), ["series"], "v", plots.whole_bins)),
        "markout_by_horizon": t["markouts"].groupBy("horizon_ns").agg(metrics.finite_mean(F.col("markout_ticks")).alias("mean_markout_ticks")),
        "pnl_by_regime": metrics.pnl_by_regime(t["pnl"], t["market"], "net_pnl"),
        "latency_sensitivity": plots.sensitivity(t["latency_sensitivity"]),
    }
    for name, df in made.items():
        canonical.write_parquet(df, f"{top}/{name}.parquet")
    return {"summary": runs.summary(run).splitlines(), "data": sorted(f"{top}/{name}.parquet" for name in made)}


def compare_runs(a) -> dict:
    """Compares completed runs of one stream; writes the table as Parquet where an output is given."""
    spark = _session()
    out = comparison.compare(runs.documents(spark, a.runs))
    if a.output:
        canonical.write_parquet(out, a.output)
    return {r.run_name: r.asDict() for r in out.collect()}  # a row for each run named on the command line


def benchmark(a) -> dict:
    spark = _session()
    e = synthetic_events(spark, Settings(a.events), [7]).cache()
    e.count()
    taken = []
    for _ in range(a.repeats + 1):
        start = time.perf_counter()
        (sessions.run_cases(e, {"run": Config()}) if a.full else book.market(e)).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return bench_record(a.events, taken[1:])


def bench_record(events: int, seconds: list[float]) -> dict:
    """Timed repeats as a record: all samples, median, and nearest-rank p95 of the time and p05 of the throughput."""
    rank = lambda xs, p: sorted(xs)[max(0, math.ceil(p * len(xs)) - 1)]
    rates = [events / s for s in seconds]
    return {
        "events": events, "repeats": len(seconds), "elapsed_seconds": seconds, "median_seconds": statistics.median(seconds), "p95_seconds": rank(seconds, 0.95),
        "events_per_second": statistics.median(rates), "p05_events_per_second": rank(rates, 0.05),
    }


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quotewright")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, f, *args):
        c = sub.add_parser(name)
        for flags, kw in args:
            c.add_argument(*flags, **kw)
        c.set_defaults(run=f)

    out, inp, conf = (("--output",), {"required": True}), (("--input",), {"required": True}), (("--config",), {})
    num = lambda flag, n: ((flag,), {"type": int, "default": n})
    add("generate-synthetic", generate, out, num("--events", 6000), num("--seed", 7), num("--symbols", 1), num("--regime-length", 500), num("--reset-interval", 1000))
    add("ingest-incremental", ingest_incremental, out, (("--book",), {"required": True}), (("--trades",), {}), (("--tick",), {"required": True}), num("--multiplier", 1))
    add("ingest-paired", ingest_paired, out, (("--messages",), {"required": True}), (("--book",), {"required": True}), (("--tick",), {"required": True}), (("--date",), {"required": True}), ((("--levels"),), {"type": int}), (("--timezone",), {"default": "America/New_York"}))
    add("validate-data", validate, inp, (("--lenient",), {"action": "store_true"}))
    add("backtest", backtest, inp, out, conf, (("--name",), {"default": "run"}))
    add("experiment", experiment, inp, out, conf, (("--strategies",), {"default": "fixed_spread"}), (("--latencies",), {"default": "1"}), (("--policies",), {"default": "back_of_queue"}), (("--fees",), {"default": "1"}))
    add("compare", compare, (("runs",), {"nargs": "+"}))
    add("compare-runs", compare_runs, (("runs",), {"nargs": "+"}), (("--output",), {}))
    add("report", report, (("folder",), {}), (("--output",), {}), num("--columns", 900))
    add("benchmark", benchmark, num("--events", 20_000), num("--repeats", 3), (("--full",), {"action": "store_true"}))
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        print(json.dumps(a.run(a), default=str, sort_keys=True))
    except Exception as e:  # the command line reports and fails
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
