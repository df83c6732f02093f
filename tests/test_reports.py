import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quotewright import cli
from quotewright.operators import artifacts, comparison, metrics, plots
from quotewright.sources import runs


def write_run(spark, top, name, metrics_=None, **summary):
    folder = f"{top}/{name}"
    spark.createDataFrame([("1", 10 * i, float(i % 7)) for i in range(30)], "symbol string, timestamp_ns bigint, midpoint_ticks double").withColumn("sequence_number", F.expr("timestamp_ns div 10")).write.parquet(f"{folder}/market_states.parquet")
    spark.createDataFrame([(5, "x", 3), (7, "bid", 4), (9, "-1", 5)], "timestamp_ns int, side string, external_ahead int").withColumn("price_ticks", F.col("timestamp_ns") + 90).write.parquet(f"{folder}/fills.parquet")
    with open(f"{folder}/metrics.json", "w") as f:
        json.dump(metrics_ or {"pnl": {"net_pnl": 1.5, "fees": float("nan")}, "engineering": {"events_processed": 1234567}, "research_disclaimer": "none of it is advice"}, f)
    if summary:
        with open(f"{folder}/summary.json", "w") as f:
            json.dump(summary, f)
    return folder


SHARED = {"symbol": "A", "event_stream_sha256": "s", "dataset_provenance": {"kind": "recorded", "day": 3}}


def test_runs_are_loaded_by_what_is_there(spark, tmp_path):
    folder = write_run(spark, tmp_path, "r1", strategy="fixed")
    run = runs.load(spark, folder)
    assert (run.name, run.strategy, run.symbol) == ("r1", "fixed", "unknown")
    assert run.tables["market"].count() == 30 and run.tables["pnl"].count() == 0
    assert run.tables["pnl"].columns == ["symbol", "timestamp_ns", "row_no", "gross_pnl", "net_pnl"]
    assert [tuple(r) for r in run.tables["fills"].orderBy("timestamp_ns").select("timestamp_ns", "queue_ahead", "symbol").collect()] == [(5, 3.0, "unknown"), (7, 4.0, "unknown"), (9, 5.0, "unknown")]
    text = runs.summary(run)
    assert "Net P&L: 1.5" in text and "Fees: n/a" in text and "Events processed: 1,234,567" in text and text.endswith("none of it is advice") and "End inventory: n/a" in text
    with pytest.raises(runs.RunError, match="no run folder"):
        runs.load(spark, f"{tmp_path}/nothing")
    (tmp_path / "bare").mkdir()
    with pytest.raises(runs.RunError, match="metrics.json"):
        runs.load(spark, f"{tmp_path}/bare")
    (tmp_path / "bare" / "metrics.json").write_text("[1]")
    with pytest.raises(runs.RunError, match="mapping"):
        runs.load(spark, f"{tmp_path}/bare")


def test_columns_resolve_to_the_first_name_and_bad_cells_to_null(spark):
    df = spark.createDataFrame([("7", "x", 1), ("q", "y", 2)], "timestamp_ns string, exchange_fill_timestamp_ns string, queue_ahead int")
    got = runs.resolve(df, runs.TABLES["fills"])
    assert [(r.timestamp_ns, r.queue_ahead, r.side) for r in got.collect()] == [(None, 1.0, None), (None, 2.0, None)]


def test_comparison_checks_identity_first(spark, tmp_path):
    doc = {"pnl": {"net_pnl": 2.0, "rebates": "1.5"}, "engineering": {"events_processed": 10}, "trading_activity": {"fill_events": 3}}
    a = write_run(spark, tmp_path, "b-run", doc, strategy="x", **SHARED)
    b = write_run(spark, tmp_path, "a-run", doc, strategy="y", **SHARED)
    rows = comparison.compare(runs.documents(spark, [a, b])).collect()
    assert [r.run_name for r in rows] == ["a-run", "b-run"] and len(rows[0]) == 18
    assert (rows[0].net_pnl, rows[0].rebates, rows[0].fill_events, rows[0].maximum_drawdown, rows[0].scheduler_events_per_market_event) == (2.0, 1.5, 3, None, None)
    for field, change in (("symbol", {"symbol": "B"}), ("event_stream_sha256", {"event_stream_sha256": ""}), ("dataset_provenance", {"dataset_provenance": {"kind": "other"}}), ("event_count", {"event_count": 11})):
        other = write_run(spark, tmp_path, f"c-{field}", doc, **(SHARED | change))
        with pytest.raises(artifacts.ArtifactError, match=field):
            comparison.compare(runs.documents(spark, [a, other]))
    alone = write_run(spark, tmp_path, "alone", doc)
    assert comparison.compare(runs.documents(spark, [alone])).first().strategy == "unknown"
    with pytest.raises(artifacts.ArtifactError, match="at least one"):
        comparison.compare(runs.documents(spark, []))


def test_pixel_columns_hold_what_a_line_shows(spark):
    rnd = random.Random(2)
    rows = [("a", 7 * i + rnd.randint(0, 6), i, rnd.choice([None, float("nan"), rnd.uniform(-5, 5)])) for i in range(200)] + [(None, 5, 0, 1.0), ("c", 1, 0, None), ("a", None, 999, 1.0)]
    got = {(r.k, r.column): (r.first, r.last, r.lowest, r.highest, r.n) for r in plots.pixel_columns(spark.createDataFrame(rows, "k string, t bigint, o bigint, y double"), ["k"], "t", "y", "o", 13).collect()}
    want, xs = {}, {}
    good = [r for r in rows if r[1] is not None and r[3] is not None and r[3] == r[3]]
    for k in ("a", None):
        xs[k] = [r[1] for r in good if r[0] == k]
    for k, x, _, y in good:
        at = math.floor((x - min(xs[k])) / (max(xs[k]) - min(xs[k]) + 1) * 13)
        want.setdefault((k, at), []).append(y)
    assert got == {k: (v[0], v[-1], min(v), max(v), len(v)) for k, v in want.items()}


def test_distributions_choose_their_bins(spark):
    rnd = random.Random(6)
    groups = {"few": [1.0, 2.0, 4.0], "many": [rnd.gauss(0, 3) for _ in range(1500)], "flat": [2.0] * 9}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("few", None), ("few", float("inf"))], "k string, v double")
    for rule, bins in ((plots.root_bins, lambda v: min(30, max(5, round(math.sqrt(len(v)))))), (plots.whole_bins, lambda v: max(1, min(40, math.ceil(max(v)) - math.floor(min(v)) + 1)))):
        got = Counter()
        for r in plots.distributions(df, ["k"], "v", rule).collect():
            assert r.bins == bins(groups[r.k])
            got[r.k, r.bin] += r.n
        want = Counter()
        for k, v in groups.items():
            a, b = (min(v), max(v)) if min(v) < max(v) else (v[0] - 0.5, v[0] + 0.5)
            want.update((k, min(bins(v) - 1, math.floor((x - a) * bins(v) / (b - a)))) for x in v)
        assert got == want


def test_sensitivity_takes_the_columns_there_are(spark):
    df = spark.createDataFrame([("s", 2000, 0.5, None), ("t", 4000, None, 1.0)], "strategy string, market_data_latency_ns bigint, fill_rate double, net_pnl double")
    assert [tuple(r) for r in plots.sensitivity(df).collect()] == [("s", 2.0, 0.5)]
    assert [r.label for r in plots.sensitivity(df.drop("strategy")).collect()] == ["configured case"]
    assert plots.sensitivity(df.drop("market_data_latency_ns")).collect() == []


def test_checks_count_breaches_in_one_pass(spark):
    df = spark.createDataFrame([("a", 5, True), ("a", 5, True), ("", 6, None), (None, None, False)], "run_name string, events_processed bigint, synthetic_demonstration boolean")
    found = {r.check: r.breaches for r in artifacts.breaches(df, "t", artifacts.experiment_checks(5, 3, True)).collect()}
    assert found == {"required columns": 2, "run_name is a name": 2, "run_name is unique": 1, "events_processed is the runs'": 2, "classification is the runs'": 2, "case_count is the number of rows": 1}
    with pytest.raises(artifacts.ArtifactError, match="t: case_count"):
        artifacts.require(artifacts.breaches(df, "t", artifacts.experiment_checks(5, 3, True)))
    good = df.where("run_name = 'a'").limit(1).withColumns({"strategy": F.lit("x"), "queue_allocation": F.lit("front")})
    artifacts.require(artifacts.breaches(good, "t", artifacts.experiment_checks(5, 1, True)))
    assert {r.breaches for r in artifacts.breaches(df.limit(0), "t", [artifacts.Check("u", unique=("run_name",)), artifacts.Check("e", each="events_processed > 0")]).collect()} == {0}
    assert artifacts.manifest_errors({"event_stream_sha256": "x", "event_count": True, "synthetic_demonstration": 1, "case_count": 0}, "y", 1, True) != []
    assert artifacts.manifest_errors({"event_stream_sha256": "y", "event_count": 1, "synthetic_demonstration": True, "case_count": 2}, "y", 1, True) == []


def test_pnl_by_regime_at_equal_times(spark):
    market = spark.createDataFrame([(1, 10, 0, "a"), (1, 10, 1, "b"), (1, 20, 2, None), (1, 30, 3, "a")], "symbol bigint, timestamp_ns bigint, sequence_number bigint, spread_regime string")
    pnl = spark.createDataFrame([(1, 5, 1.0), (1, 10, 7.0), (1, 10, 3.0), (1, 15, None), (1, 15, float("nan")), (1, 25, 4.0), (1, 30, 6.0), (1, 31, 5.0)], "symbol bigint, timestamp_ns bigint, net_pnl double")
    for width in (1, 12, 10**9):
        got = {r.label: (r.pnl_change, r.n) for r in metrics.pnl_by_regime(pnl, market, "net_pnl", ("spread_regime",), width).collect()}
        assert got == {"b": (2.0 + 4.0, 2), "a": (2.0 - 1.0, 2)}


def test_commands_report_and_compare(spark, tmp_path, capsys):
    a = write_run(spark, tmp_path, "one", strategy="x", **SHARED)
    assert cli.main(["report", a, "--columns", "10"]) == 0
    said = json.loads(capsys.readouterr().out)
    assert said["summary"][0] == "Run: one" and len(said["data"]) == 6
    assert {r.series for r in spark.read.parquet(f"{a}/plots/series.parquet").collect()} == {"midpoint"}
    assert {(r.kind, r.side) for r in spark.read.parquet(f"{a}/plots/points.parquet").collect()} == {("fill", "bid"), ("fill", "ask")}
    assert cli.main(["compare-runs", a, write_run(spark, tmp_path, "two", strategy="y", **SHARED), "--output", f"{tmp_path}/out"]) == 0
    assert set(json.loads(capsys.readouterr().out)) == {"one", "two"} and spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert cli.main(["report", f"{tmp_path}/nothing"]) == 1
    record = cli.bench_record(100, [4.0, 1.0, 2.0, 5.0])
    assert (record["median_seconds"], record["p95_seconds"], record["p05_events_per_second"]) == (3.0, 5.0, 20.0)
