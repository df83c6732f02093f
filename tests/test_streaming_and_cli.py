import json

from pyspark.sql import functions as F

from quotewright import cli
from quotewright.operators import book
from quotewright.sources.synthetic import Settings, synthetic_events
from quotewright.streaming import bars


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    e = synthetic_events(spark, Settings(600, levels=3), [3, 4])
    path = str(tmp_path / "events")
    for lo, hi in ((0, 300), (300, 600)):
        e.where(f"sequence_number >= {lo} and sequence_number < {hi}").coalesce(1).write.mode("append").parquet(path)
    batch = spark.read.parquet(path)
    stream = lambda: bars.event_stream(spark, path, 1)
    want = sorted(map(str, bars.trade_bars(batch, "50 milliseconds").collect()))
    assert sorted(map(str, run(bars.trade_bars(stream(), "50 milliseconds"), "bars", "complete").collect())) == want != []
    b = sorted(map(str, bars.bursts(batch, "2 milliseconds").collect()))
    assert len(b) == 2 and sum(r.events for r in bars.bursts(batch, "2 milliseconds").collect()) == 1200
    got = run(bars.top_of_book(stream()), "tops", "append").select("symbol", "sequence_number", "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity")
    tops = book.bbo(book.with_epochs(batch)).select(*got.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, tops.collect()))


def test_late_rows_are_counted_in_streams_as_in_batches(spark, tmp_path):
    """Files of 40 rows, one a trigger, with rows up to 300 ms behind; bars of 50 ms close 100 ms after their end."""
    import random

    rnd, ms = random.Random(8), 10**6
    rows = [(s, max(0, 5 * i - rnd.choice([0, 0, 3, 60, 99, 100, 300])) * ms, i, rnd.choice(["TRADE", "TRADE", "ADD"]), 1, rnd.randint(90, 110), rnd.randint(1, 9)) for i in range(160) for s in (1, 2)]
    e = spark.createDataFrame(rows, "symbol bigint, timestamp_ns bigint, sequence_number bigint, event_type string, side int, price_ticks bigint, quantity bigint").withColumn("side", F.col("side").cast("tinyint"))
    path = str(tmp_path / "late")
    for lo in range(0, 160, 40):
        e.where(f"sequence_number >= {lo} and sequence_number < {lo + 40}").coalesce(1).write.mode("append").parquet(path)
    want, now, late, open_ = [], {}, {1: 0, 2: 0}, {}
    for s, t, n, kind, _, p, q in sorted(rows, key=lambda r: r[2]):
        if s in now and now[s] - t >= 100 * ms:
            late[s] += 1
            want.append((s, "late", t, n, *[None] * 6, late[s]))
            continue
        now[s] = max(now.get(s, t), t)
        if kind == "TRADE":
            open_.setdefault((s, t - t % (50 * ms)), []).append((p, q))
    for (s, start), b in open_.items():
        if now[s] - (start + 50 * ms) >= 100 * ms:
            ps = [p for p, _ in b]
            want.append((s, "bar", start, start + 50 * ms, ps[0], max(ps), min(ps), ps[-1], sum(q for _, q in b), len(b), None))
    assert late[1] > 5
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bars.counted_bars(spark.read.parquet(path), 50 * ms, 100 * ms).collect())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = run(bars.counted_bars(bars.event_stream(spark, path, 1), 50 * ms, 100 * ms), "late", "append")
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_commands(spark, tmp_path, capsys):
    events, out = str(tmp_path / "e.parquet"), str(tmp_path / "runs")
    say = lambda *argv: (cli.main(list(argv)), capsys.readouterr())
    code, said = say("generate-synthetic", "--output", events)
    assert code == 0 and json.loads(said.out)["0"] == "1e910893059341fc01c740a3ada61ba3dcf0df30a2663150d868d6e12babd0bc"
    assert json.loads(say("validate-data", "--input", events)[1].out)["valid"]
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"latency": {"market_data_ns": 100_000, "order_entry_ns": 150_000, "cancellation_ns": 150_000, "fill_report_ns": 100_000}, "fees": {"maker_rebate_per_unit": "0.0002", "taker_fee_per_unit": "0.0003"}, "limits": {"max_messages_per_second": 500, "prohibit_new_quotes_last_ns": 100_000_000}}))
    code, said = say("backtest", "--input", events, "--output", out, "--config", str(config), "--name", "demo")
    assert code == 0 and json.loads(said.out)["0"]["fills"] == 365
    assert json.loads(say("compare", f"{out}/demo")[1].out)["demo/0"]["fills"] == 365
    assert json.loads(say("experiment", "--input", events, "--output", str(tmp_path / "x"), "--latencies", "0.5,1", "--config", str(config))[1].out) == {"cases": 2}
    assert say("validate-data", "--input", str(tmp_path / "none"))[0] == 1
