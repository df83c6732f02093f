import hashlib
import json

import pytest

from quotewright.operators import validation
from quotewright.schema import CANONICAL, SchemaError, coerce, empty_events, events_frame, select_events
from quotewright.sources import canonical, fingerprint
from quotewright.sources.incremental import AdapterError, IncrementalAdapter
from quotewright.sources.manifest import ManifestError, write_manifest
from quotewright.sources.paired import PairedAdapter

STREAM = [(0, 0, "RESET", None, 0, 0), (0, 1, "SNAPSHOT", 1, 100, 10), (0, 2, "SNAPSHOT", -1, 102, 12), (1, 3, "ADD", 1, 99, 8), (2, 4, "CANCEL", -1, 102, 2), (3, 5, "TRADE", 1, 100, 4)]
BOOK = """false bid 99.00 3 1000|true bid 100.00 10 2000|true ask 101.00 12 2000|false bid 100.00 7 3000|false ask 101.00 15 4000|false bid 99.00 5 5000|false bid 100.00 0 6000|true bid 102.00 9 7000|true ask 103.00 11 7000"""
TRADES = "sell 100.00 2 3000|buy 101.00 2 4000|unknown 99.00 1 5000"
EVENTS = [
    (2_001_000, "RESET", None, 0, 0), (2_001_000, "SNAPSHOT", 1, 10_000, 10), (2_001_000, "SNAPSHOT", -1, 10_100, 12), (3_001_000, "TRADE", 1, 10_000, 2), (3_001_000, "CANCEL", 1, 10_000, 1), (4_001_000, "ADD", -1, 10_100, 3),
    (5_001_000, "ADD", 1, 9_900, 5), (6_001_000, "CANCEL", 1, 10_000, 7), (7_001_000, "RESET", None, 0, 0), (7_001_000, "SNAPSHOT", 1, 10_200, 9), (7_001_000, "SNAPSHOT", -1, 10_300, 11),
]


def book_frame(spark, text=BOOK):
    rows = [("fixture", "ABC-USD", int(t), int(t) + 1, f, s, p, a, i) for i, (f, s, p, a, t) in enumerate(x.split() for x in text.split("|"))]
    return spark.createDataFrame(rows, "exchange string, symbol string, timestamp bigint, local_timestamp bigint, is_snapshot string, side string, price string, amount string, row bigint")


def trade_frame(spark):
    rows = [("fixture", "ABC-USD", int(t), int(t) + 2, s, p, a, i) for i, (s, p, a, t) in enumerate(x.split() for x in TRADES.split("|"))]
    return spark.createDataFrame(rows, "exchange string, symbol string, timestamp bigint, local_timestamp bigint, side string, price string, amount string, row bigint")


def rows(df):
    return [(r.timestamp_ns, r.event_type, r.side, r.price_ticks, r.quantity) for r in df.orderBy("sequence_number").collect()]


def test_incremental_updates_and_trades(spark):
    a = IncrementalAdapter("0.01")
    assert rows(a.to_canonical(book_frame(spark), trade_frame(spark))) == EVENTS
    d = a.diagnostics(book_frame(spark), trade_frame(spark))
    assert (d["pre_snapshot_rows_skipped"], d["matched_trade_quantity"], d["unmatched_trade_quantity"], d["unknown_side_trades_skipped"]) == (1, 2, 2, 1)


def test_incremental_scaling_and_errors(spark):
    b = book_frame(spark, "true bid 10.0 0.50 10|true ask 10.5 0.25 10|false bid 10.0 0.25 11")
    got = rows(IncrementalAdapter("0.5", 4, "timestamp").to_canonical(b))
    assert got[0][0] == 10_000 and [r[4] for r in got] == [0, 2, 1, 1] and got[3][1] == "CANCEL"
    for bad in ("true bid 10 1 10|true bid 10 2 10", "true bid 10 1 10|false bid 10 2 9", "false bid 10 1 10"):
        with pytest.raises(AdapterError):
            IncrementalAdapter("1").to_canonical(book_frame(spark, bad))
    with pytest.raises(Exception, match="cannot be represented"):
        IncrementalAdapter("1").to_canonical(book_frame(spark, "true bid 10 0.5 10")).collect()


def test_shared_budget_is_spent_nearest_first(spark):
    kind = "exchange string, symbol string, side int, price_ticks bigint, row bigint, timestamp_ns bigint, quantity bigint"
    red = spark.createDataFrame([("x", "s", 1, 5, 1, 100, 4), ("x", "s", 1, 5, 2, 110, 4), ("x", "s", 1, 5, 3, 9000, 4)], kind)
    tr = spark.createDataFrame([("x", "s", 1, 5, 1, 109, 5), ("x", "s", 1, 5, 2, 100, 9)], kind)
    assert {r.row: r.matched for r in IncrementalAdapter("1", trade_match_window_ns=20).matched(red, tr).collect()} == {1: 4, 2: 4}


MESSAGES = """34200.000000001 1 1001 10 1010000 -1|34200.000000002 4 1001 4 1010000 -1|34200.000000003 2 2001 2 1000000 1|34200.000000004 1 2002 5 1005000 1|34200.000000005 5 0 3 1007500 -1
34200.000000006 7 0 0 -1 -1|34200.000000007 7 0 0 0 -1|34200.000000008 7 0 0 1 -1|34200.000000009 4 2002 5 1005000 1""".replace("\n", "|")
LEVELS = """1010000 10 1000000 12 1020000 20 990000 15|1010000 6 1000000 12 1020000 20 990000 15|1010000 6 1000000 10 1020000 20 990000 15|1010000 6 1005000 5 1020000 20 1000000 10|1010000 6 1005000 5 1020000 20 1000000 10
1010000 6 1005000 5 1020000 20 1000000 10|1010000 6 1005000 5 1020000 20 1000000 10|1010000 6 1005000 5 1020000 20 1000000 10|1010000 6 1000000 10 1020000 20 990000 15""".replace("\n", "|")


def cells(spark, text, n):
    return spark.createDataFrame([(*x.split(), i) for i, x in enumerate(text.split("|"))], ", ".join(f"c{i} string" for i in range(n)) + ", row bigint")


def test_paired_files(spark):
    got = rows(PairedAdapter("0.01", "2024-01-02", 2).to_canonical(cells(spark, MESSAGES, 6), cells(spark, LEVELS, 8)))
    kinds = [(k, s, p, q) for _, k, s, p, q in got]
    assert kinds[:9] == [("RESET", None, 0, 0), ("SNAPSHOT", 1, 10_000, 12), ("SNAPSHOT", 1, 9_900, 15), ("SNAPSHOT", -1, 10_100, 10), ("SNAPSHOT", -1, 10_200, 20), ("TRADE", -1, 10_100, 4), ("CANCEL", 1, 10_000, 2), ("ADD", 1, 10_050, 5), ("CANCEL", 1, 9_900, 15)]
    assert sum(k[0] == "RESET" for k in kinds) == 3 and kinds[-2:] == [("TRADE", 1, 10_050, 5), ("ADD", 1, 9_900, 15)]
    assert got[0][0] == 1_704_205_800 * 10**9 + 1 and got[5][0] - got[0][0] == 1
    book = {}
    for _, k, s, p, q in got:
        if k == "RESET":
            book = {}
        else:
            book[s, p] = book.get((s, p), 0) + (q if k in ("ADD", "SNAPSHOT") else -q)
    assert {k: v for k, v in book.items() if v} == {(1, 10_000): 10, (1, 9_900): 15, (-1, 10_100): 6, (-1, 10_200): 20}


def test_paired_dummy_levels_and_regression(spark):
    a = PairedAdapter("0.01", "2024-01-02", 2, "UTC")
    assert a.to_canonical(cells(spark, "1 1 1 1 1000000 1", 6), cells(spark, "1010000 2 1000000 3 9999999999 0 -9999999999 0", 8)).count() == 3
    with pytest.raises(AdapterError):
        a.to_canonical(cells(spark, "2 1 1 1 1000000 1|1 1 1 1 1000000 1", 6), cells(spark, "1010000 2 1000000 3 1020000 1 990000 1|1010000 2 1000000 3 1020000 1 990000 1", 8))


def test_canonical_files(spark, tmp_path):
    e = events_frame(spark, STREAM)
    assert canonical.load_events(spark, canonical.write_parquet(e, str(tmp_path / "a.parquet"))).orderBy("sequence_number").collect() == e.collect()
    path = str(tmp_path / "b.CSV")
    with open(path, "w") as f:
        f.write(",".join(CANONICAL.names) + "\n" + "\n".join(",".join("None" if x is None else str(x) for x in r) for r in STREAM))
    assert canonical.load(spark, path).collect() == e.collect()
    with pytest.raises(canonical.LoadError):
        canonical.load(spark, "x.json")
    with pytest.raises(SchemaError):
        coerce(e.drop("side"))
    with pytest.raises(SchemaError):
        coerce(e.selectExpr("*", "1 as more"))
    assert coerce(e.selectExpr("*", "1 as more"), allow_extra=True).columns == CANONICAL.names
    with pytest.raises(Exception, match="lossy"):
        coerce(e.selectExpr("timestamp_ns", "sequence_number", "event_type", "side", "price_ticks + 0.5 as price_ticks", "quantity")).collect()
    assert empty_events(spark).schema == CANONICAL


def test_fingerprints(spark, tmp_path):
    e = events_frame(spark, STREAM).selectExpr("1L as symbol", "*")
    want = hashlib.sha256(b"".join(fingerprint.record_bytes(*r) for r in STREAM)).hexdigest()
    r = fingerprint.stream_sha256(e.repartition(3), ["symbol"]).first()
    assert (r.stream_sha256, r.n_events) == (want, 6)
    out = tmp_path / "o.bin"
    out.write_bytes(b"abc")
    assert fingerprint.file_sha256(str(out)) == hashlib.sha256(b"abc").hexdigest() == fingerprint.files_sha256(spark, str(out)).first().sha256
    m = write_manifest(str(tmp_path / "m.json"), str(out), [str(out)], "incremental", {}, {"b": 1, "a": 2}, 3)
    assert json.loads((tmp_path / "m.json").read_text()) == m and m["output"]["sha256"] == hashlib.sha256(b"abc").hexdigest()
    for kw in ({"event_count": 0}, {"sources": []}, {"expected_sha256": "0"}):
        with pytest.raises(ManifestError):
            write_manifest(**({"path": str(tmp_path / "n.json"), "output": str(out), "sources": [str(out)], "adapter": "x", "parameters": {}, "diagnostics": {}, "event_count": 1} | kw))


def indexed(spark, stream):
    return events_frame(spark, stream).selectExpr("1L as symbol", "*").join(spark.createDataFrame([(r[1], i) for i, r in enumerate(stream)], "sequence_number bigint, event_index bigint"), "sequence_number")


def test_validation(spark):
    assert validation.validate(indexed(spark, STREAM)).valid
    spoiled = [*STREAM[:3], (2, 3, "CANCEL", 1, 100, 999), (1, 4, "ADD", 1, 99, 1)]
    v = validation.validate(indexed(spark, spoiled), strict=False)
    assert v.diagnostics == {"book_event_clamped": 1, "clamped_cancel": 1, "timestamp_regression": 1} and not v.valid
    with pytest.raises(validation.StreamError, match="invalid_book_transition"):
        validation.validate(indexed(spark, spoiled))
    with pytest.raises(validation.StreamError, match="empty"):
        validation.validate(indexed(spark, STREAM).limit(0))
    assert validation.validate_frame(spark.range(1), strict=False).diagnostics == {"invalid_schema": 1}


def test_adds_that_cross_are_issues(spark):
    stream = [(0, 0, "RESET", None, 0, 0), (0, 1, "SNAPSHOT", 1, 100, 5), (0, 2, "SNAPSHOT", -1, 102, 5), (1, 3, "ADD", -1, 100, 2), (2, 4, "TRADE", 1, 100, 1)]
    v = validation.validate(indexed(spark, stream), strict=False)
    assert v.diagnostics == {"book_event_clamped": 1, "crossed_add_ignored": 1}
    with pytest.raises(validation.StreamError, match="invalid_book_transition at event 3"):
        validation.validate(indexed(spark, stream))


def test_selection(spark):
    e = events_frame(spark, STREAM).selectExpr("1L as symbol", "*")
    assert [r.sequence_number for r in select_events(e, 0, 2, 4).orderBy("sequence_number").collect()] == [0, 1, 2, 3]


def test_line_numbers_of_split_files(spark, tmp_path):
    """Files that Spark splits still have contiguous line numbers, in the order of the file and of the files' paths."""
    n = 20_000
    for name, first in (("a.csv", 0), ("b.csv", n)):
        (tmp_path / name).write_text("".join(f"{i},{'x' * (i % 37)}\n" for i in range(first, first + n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = canonical.read_vendor_csv(spark, str(tmp_path), False)
        assert df.rdd.getNumPartitions() > 1
        assert df.where("cast(_c0 as bigint) <> row").count() == 0 and df.count() == 2 * n
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_paired_files_of_unequal_height_and_bad_books(spark):
    a = PairedAdapter("0.01", "2024-01-02", 2, "UTC")
    one, two = "1 1 1 1 1000000 1", "1010000 2 1000000 3 1020000 1 990000 1"
    for messages, book in ((one, f"{two}|{two}"), (f"{one}|{one}", two), (one, "1010000 2 1000000 3 1010000 1 990000 1"), (one, "1000000 2 1010000 3 1020000 1 990000 1")):
        with pytest.raises(AdapterError):
            a.to_canonical(cells(spark, messages, 6), cells(spark, book, 8))


def test_a_message_comes_before_what_it_does_not_explain(spark):
    """A cancel of another level in the same row is reconciled after the message's own event."""
    messages = "1 1 1 1 1000000 1|2 1 2 5 1010000 -1"
    book = "1010000 2 1000000 3 1020000 1 990000 1|1010000 7 990000 1 1020000 1 980000 1"
    got = rows(PairedAdapter("0.01", "2024-01-02", 2, "UTC").to_canonical(cells(spark, messages, 6), cells(spark, book, 8)))
    assert [x[1:] for x in got[5:]] == [("ADD", -1, 10_100, 5), ("CANCEL", 1, 10_000, 3), ("ADD", 1, 9_800, 1)]


def test_adapters_rows_and_certificates(spark, tmp_path):
    from quotewright.schema import event_of, event_rows
    from quotewright.sources.adapter import Adapter

    assert isinstance(IncrementalAdapter("0.01"), Adapter) and PairedAdapter.name == "paired"
    with pytest.raises(TypeError):
        Adapter()
    assert IncrementalAdapter("0.01").checked(book_frame(spark), keys=("exchange", "symbol")).columns[2:] == CANONICAL.names
    e = events_frame(spark, STREAM)
    assert [tuple(x.values()) for x in event_rows(e)] == STREAM
    with pytest.raises(SchemaError):
        event_of({"side": 1})
    assert validation.validate_file(spark, canonical.write_parquet(e, str(tmp_path / "v.parquet"))).valid
    assert validation.validate_file(spark, canonical.write_parquet(spark.range(2), str(tmp_path / "w.parquet")), strict=False).diagnostics == {"invalid_schema": 1}
    with pytest.raises(SchemaError):
        validation.validate_file(spark, str(tmp_path / "w.parquet"))
    c = validation.certify(indexed(spark, STREAM))
    assert validation.holds(c, indexed(spark, STREAM)) and not validation.holds(c, indexed(spark, STREAM), strict=False)
    assert not validation.holds(c, indexed(spark, STREAM[:-1]))


def _book_rows(spark, rows, symbol="A"):
    """row, local_us, snap, side, price, amount"""
    return spark.createDataFrame([("x", symbol, r, t, t, str(s).lower(), d, str(p), str(a)) for r, t, s, d, p, a in rows], "exchange string, symbol string, row bigint, timestamp bigint, local_timestamp bigint, is_snapshot string, side string, price string, amount string")


def test_guards_look_at_the_book_when_a_local_time_is_over(spark):
    adapter = IncrementalAdapter("1")
    fine = [(0, 1, True, "bid", 10, 1), (1, 1, True, "ask", 12, 1), (2, 5, False, "bid", 12, 3), (3, 5, False, "ask", 12, 0), (4, 5, False, "ask", 14, 1), (5, 6, False, "bid", 13, 0)]
    problems = lambda rows: [(r.row, r.problem) for r in adapter.problems(adapter.levels(_book_rows(spark, rows))).orderBy("row").collect()]
    assert problems(fine) == []
    assert problems([*fine[:3], (3, 6, False, "ask", 12, 0)]) == [(2, "book crosses: bid 12, ask 12 ticks")]
    assert problems([*fine, (6, 7, False, "ask", 11, 1)]) == [(6, "book crosses: bid 12, ask 11 ticks")]  # the last row closes, too
    # a snapshot in the same local time clears what was there before anything is looked at
    assert problems([*fine[:3], (3, 5, True, "bid", 9, 1), (4, 5, True, "ask", 11, 1)]) == []
    assert problems([*fine, (6, 4, False, "bid", 9, 1)]) == [(6, "timestamps regress")]
    assert problems([fine[0], fine[0][:2] + (True, "bid", 10, 2), fine[1]][:2] + [(2, 1, True, "bid", 10, 5)])[-1][1] == "duplicate snapshot level"
    with pytest.raises(AdapterError, match="book crosses.* at row 2 of A"):
        adapter.to_canonical(_book_rows(spark, [*fine[:3], (3, 6, False, "ask", 12, 0)]))


def test_guards_of_instruments_and_trades(spark):
    adapter = IncrementalAdapter("1")
    rows = [(0, 1, True, "bid", 10, 4), (1, 2, False, "bid", 10, 1)]
    both = _book_rows(spark, rows).unionByName(_book_rows(spark, rows, "B"))
    with pytest.raises(AdapterError, match="several instruments: x A, x B"):
        adapter.to_canonical(both, single=True)
    trades = lambda *ts: spark.createDataFrame([("x", sym, i, t, t, "sell", "10", "2") for i, (sym, t) in enumerate(ts)], "exchange string, symbol string, row bigint, timestamp bigint, local_timestamp bigint, side string, price string, amount string")
    with pytest.raises(AdapterError, match="trades of x C"):
        adapter.to_canonical(both, trades(("A", 2), ("C", 2)))
    with pytest.raises(AdapterError, match="trade timestamps regress at row 1 of A"):
        adapter.to_canonical(both, trades(("A", 3), ("A", 2)))
    # rows are numbered per instrument here: a match of A's row 1 is none of B's
    out = adapter.to_canonical(both, trades(("A", 2)))
    assert sorted((r.symbol, r.event_type, r.quantity) for r in out.collect() if r.event_type in ("TRADE", "CANCEL")) == [("A", "CANCEL", 1), ("A", "TRADE", 2), ("B", "CANCEL", 3)]


def test_counters_of_paired_files(spark):
    """Halts and resumes once and again, hidden executions, cross trades, and messages that the visible book doesn't show."""
    codes = "1 5 7:-1 7:-1 1 7:0 7:0 7:1 6 1 4 2"
    messages = "|".join(f"{i}.5 {c.split(':')[0]} {i} 4 {c.split(':')[1] if ':' in c else 1000000} 1" for i, c in enumerate(codes.split(), 1))
    books = ["1010000 2 1000000 3 1020000 1 990000 1"] * 9 + ["1010000 2 1000000 5 1020000 1 990000 1"] + ["1010000 2 1000000 5 1020000 1 990000 1"] + ["1010000 2 1000000 1 1020000 1 990000 1"]
    a = PairedAdapter("0.01", "2024-01-02", 2, "UTC")
    got = a.diagnostics(cells(spark, messages, 6), cells(spark, "|".join(books), 8))
    assert got == {
        "source_rows": 12, "first_message_represented_by_snapshot": 1, "messages_while_halted_skipped": 1, "halt_resets": 1, "halt_resumes": 1, "redundant_halt_resume_indicators": 2, "hidden_executions_not_emitted": 1, "cross_trades_not_emitted": 1,
        "messages_outside_visible_depth": 1, "partially_visible_message_quantity": 2,
    }
    plan = a.states(cells(spark, messages, 6))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    with pytest.raises(AdapterError, match=r"out of order \(row 0\)"):
        a.to_canonical(cells(spark, "1 1 1 1 1000000 1", 6), cells(spark, "1020000 2 1000000 3 1010000 1 990000 1", 8))


def test_manifests_of_folders(spark, tmp_path):
    from quotewright.sources.manifest import folder_record, verify_folder

    out = f"{tmp_path}/events"
    spark.range(30).selectExpr("id", "id % 3 as symbol").repartition(2).write.partitionBy("symbol").parquet(out)
    args = {"path": f"{tmp_path}/m.json", "output": out, "sources": [out], "adapter": "paired", "parameters": {}, "diagnostics": {}, "event_count": 30, "spark": spark}
    m = write_manifest(**args)
    assert json.loads((tmp_path / "m.json").read_text()) == m and verify_folder(spark, m) == []
    names = sorted(str(p.relative_to(out)) for p in (tmp_path / "events").rglob("*.parquet"))
    assert [p["path"] for p in m["output"]["parts"]] == names and m["output"]["parts"][0]["sha256"] == hashlib.sha256((tmp_path / "events" / names[0]).read_bytes()).hexdigest()
    lines = "".join(f"{p['path']} {p['size_bytes']} {p['sha256']}\n" for p in m["output"]["parts"])
    assert m["output"]["sha256"] == hashlib.sha256(lines.encode()).hexdigest() == folder_record(spark, f"file://{out}")["sha256"]
    write_manifest(**args | {"provenance": {"checksum_sha256": m["output"]["sha256"]}})
    for bad in ({"provenance": {"synthetic_demonstration": True}}, {"provenance": {"checksum_sha256": "0"}}, {"adapter": " "}, {"event_count": 0}):
        with pytest.raises(ManifestError):
            write_manifest(**args | bad)
    (tmp_path / "events" / names[0]).unlink()
    assert verify_folder(spark, m) == [names[0]]


def test_statements_of_origin():
    import datetime as dt

    from quotewright.sources.provenance import Provenance, ProvenanceError

    made = {"source_type": "synthetic", "provider": " generator ", "venue": "SIMULATED", "symbol": "S", "dataset_id": "d", "license_notes": "none"}
    known = made | {"source_type": "historical", "provider": "vendor", "venue": "X", "session_start": dt.date(2024, 1, 2), "session_end": dt.date(2024, 1, 2), "checksum_sha256": "A" * 64}
    assert Provenance(**made).record() == made | {"provider": "generator", "session_start": None, "session_end": None, "checksum_sha256": None, "synthetic_demonstration": True}
    assert Provenance(**known).record()["session_end"] == "2024-01-02" and Provenance(**known).checksum_sha256 == "a" * 64 and not Provenance(**known).synthetic_demonstration
    for bad in ({"source_type": "other"}, {"symbol": "  "}, {"checksum_sha256": "f" * 63}, {"session_end": dt.date(2024, 1, 1)}, {"session_start": None}, {"checksum_sha256": None}, {"venue": "simulated"}, {"provider": "Synthetic Ltd"}):
        with pytest.raises(ProvenanceError):
            Provenance(**(known | bad))


def by_definition(reductions, trades, window):
    """What trades, in row order, take of (time, row, quantity) reductions: nearest first, then earlier, then by row."""
    left = {r: q for _, r, q in reductions}
    for at, _, rest in sorted(trades, key=lambda t: t[1]):
        for t, r, _ in sorted((x for x in reductions if abs(x[0] - at) <= window), key=lambda x: (abs(x[0] - at), x[0], x[1])):
            q = min(rest, left[r])
            left[r] -= q
            rest -= q
    return {r: q - left[r] for _, r, q in reductions if q > left[r]}


@pytest.mark.parametrize("ordered", (True, False))
def test_trades_take_what_the_definition_says(ordered, monkeypatch):
    import random

    import pyarrow as pa

    from quotewright.sources import incremental

    monkeypatch.setattr(incremental, "KEPT", 8)
    rnd = random.Random(5)
    for case in range(150):
        span, window = rnd.choice(((30, 4), (300, 9), (300, 60), (2_000, 40)))
        rows, want = [], {}
        for price in (1, 2):
            first = 1_000 * price
            red = [(rnd.randrange(span), first + i, rnd.randint(1, 9)) for i in range(rnd.randint(0, 80))]
            times = [rnd.randrange(span) for _ in range(rnd.randint(0, 60))]
            tr = [(t, i, rnd.randint(1, 14)) for i, t in enumerate(sorted(times) if ordered else times)]
            want |= by_definition(red, tr, window)
            rows += sorted([("x", "s", 1, price, t, 0, r, q) for t, r, q in red] + [("x", "s", 1, price, t, 1, r, q) for t, r, q in tr])
        names = ["exchange", "symbol", "side", "price_ticks", "timestamp_ns", "kind", "row", "quantity"]
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows[k : k + 37]]) for k in range(0, len(rows), 37)]
        got = [r for b in incremental._shares(iter(batches), window, ordered) for r in b.to_pylist()]
        assert {r["row"]: r["matched"] for r in got} == want and len(got) == len(want)


def test_a_trade_does_not_walk_over_what_is_empty():
    import time

    import pyarrow as pa

    from quotewright.sources.incremental import _shares

    n = 60_000  # all within one window: over every pair this would take half an hour
    rows = {"exchange": ["x"] * 2 * n, "symbol": ["s"] * 2 * n, "side": [1] * 2 * n, "price_ticks": [5] * 2 * n, "timestamp_ns": [k // 2 for k in range(2 * n)], "kind": [k % 2 for k in range(2 * n)], "row": list(range(2 * n)), "quantity": [2 - k % 2 for k in range(2 * n)]}
    for ordered in (True, False):
        start = time.process_time()
        got = [m for b in _shares(iter([pa.RecordBatch.from_pydict(rows)]), 10**9, ordered) for m in b.column(3).to_pylist()]
        assert sum(got) == n and time.process_time() - start < 30
