import random

import pytest
from pyspark.sql import functions as F

from quotewright.functions import quotes as Q
from quotewright.operators import asof, book, metrics, orders, queue, running
from quotewright.schema import events_frame


def events(spark, rows, symbol=1):
    return book.with_epochs(events_frame(spark, rows).selectExpr(f"{symbol}L as symbol", "*"), 4)


SEEDED = [(i, i, "SNAPSHOT", s, p, q) for i, (s, p, q) in enumerate([(1, 100, 10), (1, 99, 20), (1, 98, 30), (-1, 102, 40), (-1, 103, 50), (-1, 104, 60)])]


def test_book_features(spark):
    e = events(spark, SEEDED)
    r = book.bbo(e).withColumns(book.top_features()).orderBy(F.desc("sequence_number")).first()
    assert (r.spread_ticks, r.midpoint_ticks, r.is_crossed) == (2, 101.0, False)
    assert r.microprice_ticks == pytest.approx((102 * 10 + 100 * 40) / 50) and r.imbalance == pytest.approx((10 - 40) / 50)
    w = book.weighted_imbalance(e, 2).where("sequence_number = 5").first().weighted_imbalance
    assert w == pytest.approx(((10 + 20 / 2) - (40 + 50 / 2)) / ((10 + 20 / 2) + (40 + 50 / 2)))
    first = book.bbo(e).orderBy("sequence_number").first()
    assert (first.best_ask_ticks, first.best_ask_quantity) == (None, 0)


def test_both_forms_of_the_book_equal_a_fold(spark):
    rnd, rows, state = random.Random(7), [], {1: {}, -1: {}}
    want = []
    for i in range(600):
        if rnd.random() < 0.03:
            rows.append((i, i, "RESET", None, 0, 0))
            state = {1: {}, -1: {}}
        else:
            s = rnd.choice((1, -1))
            k, p, q = rnd.choice(("ADD", "SNAPSHOT", "CANCEL", "TRADE")), 100 - s * rnd.randint(1, 5), rnd.randint(1, 9)
            rows.append((i, i, k, s, p, q))
            state[s][p] = max(0, state[s].get(p, 0) + (q if k in ("ADD", "SNAPSHOT") else -q))
        b = max((p for p, q in state[1].items() if q), default=None)
        a = min((p for p, q in state[-1].items() if q), default=None)
        want.append((i, b, state[1].get(b, 0), a, state[-1].get(a, 0)))
    names = ["sequence_number", "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity"]
    e = events(spark, rows)
    for form in (book.bbo, book.bbo_relational):
        assert [tuple(r) for r in form(e).orderBy("sequence_number").select(*names).collect()] == want


def test_adds_that_cross_are_ignored_in_every_form(spark):
    from quotewright.simulation.kernel import Book

    rnd, rows, want, ignored, b = random.Random(11), [], [], [], Book()
    for i in range(800):
        if rnd.random() < 0.02 or 500 <= i < 503:
            rows.append((i, i, "RESET", None, 0, 0))
        else:
            s = rnd.choice((1, -1))
            rows.append((i, i, rnd.choice(("ADD", "SNAPSHOT", "CANCEL", "TRADE")), s, 100 - s * rnd.randint(-2, 5), rnd.randint(1, 9)))
        before = b.ignored
        b.apply(*rows[-1][2:])
        ignored += [i] * (b.ignored - before)
        want.append((i, *b.top()[:4]))
    e = events(spark, rows)
    assert len(ignored) > 20
    names = ["sequence_number", "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity"]
    for form in (book.bbo, book.bbo_relational):
        assert [tuple(r) for r in form(e).orderBy("sequence_number").select(*names).collect()] == want
    assert [r.sequence_number for r in book.crossing(e).where("add_ignored").orderBy("sequence_number").collect()] == ignored
    assert all(r.clamped and not r.qty_applied and r.qty_before == r.qty_after for r in book.level_changes(e).where("add_ignored").collect())
    tops = {(r.sequence_number, r.side): r.price_ticks for r in book.top_n(e, 1).collect()}
    assert tops == {(i, s): p for i, bid, _, ask, _ in want for s, p in ((1, bid), (-1, ask)) if p is not None}


def test_a_strict_book_raises_the_first_bad_event(spark):
    assert book.strict(events(spark, SEEDED)).count() == len(SEEDED)
    with pytest.raises(book.CrossedBookError, match="event 6 of symbol 1"):
        book.strict(events(spark, [*SEEDED, (6, 6, "ADD", 1, 102, 1), (7, 7, "CANCEL", 1, 100, 99)]))
    with pytest.raises(book.InsufficientDepthError, match="where 10 stands"):
        book.strict(events(spark, [*SEEDED, (6, 6, "CANCEL", 1, 100, 99), (7, 7, "ADD", 1, 102, 1)]))


def test_snapshots_replace_the_whole_book(spark):
    frame = lambda *rows: spark.createDataFrame([(1, 9, 20, *r) for r in rows], "symbol bigint, timestamp_ns bigint, sequence_number bigint, side tinyint, price_ticks bigint, quantity bigint")
    new = book.snapshot(frame((-1, 106, 3), (1, 104, 2), (1, 105, 1)))
    assert [tuple(r)[2:] for r in new.orderBy("sequence_number").collect()] == [(20, "RESET", None, 0, 0), (21, "SNAPSHOT", 1, 105, 1), (22, "SNAPSHOT", 1, 104, 2), (23, "SNAPSHOT", -1, 106, 3)]
    old = events_frame(spark, SEEDED).selectExpr("1L as symbol", "*").select(*new.columns)
    both, alone = (book.level_maps(book.with_epochs(x)) for x in (old.unionByName(new), new))
    m = both.first()
    assert (m.bids, m.asks, m.n_levels) == ({104: 2, 105: 1}, {106: 3}, 3) and book.same_books(both, alone).first().same
    assert not book.same_books(both, book.level_maps(book.with_epochs(old))).first().same
    cleared = book.level_maps(book.with_epochs(old.unionByName(book.snapshot(frame((None, None, None)))))).first()
    assert (cleared.bids, cleared.asks, cleared.n_levels) == ({}, {}, 0)
    for rows, error in ((((1, 100, 1), (1, 100, 2)), "duplicate"), (((1, 100, 0), (-1, 101, 1)), "positive"), (((1, 101, 1), (-1, 101, 1)), "best bid")):
        with pytest.raises(book.BookError, match=error):
            book.snapshot(frame(*rows))


def test_views(spark):
    v = {r.sequence_number: r for r in book.views(events(spark, SEEDED), 2).collect()}
    assert [tuple(x) for x in v[5].bids] == [(100, 10), (99, 20)] and [tuple(x) for x in v[5].asks] == [(102, 40), (103, 50)]
    assert (v[0].bids[0].quantity, v[0].asks, v[5].spread_ticks) == (10, [], 2)


def test_two_level_running_values(spark):
    rnd = random.Random(3)
    data = [(k, i, rnd.randint(-9, 9), rnd.choice((None, rnd.random()))) for k in (1, 2) for i in range(70)]
    df = spark.createDataFrame(data, "k int, o bigint, v int, x double")
    got = {(r.k, r.o): r for r in running.running_max(running.running_sum(df, ["k"], "o", F.col("v"), "s", 8), ["k"], ["o"], F.col("v"), "m", "o", 8).collect()}
    back = {(r.k, r.o): r.c for r in running.carried(df, ["k"], ["o"], F.col("x"), "c", "o", 8).collect()}
    ahead = {(r.k, r.o): r.c for r in running.carried(df, ["k"], ["o"], F.col("x"), "c", "o", 8, False).collect()}
    for k in (1, 2):
        mine = [d for d in data if d[0] == k]
        for i, d in enumerate(mine):
            vs = [x[2] for x in mine[: i + 1]]
            assert (got[k, d[1]].s, got[k, d[1]].m) == (sum(vs), max(vs))
            assert back[k, d[1]] == next((x[3] for x in reversed(mine[: i + 1]) if x[3] is not None), None)
            assert ahead[k, d[1]] == next((x[3] for x in mine[i:] if x[3] is not None), None)


def test_markouts(spark):
    fills = spark.createDataFrame([(1, 1, 1, 2, 100, 0, "maker"), (1, 2, -1, 1, 102, 0, "taker")], "symbol bigint, fill_id bigint, side int, quantity bigint, price_ticks bigint, fill_timestamp_ns bigint, liquidity_role string")
    market = spark.createDataFrame([(1, 100, 1, 101.0), (1, 110, 2, 103.0)], "symbol bigint, timestamp_ns bigint, sequence_number bigint, midpoint_ticks double")
    got = {(r.fill_id, r.horizon_ns): r for r in metrics.markouts(fills, market, [105, 200], 0.01, 16).collect()}
    assert (got[1, 105].markout_ticks, got[2, 105].markout_ticks, got[1, 105].future_timestamp_ns) == (3.0, -1.0, 110)
    assert got[1, 105].markout_value == pytest.approx(0.06) and got[1, 200].markout_ticks is None


def test_asof_ties(spark):
    left = spark.createDataFrame([(1, 10), (1, 5), (1, 30)], "symbol bigint, t bigint")
    right = spark.createDataFrame([(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 20, 3, "c")], "symbol bigint, timestamp_ns bigint, sequence_number bigint, x string")
    fwd = {r.t: r._found and r._found.x for r in asof.forward_asof(left, right, ["symbol"], F.col("t"), ["x"], 7).collect()}
    back = {r.t: r._found and r._found.x for r in asof.backward_asof(left, right, ["symbol"], F.col("t"), ["x"], 7).collect()}
    assert fwd == {10: "a", 5: "a", 30: None} and back == {10: "b", 5: None, 30: "c"}


def seg(spark, rows):
    return spark.createDataFrame([("l", i, own, q) for i, (own, q) in enumerate(rows)], "level string, seg bigint, own boolean, quantity bigint")


def test_queue_allocation(spark):
    s = seg(spark, [(False, 100), (True, 10), (False, 50)])

    def left(df):
        d = {r.seg: r.cancelled for r in df.collect()}
        return 100 - d[0], 50 - d[2]

    assert left(queue.cancel_back(s, F.lit(60))) == (90, 0)
    assert left(queue.cancel_front(s, F.lit(60))) == (40, 50)
    assert left(queue.cancel_pro_rata(s, F.lit(60).cast("bigint"))) == (60, 30)
    t = {r.seg: r.consumed for r in queue.trade_budget(seg(spark, [(False, 100), (True, 10), (False, 5), (True, 10)]), F.lit(115)).collect()}
    assert t == {0: 100, 1: 10, 2: 5, 3: 0}
    p = queue.positions(s).first()
    assert (p.external_ahead, p.own_ahead, p.external_behind) == (100, 0, 50)
    rec = queue.reconcile(s, spark.createDataFrame([("l", 140)], "level string, displayed bigint")).first()
    assert (rec.external, rec.own, rec.difference) == (150, 10, 10)


def test_sweep(spark):
    lv = spark.createDataFrame([(1, 101, 5), (1, 102, 7)], "g int, p bigint, quantity bigint")
    assert {r.p: r.taken for r in book.sweep(lv, ["g"], F.lit(10), [F.col("p")]).collect()} == {101: 5, 102: 5}


def test_quotes_and_costs(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("c")).first().c
    bid, ask = Q.rounded_quotes(F.lit(100.5), F.lit(0.0))
    assert (v(bid), v(ask)) == (100, 101)
    assert [v(Q.tapered_quantity(10, F.lit(i), 100)) for i in (0, 50, 100, -400)] == [10, 6, 2, 2]
    fee, rebate = Q.costs(F.lit(10), F.lit(100), F.lit("maker"), "0.01", "0.01", "0.002", "0.03", "0.001")
    assert (float(v(fee)), float(v(rebate))) == (0.11, 0.02)
    fee, _ = Q.costs(F.lit(10), F.lit(100), F.lit("taker"), "0.01", "0.01", "0.002", "0.03", "0.001")
    assert float(v(fee)) == 0.31
    assert v(Q.price_to_ticks(F.lit("100.25"), "0.25")) == 401 and v(Q.price_to_ticks(F.lit("0.025"), "0.01", strict=False)) == 2
    with pytest.raises(Exception, match="off tick"):
        v(Q.price_to_ticks(F.lit("100.005"), "0.01"))
    assert [v(Q.horizon_label(F.lit(n))) for n in (10**9, 250 * 10**6, 5)] == ["1s", "250ms", "5ns"]


def test_orders(spark):
    f = spark.createDataFrame([("o", 4, 99), ("o", 6, 100)], "order_id string, quantity bigint, price_ticks bigint")
    r = orders.average_fill_price(f).first()
    assert (r.notional_ticks, r.average_fill_price_ticks) == (996, 99.6)
    o = spark.createDataFrame([(1, 1, 8), (1, -1, 7), (1, 1, 4)], "symbol bigint, side int, quantity bigint")
    e = orders.worst_case_exposure(o, spark.createDataFrame([(1, 3)], "symbol bigint, inventory bigint")).first()
    assert (e.worst_long, e.worst_short, e.open_quantity, e.open_orders) == (15, -4, 19, 3)
    q = spark.createDataFrame([("a", 0), ("old", -1)], "order_id string, submitted_ns bigint")
    assert [r.order_id for r in orders.stale_quotes(q, F.lit(100), 100).collect()] == ["old"]
    t = spark.createDataFrame([("x", 0, "live"), ("x", 1, "filled"), ("x", 2, "live")], "order_id string, transition_id int, new_status string")
    assert [(r.previous_status, r.new_status) for r in orders.illegal_transitions(t).collect()] == [("filled", "live")]


def test_message_rate_edges(spark):
    m = spark.createDataFrame([(1, t) for t in (0, 999_999_999, 1_000_000_000)], "symbol bigint, timestamp_ns bigint")
    assert [r.n_window for r in metrics.message_counts(m).orderBy("timestamp_ns").collect()] == [1, 2, 2]


@pytest.mark.parametrize("seed,low", [(1, -2), (2, -3), (3, 1)])
def test_parts_of_an_epoch_equal_a_serial_fold(spark, seed, low):
    """Parts of 16 sequence numbers, with adds that cross (low below 1) and levels that stand over many parts."""
    from quotewright.simulation.kernel import Book

    rnd, rows, want, ignored, b = random.Random(seed), [], [], [], Book()
    for i in range(280):
        if rnd.random() < 0.006:
            rows.append((i, i, "RESET", None, 0, 0))
        else:
            s = rnd.choice((1, -1))
            rows.append((i, i, rnd.choice(("ADD", "ADD", "SNAPSHOT", "CANCEL", "TRADE")), s, 100 - s * rnd.randint(low, 9), rnd.randint(1, 9)))
        before = b.ignored
        b.apply(*rows[-1][2:])
        ignored += [i] * (b.ignored - before)
        want.append((i, *b.top()[:4]))
    e = events(spark, rows)
    assert bool(ignored) == (low < 1)
    names = ["sequence_number", "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity"]
    got = book.bbo(e, 16)
    assert book._starts(e, 16)[1].select("part").distinct().count() > 10
    assert [tuple(r) for r in got.orderBy("sequence_number").select(*names).collect()] == want
    assert [r.sequence_number for r in book.crossing(e, 16).where("add_ignored").orderBy("sequence_number").collect()] == ignored
    for form in (lambda w: book.level_changes(e, w), lambda w: book.ladder(e, 4, width=w)):
        assert sorted(map(str, form(16).collect())) == sorted(map(str, form(10_000).collect()))


def test_seams_are_repaired_along_a_chain(spark):
    """Every part's start depends on an add that the part before ignores: the repair goes on from part to part."""
    rows = [(0, 0, "ADD", 1, 100, 5), (1, 1, "ADD", -1, 101, 5)]
    for i in range(2, 20, 3):
        rows += [(i, i, "ADD", 1, 101 + i, 7), (i + 1, i + 1, "CANCEL", 1, 101 + i - 3, 7), (i + 2, i + 2, "ADD", -1, 101 + i - 4, 2)]
    e = events(spark, rows)
    serial, parts = (sorted(map(str, book.bbo(e, w).collect())) for w in (10_000, 4))
    assert serial == parts
    assert sorted(map(str, book.crossing(e, 4).collect())) == sorted(map(str, book.crossing(e, 10_000).collect()))


def test_cells_of_rolling_windows_equal_whole_windows(spark):
    rnd = random.Random(5)
    rows = [(s, i, rnd.choice([None, 1.0 * rnd.randint(90, 110)]), 10 * i + rnd.randint(0, 9)) for s in (1, 2) for i in range(150)]
    m = spark.createDataFrame(rows, "symbol bigint, sequence_number bigint, midpoint_ticks double, timestamp_ns bigint")
    for window in (1, 3, 12):
        whole, cells = ({(r.symbol, r.sequence_number): r.volatility_ticks for r in metrics.rolling_volatility(m, window, w).collect()} for w in (1 << 20, 5))
        assert whole.keys() == cells.keys() and all(whole[k] == pytest.approx(cells[k], abs=1e-9) for k in whole)
    for s in (1, 2):
        mids = [(i, x) for t, i, x, _ in rows if t == s and x is not None]
        d = [b[1] - a[1] for a, b in zip(mids, mids[1:])][-3:]
        mean = sum(d) / 3
        assert whole and metrics.rolling_volatility(m, 3, 5).where(f"symbol = {s} and sequence_number = {mids[-1][0]}").first().volatility_ticks == pytest.approx((sum((x - mean) ** 2 for x in d) / 3) ** 0.5)
    times = sorted((s, t) for s, _, _, t in rows)
    for span, width in ((25, 25), (25, 40), (100, 1000), (1, 1)):
        got = {(r.symbol, r.timestamp_ns): r.n_window for r in metrics.message_counts(m, span, width).collect()}
        assert got == {(s, t): sum(1 for u, v in times if u == s and t - span < v <= t) for s, t in times}


def test_drawdown_of_buckets(spark):
    rnd = random.Random(9)
    values = [(s, 3 * i, None if rnd.random() < 0.1 else rnd.uniform(-50, 50)) for s in (1, 2, 3) for i in range(80)]
    values += [(4, 0, -5.0), (5, 0, None)]
    p = spark.createDataFrame(values, "symbol bigint, fill_id bigint, v double")
    for zero in (False, True):
        want = {}
        for s in (1, 2, 3, 4, 5):
            high, fall = (0.0 if zero else None), None
            for v in (v for t, _, v in values if t == s and v is not None):
                high = v if high is None else max(high, v)
                fall = max(high - v, fall or 0.0)
            want[s] = fall
        for width in (1, 7, 1 << 20):
            assert {r.symbol: r.max_drawdown for r in metrics.drawdown(p, "v", zero, width).collect()} == want


def test_nearest_ranks_are_values_of_the_table(spark):
    from math import ceil

    from quotewright.operators.selection import nearest_ranks

    rnd = random.Random(3)
    groups = {"a": [rnd.gauss(0, 1) for _ in range(400)], "b": [5.0] * 30 + [7.0], "c": [1e308, -1e308, 0.0, 1e-320, 5e-324, 2.0], "d": [10.0**k for k in range(-30, 30)], "e": [float("nan"), None], "f": [3.0, float("nan"), None], None: [1.5, 2.5, 2.5]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    ps = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: r for r in nearest_ranks(df, ["k"], "v", ps, cells=8).collect()}
    for k, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and v == v)
        assert (k in got) == bool(vs)
        for name, p in ps.items():
            assert not vs or got[k][name] == vs[max(0, ceil(p * len(vs)) - 1)], (k, name)
    longs = spark.createDataFrame([(2**62 + i,) for i in range(50)], "v bigint")
    assert tuple(nearest_ranks(longs, [], "v", ps, cells=4).first()) == tuple(2**62 + max(0, ceil(p * 50) - 1) for p in ps.values())


def test_numbering_in_buckets(spark):
    rnd = random.Random(4)
    rows = [(rnd.randint(0, 2), rnd.randint(0, 60), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, t bigint, i bigint")
    want = {}
    for n, (k, t, i) in enumerate(sorted(rows)):
        want[i] = sum(1 for r in sorted(rows)[:n] if r[0] == k)
    assert {r.i: r.n for r in running.numbered(df, ["k"], ["t", "i"], "n", "t", 7).collect()} == want
