"""The queries over all events and all ADD rows, against a plain replay of the same stream."""

from collections import defaultdict

import pytest

from quotewright import catalog
from quotewright.plans.bindings import l2
from quotewright.plans.run_queries import DAY, fills


@pytest.fixture(scope="module")
def stream(spark, sf):
    return sorted(l2(spark, sf).select("symbol", "sequence_number", "timestamp_ns", "event_type", "side", "price_ticks", "quantity").collect())


def replay(stream):
    """Every event with the levels (price, quantity) of both sides after it, best first."""
    books = defaultdict(lambda: {1: {}, -1: {}})
    for r in stream:
        if r.event_type == "RESET":
            books.pop(r.symbol, None)
        else:
            b = books[r.symbol][r.side]
            b[r.price_ticks] = max(0, b.get(r.price_ticks, 0) + (r.quantity if r.event_type in ("ADD", "SNAPSHOT") else -r.quantity))
        for s in (1, -1):
            yield r, s, [(p, q) for p, q in sorted(books[r.symbol][s].items(), key=lambda x: -x[0] * s) if q]


def run(name, spark, sf, *columns):
    return sorted(tuple(r) for r in catalog.QUERIES[name](spark, sf).select(*columns).collect())


def test_depth_and_imbalance_of_all_events(spark, sf, stream):
    want, sums = [], defaultdict(dict)
    for r, s, lv in replay(stream):
        want += [(r.symbol, r.sequence_number, s, i + 1, p, q) for i, (p, q) in enumerate(lv[:5])]
        if lv:
            sums[r.symbol, r.sequence_number][s] = sum(q / (i + 1) for i, (_, q) in enumerate(lv[:5]))
    assert run("book_depth_topn", spark, sf, "symbol", "sequence_number", "side", "rank", "price_ticks", "quantity") == sorted(want)
    got = {x[:2]: x[2] for x in run("weighted_imbalance", spark, sf, "symbol", "sequence_number", "weighted_imbalance")}
    assert got.keys() == sums.keys()
    for k, v in sums.items():
        assert got[k] is None if len(v) < 2 else got[k] == pytest.approx((v[1] - v[-1]) / (v[1] + v[-1]), abs=1e-8)


def test_sweeps_of_all_events_and_both_sides(spark, sf, stream):
    want = []
    for r, s, lv in replay(stream):
        left = 60
        for p, q in lv:
            if left > 0:
                want.append((r.symbol, r.sequence_number, s, p, min(q, left)))
                left -= q
    assert run("sweep_allocation", spark, sf, "symbol", "sequence_number", "side", "price_ticks", "taken") == sorted(want)


def test_orders_of_all_adds(spark, sf, stream):
    adds = [r for r in stream if r.event_type == "ADD"]
    want, epoch, rows = [], defaultdict(int), defaultdict(list)
    for r in stream:
        epoch[r.symbol] += r.event_type == "RESET"
        rows[r.symbol, epoch[r.symbol]].append(r)
    for part in rows.values():
        for i, o in enumerate(part):
            if o.event_type == "ADD":
                hit = next((t for t in part[i + 1 :] if t.event_type == "TRADE" and t.side == o.side and o.price_ticks * o.side > t.price_ticks * t.side), None)
                want += [(o.symbol, o.sequence_number, o.quantity, hit.sequence_number)] if hit else []
    assert run("price_through_fills", spark, sf, "symbol", "order_seq", "quantity", "trade_seq") == sorted(want)
    last = {r.symbol: max(x.timestamp_ns for x in stream if x.symbol == r.symbol) for r in stream}
    stale = [(f"{r.symbol}:{r.sequence_number}", last[r.symbol] - r.timestamp_ns) for r in adds if last[r.symbol] - r.timestamp_ns > 10 * DAY]
    assert run("stale_quotes", spark, sf, "order_id", "age_ns") == sorted(stale)
    inv = defaultdict(int)
    for r in fills(spark, sf).collect():
        inv[r.symbol] += r.side * r.quantity
    side = lambda k, s: sum(r.quantity for r in adds if r.symbol == k and r.side == s)
    exposure = [(k, v + side(k, 1), v - side(k, -1), side(k, 1) + side(k, -1), sum(r.symbol == k for r in adds)) for k, v in inv.items()]
    assert run("worst_case_exposure", spark, sf, "symbol", "worst_long", "worst_short", "open_quantity", "open_orders") == sorted(exposure)
