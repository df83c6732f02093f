"""The kernel against published run figures and hand-made paths."""

from decimal import Decimal

import pytest

from quotewright.schema import ADD, ASK, BID, CANCEL, RESET, SNAPSHOT, TRADE
from quotewright.simulation import sessions
from quotewright.simulation.config import Config, ConfigError, Fees, Latency, Limits, Quoting, from_dict, from_json
from quotewright.simulation.kernel import COMMAND, DATA, DECIDE, MARKET, Account, Agenda, Book, CausalityError, Order, Queues, Risk, Session
from quotewright.sources.synthetic import Settings, stream, synthetic_events

DEMO = Config(latency=Latency(100_000, 0, 150_000, 0, 150_000, 0, 100_000, 0), fees=Fees("0", "0.0002", "0.0003", "0"), limits=Limits(max_messages_per_second=500, prohibit_new_quotes_last_ns=100_000_000))
#: Settings of three runs, and their published fills, fill rate, mean absolute inventory, share near the limit, largest
#: drawdown, risk blocks, venue rejects and agenda events per market event.
PUBLISHED = [
    ({"name": "fixed_spread"}, (365, 0.301, 54.15, 0.260, 27.18, 26, 8, 4.17)),
    ({"name": "inventory_aware", "inventory_penalty_ticks": 3.0}, (314, 0.239, 28.83, 0.0, 13.68, 0, 26, 4.24)),
    ({"name": "microprice", "inventory_penalty_ticks": 20.0, "imbalance_coefficient_ticks": 0.0, "volatility_multiplier": 0.4}, (35, 0.036, 17.97, 0.0, 18.34, 0, 95, 3.98)),
]


def figures(r):
    return (r.fills, round(r.fill_rate, 3), round(r.mean_abs_inventory, 2), round(r.near_limit_fraction, 3), round(r.max_drawdown, 2), r.risk_blocked, r.venue_rejected, round(r.agenda_per_event, 2))


def test_published_runs(spark):
    cases = {q["name"]: DEMO.with_(quoting=q) for q, _ in PUBLISHED}
    long = sessions.run_cases(synthetic_events(spark, Settings(), [7]), cases).cache()
    got = {r.case_name: figures(r) for r in sessions.results(long).collect()}
    assert got == {q["name"]: want for q, want in PUBLISHED}
    f = sessions.table(long, "fills")
    assert f.where("send_timestamp_ns > exchange_arrival_timestamp_ns or exchange_arrival_timestamp_ns > exchange_fill_timestamp_ns or strategy_notification_timestamp_ns < exchange_fill_timestamp_ns").count() == 0
    assert sessions.table(long, "orders").groupBy("case_name", "order_id").agg({"remaining_quantity": "min"}).where("`min(remaining_quantity)` < 0").count() == 0


def test_latency_sensitivity(spark):
    micro = DEMO.with_(quoting=PUBLISHED[2][0])
    cases = {str(x): sessions.latency_scaled(micro, x) for x in (0.5, 2.0)}
    long = sessions.run_cases(synthetic_events(spark, Settings(), [7]), cases)
    got = {r.case_name: (round(r.mean_abs_inventory, 2), round(r.fill_rate, 3)) for r in sessions.results(long).collect()}
    assert got == {"0.5": (17.97, 0.036), "2.0": (27.43, 0.023)}


def order(client, side, price, quantity, t=0, post_only=False, rest=True):
    return Order(client, "s", side, price, quantity, t, post_only, rest)


def venue(**fees):
    s = Session(Config(fees=Fees(**fees)), [(0, 0, RESET, None, 0, 0)])
    s.market((0, 0, RESET, None, 0, 0))
    return s


def test_golden_path():
    s = venue(maker_rebate_per_unit="0.001")
    for i, e in enumerate([(ADD, BID, 100, 10), (ADD, ASK, 102, 10)]):
        s.market((i, i, *e))
    s.take_effect(*s.arrive(order("a", BID, 100, 5, 2, True), 2))
    o = s.by_client["a"]
    assert o.position == (10, 0, 0)
    s.take_effect(*s.market((3, 3, CANCEL, BID, 100, 5)))
    assert o.position == (5, 0, 0)
    s.take_effect(*s.market((4, 4, ADD, BID, 100, 10)))
    assert o.position == (5, 0, 10)
    s.take_effect(*s.market((5, 5, TRADE, BID, 100, 8)))
    s.take_effect(*s.market((6, 6, TRADE, BID, 100, 2)))
    assert [f[2] for f in s.fill_rows] == [3, 2] and (s.account.inventory, s.account.cash_ticks) == (5, -500)
    gross, net = s.account.value(Decimal(101))
    assert (gross, s.account.rebates, net) == (Decimal("0.05"), Decimal("0.005"), Decimal("0.055"))


def test_sweep_post_only_and_expiry():
    s = venue(taker_fee_per_unit="0.001")
    for i, e in enumerate([(SNAPSHOT, BID, 99, 5), (SNAPSHOT, ASK, 101, 5), (SNAPSHOT, ASK, 102, 7)]):
        s.market((1, i, *e))
    assert s.arrive(order("p", BID, 101, 1, 1, True), 1)[1][0]["reason"] == "post_only_would_cross"
    fills, reports = s.arrive(order("x", BID, 102, 10, 2), 2)
    assert [(f[2], f[1]) for f in fills] == [(101, 5), (102, 5)] and s.book.side[ASK] == {102: 2} and reports[-1]["status"] == "filled"
    fills, reports = s.arrive(order("y", BID, 102, 5, 3, rest=False), 3)
    assert len(fills) == 1 and reports[-1]["reason"] == "unfilled_remainder_not_resting" and s.by_client["y"].left == 3
    s.arrive(order("r", BID, 99, 1, 4), 4)
    assert s.arrive(order("z", ASK, 98, 1, 5), 5)[1][0]["reason"] == "self_trade_prevention"
    assert s.cancel(None, "none", 6)[1][0]["reason"] == "unknown_order" and s.cancel(None, "x", 6)[1][0]["reason"] == "order_not_live"


@pytest.mark.parametrize(("how", "want"), [("back_of_queue", (90, 0)), ("front_of_queue", (40, 50)), ("pro_rata", (60, 30))])
def test_queue_cancellation(how, want):
    q = Queues(how, True)
    q.join("o", (BID, 100), 10, 100)
    q.segment((BID, 100), None, 50)
    q.cut((BID, 100), 60, how)
    ahead, _, behind = q.position("o")
    assert (ahead, behind) == want


def test_shared_budget_and_price_through():
    q = Queues("back_of_queue", True)
    q.join("a", (BID, 100), 10, 100)
    q.segment((BID, 100), None, 5)
    q.join("b", (BID, 100), 10, 0)
    assert q.trade(BID, 100, 115) == [("a", 10, 100)] and q.position("b") == (0, 0, 0)
    assert q.trade(BID, 100, 5) == [("b", 5, 100)]
    assert q.trade(BID, 99, 1) == [("b", 5, 100)] and not q.at


def test_account():
    a = Account(Decimal("0.01"))
    a.fill(BID, 10, 100, Decimal(0), Decimal(0))
    a.fill(ASK, 4, 105, Decimal(0), Decimal(0))
    assert (a.inventory, a.average, a.cash_ticks, a.realized, a.value(Decimal(105))[0]) == (6, 100, -580, 20, Decimal("0.50"))
    a = Account(Decimal(1))
    for side, q, p in ((BID, 6, 100), (ASK, 8, 90)):
        a.fill(side, q, p, Decimal(0), Decimal(0))
    assert (a.inventory, a.average, a.realized) == (-2, 90, -60)
    a.fill(BID, 2, 85, Decimal(0), Decimal(0))
    assert (a.inventory, a.average, a.realized) == (0, None, -50)


def test_risk_order_and_edges():
    r = Risk(Config(limits=Limits(max_messages_per_second=2)), 0, 10**12)
    assert [r.message(t) for t in (0, 999_999_999, 999_999_999, 1_000_000_000)] == [True, True, False, True]
    r = Risk(DEMO, 0, 10**12)
    assert r.quote(order("a", BID, 1, 26), 0, 0, [], 1, 0) == "max_order_size"
    assert r.quote(order("a", BID, 1, 20), 0, 0, [(BID, 90)], 1, 0) == "max_open_quantity"
    assert r.quote(order("a", BID, 1, 1), 0, 0, [(BID, 1)] * 4, 1, 0) == "max_open_orders"
    assert r.quote(order("a", BID, 1, 10), 0, 95, [], 1, 0) == "position_limit"
    assert r.quote(order("a", BID, 1, 10), 0, 0, [], 0, 0) == "spread_too_narrow"
    assert r.quote(order("a", BID, 1, 10), 10**12 - 1, 0, [], 1, 0) == "session_end"
    r.watch(Decimal(-1000), 5)
    assert r.killed and r.quote(order("a", BID, 1, 10), 6, 0, [], 1, 0) == "kill_switch"
    r = Risk(Config(limits=Limits(max_drawdown="5")), 0, 10)
    for net in (10, 5):
        r.watch(Decimal(net), 0)
    assert r.killed and [x[1] for x in r.rows] == ["max_drawdown"]


def test_agenda_waves():
    a, seen = Agenda(), []

    def handle(time, phase, what):
        seen.append((what[0], a.now[1]))
        if what[0] == "m":
            a.add(time, DECIDE, ("later",))
            a.add(time, MARKET, ("again",))
            with pytest.raises(CausalityError):
                a.add(time - 1, DATA, ("past",))

    a.add(5, MARKET, ("m",))
    a.add(5, COMMAND, ("c",))
    a.run(handle)
    assert seen == [("m", 0), ("c", 0), ("later", 0), ("again", 1)]


def test_book_rules():
    b = Book()
    b.apply(ADD, BID, 100, 5)
    assert b.apply(ADD, ASK, 100, 1) == 0 and b.ignored == 1
    assert b.apply(CANCEL, BID, 100, 9) == 5 and b.clamped == 1 and b.bid is None


def test_session_end_and_reset():
    ev = list(stream(Settings(400), 3))
    liquid = Session(DEMO.with_(run={"session_end_policy": "liquidate"}), ev).run()
    assert not liquid.live
    held = Session(DEMO.with_(venue={"cancel_orders_on_reset": False}), ev).run()
    assert not any(r[6] == "market_reset" for r in held.order_rows)
    jitter = DEMO.with_(latency={"market_data_jitter_ns": 50_000, "order_entry_jitter_ns": 50_000})
    assert Session(jitter, ev).run().tables() == Session(jitter, ev).run().tables() != Session(DEMO, ev).run().tables()


def test_no_look_ahead():
    """Two futures that part at an event give the same actions up to it."""
    ev = list(stream(Settings(600), 3))
    cut = 450
    other = ev[:cut] + [(*e[:2], ADD, BID, 9_000, 1) for e in ev[cut:]]
    a, b = Session(DEMO, ev).run(), Session(DEMO, other).run()
    until = ev[cut][0]
    assert [r for r in a.strategy.rows if r[0] <= until] == [r for r in b.strategy.rows if r[0] <= until] != []


def test_config():
    assert from_json(DEMO.to_json()) == DEMO
    for bad in ({"quoting": {"name": "x"}}, {"nope": {}}, {"fees": {"maker_fee_per_unit": "-1"}}, {"limits": {"size": 1}}, {"run": {"timer_interval_ns": 0}}):
        with pytest.raises(ConfigError):
            from_dict(bad)
    g = sessions.grid(DEMO, ("fixed_spread", "microprice"), (0.5, 2.0), ("back_of_queue", "pro_rata"), ("0", "1"), ("none", "no_inventory"))
    assert len(g) == 32 and g["microprice__no_inventory__0p5__pro_rata__0"].quoting == Quoting(name="microprice", inventory_penalty_ticks=0.0)
    assert sessions.latency_scaled(Config(latency=Latency(5)), 0.5).latency.market_data_ns == 2


def test_rules_see_broken_rows(spark, sf):
    """The rules of a run's tables hold over many rows, and each break is counted."""
    from pyspark.sql import functions as F

    from quotewright.plans import simulation_queries as q
    from quotewright.plans.bindings import l2
    from quotewright.sources.shared import written

    got = q.kernel_rules(spark, "/root/testdata/sf0.01").collect()
    assert got and all(r.n_broken == 0 for r in got)
    long = written(sessions.run_cases(l2(spark, "/root/testdata/sf0.01"), {"fixed_spread": q.SLOW}))
    t = q._with(long)
    assert all(t[k].count() > 10 for k in ("orders", "fills", "pnl", "quotes"))
    spoil = {"fills": {"price_ticks": F.col("price_ticks") + 1, "fee": F.col("fee") + 1}, "pnl": {"net_pnl": F.col("net_pnl") + 1, "inventory": F.col("inventory") + 1000}, "orders": {"remaining_quantity": F.col("remaining_quantity") - 1000}}
    for table, columns in spoil.items():
        for column, value in columns.items():
            bad = t[table].withColumn(column, value)
            rules = [c for n, _, c in q.ROW_RULES if n == table]
            assert bad.alias(table).where(~F.coalesce(F.expr(" and ".join(f"({c})" for c in rules)), F.lit(False))).count() > 0
