"""Sessions that take events one by one and let rows go: equal to whole ones, and small at any length."""

import pytest

from quotewright.simulation.config import Config, Fees, Latency, Limits
from quotewright.simulation import sessions
from quotewright.simulation.kernel import Session, Tally, Tape, follows
from quotewright.sources.synthetic import Settings, stream, synthetic_events

DEMO = Config(latency=Latency(100_000, 0, 150_000, 0, 150_000, 0, 100_000, 0), fees=Fees("0", "0.0002", "0.0003", "0"), limits=Limits(max_messages_per_second=500, prohibit_new_quotes_last_ns=100_000_000))
KINDS = {
    "demo": {},
    "jitter": {"latency": {"market_data_jitter_ns": 50_000, "order_entry_jitter_ns": 90_000, "cancellation_jitter_ns": 140_000, "fill_report_jitter_ns": 99_000}},
    "no_latency": {"latency": {"market_data_ns": 0, "order_entry_ns": 0, "cancellation_ns": 0, "fill_report_ns": 0}},
    "slow_cancels": {"latency": {"cancellation_ns": 400_000_000, "fill_report_ns": 1}},
    "slow_reports": {"latency": {"fill_report_ns": 900_000_000}, "quoting": {"name": "inventory_aware"}},
    "liquidate": {"run": {"session_end_policy": "liquidate"}, "limits": {"max_loss": "1"}},
    "kept_on_reset": {"venue": {"cancel_orders_on_reset": False, "cancellation_allocation": "pro_rata"}, "quoting": {"name": "microprice"}},
    "few_messages": {"limits": {"max_messages_per_second": 2, "max_quote_age_ns": 300_000_000}},
}


@pytest.mark.parametrize("kind", KINDS)
def test_streamed_rows_are_those_of_the_whole_session(kind):
    events = list(stream(Settings(2_000, reset_interval=700), 3))
    config = DEMO.with_(**KINDS[kind])
    want = Session(config, events).run().tables()
    assert len(want["orders"]) > 3
    for every in (1, 97, 10**9):
        got = {t: {} for t in want}
        for table, i, row in Session(config, iter(events), (events[0][0], events[-1][0])).stream(every):
            assert i not in got[table]
            got[table][i] = row
        assert {t: [rows[i] for i in range(len(rows))] for t, rows in got.items()} == want


def test_a_session_holds_what_is_open_not_its_length():
    events = list(stream(Settings(4_000), 3))
    read, held = [0], []

    def one_by_one():
        for e in events:
            read[0] += 1
            yield e

    s = Session(DEMO, one_by_one(), (events[0][0], events[-1][0]))
    for n, _ in enumerate(s.stream(100)):
        if not n:
            assert read[0] <= 101
        lists = (s.market_rows, s.pnl_rows, s.fill_rows, s.order_rows, s.strategy.rows, s.risk.rows, s.orders, s.by_client, s.told, s.settled, s.cancelling, s.risk_sent, s.agenda.heap, s.wakes)
        held.append(max(map(len, lists)))
    assert s.arrivals > 500 and s.seen == 4_000
    assert max(held[len(held) // 2 :]) <= max(held[: len(held) // 2]) + 20 < 250


@pytest.mark.parametrize("kind", KINDS)
def test_tallies_beside_each_other_equal_the_tables(kind):
    events = list(stream(Settings(2_000, reset_interval=700), 3))
    span = (events[0][0], events[-1][0])
    configs = [DEMO.with_(**KINDS[kind]), DEMO.with_(**KINDS[kind]).with_(quoting={"name": "inventory_aware"}), DEMO.with_(quoting={"name": "microprice", "volatility_window": 9})]
    tape = Tape(events)
    run = [Tally(c, (), span, tape if follows(c) else None, 8.0) for c in configs]
    assert any(s.tape for s in run)
    for s in run:
        s.begin()
    items = list(tape)
    for at in range(0, len(items), 333):
        for s in run:
            s.advance([x if s.tape else (*x[:6], 0, 0, None, None, None) for x in items[at : at + 333]])
            assert not (s.market_rows or s.pnl_rows or s.order_rows or s.fill_rows)
    for c, s in zip(configs, run):
        s.finish()
        t = Session(c, events).run().tables()
        high, fall = float("-inf"), 0.0
        for r in t["pnl"]:
            high = max(high, r[8])
            fall = max(fall, high - r[8])
        last, n = t["pnl"][-1], len(t["pnl"])
        mean, near = sum(abs(r[2]) for r in t["pnl"]) / n, sum(abs(r[2]) >= 8.0 for r in t["pnl"]) / n
        orders = len({r[1] for r in t["orders"]}) or None
        filled = orders and sum(r[3] == "filled" for r in t["orders"])
        assert s.figures() == (*t["summary"][0], mean, near, fall, last[8], last[2], last[9], last[10], orders, filled, last[7])


def test_figures_of_a_grid_are_those_of_its_tables_in_few_tasks(spark):
    events = synthetic_events(spark, Settings(1_500), [3, 4])
    cases = sessions.grid(DEMO, ("fixed_spread", "microprice"), (0.5, 1.0, 2.0), ("back_of_queue", "pro_rata")) | {"liquidated": DEMO.with_(run={"session_end_policy": "liquidate"})}
    got = sessions.figures(events, cases).drop("gross_pnl")
    want = sessions.results(sessions.run_cases(events, cases).persist(), cases=cases)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() == 26
    plan = sessions.figures(events, cases)._jdf.queryExecution().executedPlan().toString()
    assert "from_json" not in plan and "case_name" in plan
    assert sessions.figures(events.where("false"), cases).columns == [*got.columns[:-2], "gross_pnl", *got.columns[-2:]]
