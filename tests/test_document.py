from statistics import fmean, pstdev

import pytest

from quotewright.operators.document import document
from quotewright.plans.simulation_queries import DEMO
from quotewright.simulation import sessions
from quotewright.sources.synthetic import Settings, synthetic_events


def test_document_against_plain_python(spark):
    horizons = [100_000_000, 1_000_000_000]
    long = sessions.run_cases(synthetic_events(spark, Settings(3_000), [7, 8]), {"a": DEMO, "b": DEMO.with_(quoting={"name": "microprice"})}).persist()
    docs = {(r.case_name, r.symbol): r for r in document(long, horizons).collect()}
    assert len(docs) == 4
    rows = {t: sessions.table(long, t).orderBy("row_no").collect() for t in ("fills", "market", "pnl", "orders", "risk_events", "quotes")}
    for (case, symbol), d in docs.items():
        f, m, p, o, risk, quotes = ([r for r in rows[t] if (r.case_name, r.symbol) == (case, symbol)] for t in ("fills", "market", "pnl", "orders", "risk_events", "quotes"))
        t = d.trading_activity
        assert t.submitted_orders == len({r.order_id for r in o}) and t.completed_fills == sum(r.new_status == "filled" for r in o)
        assert (t.fill_events, t.quote_messages, d.risk.event_count) == (len(f), len(quotes), len(risk))
        assert t.buy_volume - t.sell_volume == d.inventory.end_of_session == p[-1].inventory
        assert t.turnover == pytest.approx(sum(r.quantity * r.price_ticks for r in f) * 0.01)
        assert (d.inventory.mean, d.inventory.standard_deviation) == pytest.approx((fmean(r.inventory for r in p), pstdev(r.inventory for r in p)))
        mids = [(r.timestamp_ns, r.midpoint_ticks) for r in m if r.midpoint_ticks is not None]
        edges, capture = [], 0.0
        for r in f:
            at = [x for t_, x in mids if t_ <= r.exchange_fill_timestamp_ns]
            if at:
                edges.append(r.side * (at[-1] - r.price_ticks))
                capture += edges[-1] * r.quantity * 0.01
        assert d.execution_quality.realized_spread_ticks == pytest.approx(fmean(edges)) and d.attribution.spread_capture == pytest.approx(capture)
        assert d.attribution.inventory_mark_to_market == pytest.approx(p[-1].net_pnl - (capture - p[-1].fees + p[-1].rebates))
        for h in horizons:
            moves = [r.side * (after[0] - r.price_ticks) for r in f if (after := [x for t_, x in mids if t_ >= r.exchange_fill_timestamp_ns + h])]
            assert d.execution_quality.markout_ticks_by_horizon_ns[str(h)] == pytest.approx(fmean(moves))
        assert d.market_conditions.average_market_spread_ticks == pytest.approx(fmean(r.spread_ticks for r in m if r.spread_ticks is not None))
