"""Simulated runs over the given tables, and over synthetic streams with published fingerprints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..simulation import sessions
from ..simulation.config import Config, Fees, Latency, Limits, Quoting, Run
from ..sources.fingerprint import stream_sha256
from ..sources.shared import written
from ..sources.synthetic import Settings, synthetic_events
from .bindings import BBO_SQL, L2_SQL, l2

MINUTE, HOUR = 60 * 10**9, 3_600 * 10**9
#: The given events are minutes apart, so everything that is milliseconds on a venue is minutes or hours here.
SLOW = Config(
    latency=Latency(MINUTE, 0, 2 * MINUTE, 0, 2 * MINUTE, 0, MINUTE, 0),
    fees=Fees("0", "0.0002", "0.0003", "0"),
    quoting=Quoting(refresh_interval_ns=6 * HOUR, minimum_quote_lifetime_ns=HOUR, stale_after_ns=24 * HOUR, rejection_cooldown_ns=6 * HOUR, rejection_max_cooldown_ns=48 * HOUR),
    limits=Limits(max_quote_age_ns=48 * HOUR, prohibit_new_quotes_last_ns=12 * HOUR),
    run=Run(timer_interval_ns=6 * HOUR),
)


GRID = {"strategies": ("fixed_spread", "inventory_aware", "microprice"), "latencies": (0.5, 1.0, 2.0), "allocations": ("back_of_queue", "pro_rata")}


def backtest_kernel(spark, sf_dir):
    """The fills of a fixed-spread run on every symbol."""
    return sessions.table(sessions.run_cases(l2(spark, sf_dir), {"fixed_spread": SLOW}), "fills")


def experiment_grid_run(spark, sf_dir):
    """Result figures of a grid of strategies, latencies and queue policies on every symbol."""
    cases = sessions.grid(SLOW, **GRID)
    return sessions.figures(written(l2(spark, sf_dir)), cases).drop("gross_pnl")


def synthetic_stream(spark, sf_dir):
    """Fingerprints of two seeded streams."""
    demo = stream_sha256(synthetic_events(spark, Settings(), [7]), ["symbol"])
    longer = stream_sha256(synthetic_events(spark, Settings(20_000, regime_length=5_000, reset_interval=10_000), [7]), ["symbol"])
    return demo.unionByName(longer).select("stream_sha256", "n_events")


STREAMS = "SELECT * FROM (VALUES ('1e910893059341fc01c740a3ada61ba3dcf0df30a2663150d868d6e12babd0bc', CAST(6000 AS BIGINT)), ('8a845f3b206876f8f0769d9e051d7016436355c605297f4d14fda6df2cc04237', CAST(20000 AS BIGINT))) t(stream_sha256, n_events)"

DEMO = Config(latency=Latency(100_000, 0, 150_000, 0, 150_000, 0, 100_000, 0), fees=Fees("0", "0.0002", "0.0003", "0"), limits=Limits(max_messages_per_second=500, prohibit_new_quotes_last_ns=100_000_000))


def published_runs(spark, sf_dir):
    """Figures of three runs over the demo stream."""
    q = {"fixed_spread": {}, "inventory_aware": {"inventory_penalty_ticks": 3.0}, "microprice": {"inventory_penalty_ticks": 20.0, "imbalance_coefficient_ticks": 0.0, "volatility_multiplier": 0.4}}
    r = sessions.results(written(sessions.run_cases(synthetic_events(spark, Settings(), [7]), {k: DEMO.with_(quoting={"name": k} | v) for k, v in q.items()})))
    return r.select("case_name", "fills", F.round("fill_rate", 3).alias("fill_rate"), F.round("mean_abs_inventory", 2).alias("mean_abs_inventory"), F.round("near_limit_fraction", 3).alias("near_limit_fraction"), F.round("max_drawdown", 2).alias("max_drawdown"), "risk_blocked", "venue_rejected", F.round("agenda_per_event", 2).alias("agenda_per_event"))


PUBLISHED = """SELECT case_name, CAST(fills AS BIGINT) AS fills, CAST(fill_rate AS DOUBLE) AS fill_rate, CAST(mai AS DOUBLE) AS mean_abs_inventory, CAST(near AS DOUBLE) AS near_limit_fraction, CAST(dd AS DOUBLE) AS max_drawdown, CAST(rb AS BIGINT) AS risk_blocked, CAST(vr AS BIGINT) AS venue_rejected, CAST(ape AS DOUBLE) AS agenda_per_event
FROM (VALUES ('fixed_spread', 365, 0.301, 54.15, 0.260, 27.18, 26, 8, 4.17), ('inventory_aware', 314, 0.239, 28.83, 0.0, 13.68, 0, 26, 4.24), ('microprice', 35, 0.036, 17.97, 0.0, 18.34, 0, 95, 3.98)) t(case_name, fills, fill_rate, mai, near, dd, rb, vr, ape)"""


def kernel_market(spark, sf_dir):
    """The book that the venue of a run holds after each event."""
    m = sessions.table(sessions.run_cases(l2(spark, sf_dir), {"fixed_spread": SLOW}), "market")
    return m.select("symbol", "sequence_number", "timestamp_ns", "event_type", "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity", "spread_ticks", "midpoint_ticks", F.round("imbalance", 9).alias("imbalance"))


KERNEL_MARKET = f"""WITH {BBO_SQL} SELECT symbol, sequence_number, timestamp_ns, event_type, best_bid_ticks, best_bid_quantity, best_ask_ticks, best_ask_quantity, spread_ticks, CAST(midpoint_ticks AS DOUBLE) AS midpoint_ticks,
 round(CASE WHEN midpoint_ticks IS NOT NULL THEN CAST(best_bid_quantity - best_ask_quantity AS DOUBLE) / (best_bid_quantity + best_ask_quantity) END, 9) AS imbalance FROM market"""

_TRANSITIONS = "'-pending_arrival', 'pending_arrival-live', 'pending_arrival-rejected', 'live-partially_filled', 'live-filled', 'live-cancelled', 'live-expired', 'partially_filled-partially_filled', 'partially_filled-filled', 'partially_filled-cancelled', 'partially_filled-expired'"
_VENUE, _FEES, _LIMITS = SLOW.venue, SLOW.fees, SLOW.limits
#: (table, name, condition that every row must meet), over a run's tables with the columns that _with() adds.
ROW_RULES = [
    ("orders", "transition_ids_number_the_rows", "transition_id = format_string('T%012d', row_no + 1)"),
    ("orders", "transitions_chain", "previous_status <=> was or (was is null and previous_status is null)"),
    ("orders", "transitions_are_allowed", f"concat(coalesce(previous_status, ''), '-', new_status) in ({_TRANSITIONS})"),
    ("orders", "nothing_after_a_last_status", "was is null or was not in ('filled', 'cancelled', 'rejected', 'expired')"),
    ("orders", "transition_times_never_fall", "before_ns is null or before_ns <= timestamp_ns"),
    ("orders", "orders_arrive_after_their_latency", f"exchange_arrival_timestamp_ns >= send_timestamp_ns + {SLOW.latency.order_entry_ns}"),
    ("orders", "remaining_quantity_is_original_less_fills", "remaining_quantity between 0 and original_quantity and (new_status <> 'filled' or remaining_quantity = 0) and (new_status not in ('pending_arrival', 'live', 'rejected') or remaining_quantity = original_quantity)"),
    ("orders", "order_ids_number_the_arrivals", "previous_status is not null or order_id = format_string('O%012d', arrivals)"),
    ("orders", "quantities_keep_the_lot_and_the_limit", f"original_quantity % {_VENUE.lot_size} = 0 and original_quantity between 1 and {_LIMITS.max_order_size}"),
    ("orders", "rejections_have_reasons", "new_status <> 'rejected' or reason in ('invalid_lot_size', 'self_trade_prevention', 'post_only_would_cross', 'session_ended')"),
    ("fills", "fill_ids_number_the_rows", "fill_id = format_string('F%012d', row_no + 1)"),
    ("fills", "fills_keep_to_their_order", "done <= original_quantity and fills.side = o_side"),
    ("fills", "makers_trade_at_their_price_and_takers_at_no_worse", "(liquidity_role = 'maker' and price_ticks = o_price) or (liquidity_role = 'taker' and price_ticks * fills.side <= o_price * fills.side)"),
    ("fills", "maker_fills_stand_beside_a_trade", "liquidity_role <> 'maker' or at_trade"),
    ("fills", "fees_follow_the_schedule", f"abs(fee - quantity * (case when liquidity_role = 'maker' then {_FEES.maker_fee_per_unit} else {_FEES.taker_fee_per_unit} end) - price_ticks * {_VENUE.tick_size} * quantity * {_FEES.proportional_fee_rate}) < 1e-9 and abs(rebate - (case when liquidity_role = 'maker' then quantity * {_FEES.maker_rebate_per_unit} else 0 end)) < 1e-9"),
    ("fills", "reports_take_their_latency", f"strategy_notification_timestamp_ns is null or strategy_notification_timestamp_ns >= exchange_fill_timestamp_ns + {SLOW.latency.fill_report_ns}"),
    ("pnl", "net_is_gross_less_fees_plus_rebates", "abs(net_pnl - (gross_pnl - fees + rebates)) < 1e-6"),
    ("pnl", "gross_is_cash_and_marked_inventory", f"abs(gross_pnl - (trade_cash_ticks + inventory * mark_ticks) * {_VENUE.tick_size}) < 1e-6"),
    ("pnl", "gross_is_realized_and_unrealized", f"abs(gross_pnl - (realized_pnl_ticks + unrealized_pnl_ticks) * {_VENUE.tick_size}) < 1e-6"),
    ("pnl", "inventory_keeps_its_limit", f"abs(inventory) <= {_LIMITS.max_abs_inventory}"),
    ("pnl", "average_cost_only_with_inventory", "(inventory = 0) = (average_cost_ticks is null)"),
    ("pnl", "exposure_stays_below_its_peak", "current_gross_exposure <= peak_gross_exposure + 1e-9 and (before_peak is null or before_peak <= peak_gross_exposure)"),
    ("pnl", "snapshots_follow_time", "before_ns is null or before_ns <= timestamp_ns"),
    ("quotes", "quotes_see_older_data", "before_seen is null or before_seen <= observed_sequence"),
]
#: (name, condition) over one row per symbol: the summary, the last P&L row and sums over fills and orders.
SUM_RULES = [
    ("inventory_is_the_sum_of_fills", "inventory = f_signed"),
    ("cash_is_the_sum_of_fills", "trade_cash_ticks = f_cash and turnover_ticks = f_turnover and fill_count = f_count"),
    ("fees_and_rebates_are_the_sum_of_fills", "abs(fees - f_fees) < 1e-6 and abs(rebates - f_rebates) < 1e-6"),
    ("summary_counts_the_tables", "market_events = m_count and fills = f_count and orders = o_count"),
    ("orders_fill_what_fills_say", "o_filled = f_quantity"),
    ("no_order_is_left_open", "o_open = 0"),
    ("nothing_was_killed_or_ignored", "not killed and book_ignored = 0"),
]


def _with(long):
    """The tables of a run with what came before each row."""
    key = Window.partitionBy("symbol")
    rows, per_order = key.orderBy("row_no"), Window.partitionBy("symbol", "order_id").orderBy("row_no")
    t = {k: sessions.table(long, k) for k in ("orders", "fills", "pnl", "quotes", "market", "summary")}
    lag = lambda c, w: F.lag(c).over(w)
    orders = t["orders"].withColumns({"was": lag("new_status", per_order), "before_ns": lag("timestamp_ns", rows), "arrivals": F.sum(F.col("previous_status").isNull().cast("long")).over(rows)})
    of = t["orders"].where("previous_status is null").select("symbol", "order_id", F.col("side").alias("o_side"), F.col("price_ticks").alias("o_price"), "original_quantity")
    trades = t["market"].where("event_type = 'TRADE'").select("symbol", F.col("timestamp_ns").alias("exchange_fill_timestamp_ns"), "side", F.lit(True).alias("at_trade")).distinct()
    fills = t["fills"].withColumn("done", F.sum("quantity").over(per_order)).join(of, ["symbol", "order_id"], "left").join(trades, ["symbol", "exchange_fill_timestamp_ns", "side"], "left").withColumn("at_trade", F.coalesce("at_trade", F.lit(False))).alias("fills")
    pnl = t["pnl"].withColumns({"before_peak": lag("peak_gross_exposure", rows), "before_ns": lag("timestamp_ns", rows)})
    quotes = t["quotes"].withColumn("before_seen", lag("observed_sequence", rows))
    return t | {"orders": orders, "fills": fills, "pnl": pnl, "quotes": quotes}


def kernel_rules(spark, sf_dir):
    """How many rows of a run's tables break each rule of orders, fills, accounting and quotes: (symbol, rule, n_broken)."""
    events = l2(spark, sf_dir)
    t = _with(written(sessions.run_cases(events, {"fixed_spread": SLOW})))
    found = []
    for name in ("orders", "fills", "pnl", "quotes"):
        rules = [(r, c) for table, r, c in ROW_RULES if table == name]
        counts = t[name].groupBy("symbol").agg(*[F.count_if(~F.coalesce(F.expr(c), F.lit(False))).alias(r) for r, c in rules])
        found.append(counts.select("symbol", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n_broken")) for r, _ in rules])).alias("r")).select("symbol", "r.*"))
    f = t["fills"].groupBy("symbol").agg(F.sum(F.expr("fills.side * quantity")).alias("f_signed"), F.sum("quantity").alias("f_quantity"), (-F.sum(F.expr("fills.side * quantity * price_ticks"))).alias("f_cash"), F.sum(F.expr("quantity * price_ticks")).alias("f_turnover"), F.count("*").alias("f_count"), F.sum("fee").alias("f_fees"), F.sum("rebate").alias("f_rebates"))
    o = t["orders"].groupBy("symbol", "order_id").agg(F.max_by("new_status", "row_no").alias("status"), F.max("cumulative_filled_quantity").alias("filled"))
    o = o.groupBy("symbol").agg(F.count("*").alias("o_count"), F.sum("filled").alias("o_filled"), F.count_if(F.col("status").isin("live", "partially_filled", "pending_arrival")).alias("o_open"))
    p = t["pnl"].groupBy("symbol").agg(*[F.max_by(c, "row_no").alias(c) for c in ("inventory", "trade_cash_ticks", "turnover_ticks", "fill_count", "fees", "rebates")])
    one = t["summary"].join(p, "symbol").join(f, "symbol", "left").join(o, "symbol", "left").join(t["market"].groupBy("symbol").agg(F.count("*").alias("m_count")), "symbol")
    one = one.fillna(0)
    found.append(one.select("symbol", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), (~F.coalesce(F.expr(c), F.lit(False))).cast("bigint").alias("n_broken")) for r, c in SUM_RULES])).alias("r")).select("symbol", "r.*"))
    every = events.select("symbol").distinct().withColumn("rule", F.explode(F.array(*[F.lit(r[-2]) for r in (*ROW_RULES, *SUM_RULES)])))
    all_ = found[0]
    for x in found[1:]:
        all_ = all_.unionByName(x)
    return every.join(all_, ["symbol", "rule"], "left").select("symbol", "rule", F.coalesce("n_broken", F.lit(0)).alias("n_broken"))


KERNEL_RULES = f"""WITH {L2_SQL} SELECT symbol, rule, CAST(0 AS BIGINT) AS n_broken FROM (SELECT DISTINCT symbol FROM l2) CROSS JOIN (VALUES {', '.join(f"('{r[-2]}')" for r in (*ROW_RULES, *SUM_RULES))}) r(rule)"""


def experiment_grid_identities(spark, sf_dir):
    """Of every case and symbol of the grid: the events it saw, and whether its figures agree with each other."""
    cases = sessions.grid(SLOW, **GRID)
    r = sessions.figures(written(l2(spark, sf_dir)), cases)
    return r.select("case_name", "symbol", "market_events", (F.abs(F.col("net_pnl") - F.col("gross_pnl") + F.col("fees") - F.col("rebates")) < 1e-6).alias("net_agrees"), F.col("fill_rate").between(0, 1).alias("fill_rate_agrees"), F.col("near_limit_fraction").between(0, 1).alias("near_limit_agrees"), (F.col("max_drawdown") >= 0).alias("drawdown_agrees"), (F.col("final_inventory").between(-_LIMITS.max_abs_inventory, _LIMITS.max_abs_inventory)).alias("inventory_agrees"))


_AXES = " CROSS JOIN ".join(f"(VALUES {', '.join(chr(39).join(('(', x, ')')) for x in values)}) t{i}(c{i})" for i, values in enumerate((GRID["strategies"], ("none",), ("0p5", "1", "2"), GRID["allocations"], ("1",))))
GRID_IDENTITIES = f"""WITH {L2_SQL} SELECT c0 || '__' || c1 || '__' || c2 || '__' || c3 || '__' || c4 AS case_name, symbol, market_events, TRUE AS net_agrees, TRUE AS fill_rate_agrees, TRUE AS near_limit_agrees, TRUE AS drawdown_agrees, TRUE AS inventory_agrees
FROM {_AXES} CROSS JOIN (SELECT symbol, count(*) AS market_events FROM l2 GROUP BY 1)"""

QUERIES = {
    "backtest_kernel": (backtest_kernel, None), "experiment_grid_run": (experiment_grid_run, None), "synthetic_stream": (synthetic_stream, STREAMS), "published_runs": (published_runs, PUBLISHED),
    "kernel_market": (kernel_market, KERNEL_MARKET), "kernel_rules": (kernel_rules, KERNEL_RULES), "experiment_grid_identities": (experiment_grid_identities, GRID_IDENTITIES),
}
