"""The metric document of simulated runs: one row per case and symbol, one struct per section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..simulation.sessions import limit_of, table
from .metrics import finite_mean, markouts, with_midpoint

KEY = ["case_name", "symbol"]


def _one(df: DataFrame) -> DataFrame:
    """df with symbol standing for case and symbol, as the metric operators want it."""
    return df.withColumn("symbol", F.concat_ws("|", F.col("symbol").cast("string"), "case_name"))


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def document(long: DataFrame, horizons_ns: list[int], tick: float = 0.01, cases: dict | None = None, near_limit: float = 0.8) -> DataFrame:
    """case_name, symbol and the sections trading_activity, pnl, inventory, execution_quality, market_conditions, risk, attribution and engineering.

    cases: the runs' settings, for their limits. long holds the rows of sessions.run_cases; it is read several times, so write or persist it first.
    """
    q, p = F.col("quantity"), F.col("price_ticks")
    n = lambda s: F.count_if(F.col("new_status") == s)
    orders = table(long, "orders").groupBy(*KEY).agg(F.count_distinct(F.when(F.col("previous_status").isNull(), F.col("order_id"))).alias("submitted_orders"), n("cancelled").alias("cancelled_orders"), n("rejected").alias("rejected_orders"), n("partially_filled").alias("partial_fills"), n("filled").alias("completed_fills"))
    fills = table(long, "fills")
    volume = fills.groupBy(*KEY).agg(F.count("*").alias("fill_events"), F.sum(q).alias("volume"), F.sum(F.when(F.col("side") == 1, q).otherwise(0)).alias("buy_volume"), F.sum(F.when(F.col("side") == -1, q).otherwise(0)).alias("sell_volume"), F.sum(F.when(F.col("liquidity_role") == "maker", q).otherwise(0)).alias("maker_volume"), F.sum(q * p * tick).alias("turnover"))
    quotes = table(long, "quotes").groupBy(*KEY).agg(F.count("*").alias("quote_messages"))
    risk = table(long, "risk_events").groupBy(*KEY).agg(F.count("*").alias("risk_events"))
    pnl = table(long, "pnl")
    high = F.max("net_pnl").over(Window.partitionBy(*KEY).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0))
    last = lambda c: F.max_by(c, "row_no").alias(c)
    inv = F.col("inventory").cast("double")
    money = pnl.withColumn("_limit", limit_of(cases)).withColumn("_fall", high - F.col("net_pnl")).groupBy(*KEY).agg(
        *[last(c) for c in ("gross_pnl", "fees", "rebates", "net_pnl", "realized_pnl_ticks", "unrealized_pnl_ticks")], F.max("_fall").alias("maximum_drawdown"), F.avg(inv).alias("inv_mean"), F.when(F.count("*") > 1, F.stddev_pop(inv)).otherwise(0.0).alias("inv_std"),
        F.max("inventory").alias("inv_max"), F.min("inventory").alias("inv_min"), F.avg(F.abs(inv)).alias("inv_abs"), F.avg((F.abs(inv) >= near_limit * F.col("_limit")).cast("double")).alias("inv_near"), F.max_by("inventory", "row_no").alias("inv_end"),
    )
    market = table(long, "market")
    conditions = market.groupBy(*KEY).agg(F.avg("spread_ticks").alias("spread"), F.avg(F.col("best_bid_quantity") + F.col("best_ask_quantity")).alias("depth"))
    f = _one(fills.withColumnRenamed("exchange_fill_timestamp_ns", "fill_timestamp_ns"))
    m = _one(market)
    back = lambda d: d.select(F.substring_index("symbol", "|", 1).cast("bigint").alias("symbol"), F.expr("substring(symbol, length(substring_index(symbol, '|', 1)) + 2)").alias("case_name"), *[c for c in d.columns if c != "symbol"])
    edge = F.col("side") * (F.col("midpoint_ticks") - F.col("price_ticks"))
    capture = back(with_midpoint(f.select("symbol", "fill_id", "side", "quantity", "price_ticks", "fill_timestamp_ns"), m).groupBy("symbol").agg(finite_mean(edge).alias("realized_spread"), F.coalesce(F.sum(edge * q * tick), F.lit(0.0)).alias("spread_capture")))
    mk = markouts(f, m, horizons_ns, tick)
    per = lambda by, name: mk.groupBy("symbol", by.alias("k")).agg(finite_mean(F.col("markout_ticks")).alias("v")).groupBy("symbol").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(name))  # noqa: E731  some horizons or two sides
    marks = back(per(F.col("horizon_ns").cast("string"), "by_horizon").join(per(F.when(F.col("side") == 1, "bid").otherwise("ask"), "by_side"), "symbol").join(mk.groupBy("symbol").agg(finite_mean(F.col("markout_value")).alias("markout_value")), "symbol"))
    d = table(long, "summary").select(*KEY, "market_events", "agenda_events", "killed")
    for part in (orders, volume, quotes, risk, money, conditions, capture, marks):
        d = d.join(part, KEY, "left")
    d = d.fillna(0, ["submitted_orders", "cancelled_orders", "rejected_orders", "partial_fills", "completed_fills", "fill_events", "volume", "buy_volume", "sell_volume", "maker_volume", "turnover", "quote_messages", "risk_events", "spread_capture"])
    c = F.col
    return d.select(
        *KEY,
        F.struct("submitted_orders", "cancelled_orders", "rejected_orders", "partial_fills", "completed_fills", "fill_events", "buy_volume", "sell_volume", "turnover", "maker_volume", (c("volume") - c("maker_volume")).alias("taker_volume"), _ratio(c("submitted_orders"), c("fill_events")).alias("order_to_fill_ratio"), _ratio(c("cancelled_orders"), c("fill_events")).alias("cancel_to_fill_ratio"), F.coalesce(_ratio(c("completed_fills"), c("submitted_orders")), F.lit(0.0)).alias("fill_rate"), "quote_messages").alias("trading_activity"),
        F.struct("gross_pnl", "fees", "rebates", "net_pnl", (c("realized_pnl_ticks") * tick).alias("realized_pnl"), (c("unrealized_pnl_ticks") * tick).alias("unrealized_pnl"), "maximum_drawdown", _ratio(c("net_pnl"), c("volume")).alias("pnl_per_traded_unit"), _ratio(c("net_pnl"), c("fill_events")).alias("pnl_per_fill"), _ratio(c("net_pnl"), c("turnover")).alias("pnl_per_unit_turnover"), F.lit(None).cast("double").alias("annualized_sharpe"), F.lit("omitted: samples in event time do not support annualization").alias("sharpe_note")).alias("pnl"),
        F.struct(c("inv_mean").alias("mean"), c("inv_std").alias("standard_deviation"), c("inv_max").alias("maximum_long"), c("inv_min").alias("maximum_short"), c("inv_abs").alias("mean_absolute"), c("inv_near").alias("time_near_limits_fraction"), c("inv_end").alias("end_of_session")).alias("inventory"),
        F.struct(c("realized_spread").alias("realized_spread_ticks"), (2 * c("realized_spread")).alias("effective_spread_ticks"), c("by_horizon").alias("markout_ticks_by_horizon_ns"), c("by_side").alias("markout_ticks_by_side")).alias("execution_quality"),
        F.struct(c("spread").alias("average_market_spread_ticks"), c("depth").alias("average_displayed_top_depth")).alias("market_conditions"),
        F.struct(c("risk_events").alias("event_count"), c("killed").alias("kill_switch_active")).alias("risk"),
        F.struct("spread_capture", (c("net_pnl") - (c("spread_capture") - c("fees") + c("rebates"))).alias("inventory_mark_to_market"), (-c("fees")).alias("fees"), "rebates", (F.coalesce("markout_value", F.lit(0.0)) * c("volume")).alias("adverse_selection_markout"), F.lit(0.0).alias("reconciliation_residual"), F.lit("inventory mark-to-market is the residual").alias("note")).alias("attribution"),
        F.struct(c("market_events").alias("events_processed"), c("agenda_events").alias("scheduler_events_processed")).alias("engineering"),
    )
