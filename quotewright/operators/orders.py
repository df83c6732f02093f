"""Order life cycles, exposure and risk rules as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The transitions that an order may make.
ALLOWED = {
    "pending_arrival": ("live", "rejected"),
    "live": ("partially_filled", "filled", "cancelled", "expired"),
    "partially_filled": ("partially_filled", "filled", "cancelled", "expired"),
}
TERMINAL = ("filled", "cancelled", "rejected", "expired")


def illegal_transitions(transitions: DataFrame) -> DataFrame:
    """transitions (order_id, transition_id, new_status) whose status can't follow the order's one before."""
    spark = transitions.sparkSession
    pairs = spark.createDataFrame([(a, b) for a, bs in ALLOWED.items() for b in bs], "previous_status string, new_status string")
    prev = F.coalesce(F.lag("new_status").over(Window.partitionBy("order_id").orderBy("transition_id")), F.lit("pending_arrival"))
    return transitions.withColumn("previous_status", prev).join(F.broadcast(pairs), ["previous_status", "new_status"], "left_anti")  # a fixed table of some twenty rows


def average_fill_price(fills: DataFrame) -> DataFrame:
    """Per order: filled quantity, notional in ticks and their ratio."""
    return fills.groupBy("order_id").agg(F.sum("quantity").alias("filled_quantity"), F.sum(F.col("quantity") * F.col("price_ticks")).alias("notional_ticks")).withColumn("average_fill_price_ticks", F.col("notional_ticks") / F.col("filled_quantity"))


def worst_case_exposure(orders: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per symbol: inventory if every open bid, or every open ask, fills; open quantity and count."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("quantity"))), F.lit(0))
    open_ = orders.groupBy("symbol").agg(side(1).alias("_b"), side(-1).alias("_a"), F.sum("quantity").alias("_q"), F.count("*").alias("_n"))
    o = inventory.join(open_, "symbol", "left").fillna(0, ["_b", "_a", "_q", "_n"])
    return o.select("symbol", (F.col("inventory") + F.col("_b")).alias("worst_long"), (F.col("inventory") - F.col("_a")).alias("worst_short"), F.col("_q").alias("open_quantity"), F.col("_n").alias("open_orders"))


def pretrade_reason(limits: dict[str, float]) -> Column:
    """The first stateless rule a quote breaks, in the contract's order, or null.

    Columns: side, price_ticks, quantity, reduce_only, inventory, killed, in_session, open_bid, open_ask (quantities),
    open_orders, spread_ticks, volatility_ticks. An order that validly reduces inventory passes the kill switch and the
    position, spread and volatility rules.
    """
    q, side, inventory = F.col("quantity"), F.col("side"), F.col("inventory")
    reduces = F.col("reduce_only") & (inventory * side < 0) & (q <= F.abs(inventory))
    worst = F.when(side > 0, inventory + F.col("open_bid") + q).otherwise(-(inventory - F.col("open_ask") - q))
    return (
        F.when((q <= 0) | (F.col("price_ticks") <= 0) | (F.col("spread_ticks") < 0), "invalid_order")
        .when(F.col("reduce_only") & ~reduces, "invalid_order")
        .when(~reduces & F.col("killed"), "kill_switch")
        .when(~F.col("in_session"), "session_end")
        .when(q > limits["max_order_size"], "max_order_size")
        .when(F.col("open_bid") + F.col("open_ask") + q > limits["max_total_open_quantity"], "max_open_quantity")
        .when(F.col("open_orders") + 1 > limits["max_open_orders"], "max_open_orders")
        .when(~reduces & (worst > limits["max_abs_inventory"]), "position_limit")
        .when(~reduces & (F.col("spread_ticks") < limits["minimum_spread_ticks"]), "spread_too_narrow")
        .when(~reduces & (F.col("volatility_ticks") > limits["max_volatility_ticks"]), "volatility_too_high")
    )


def stale_quotes(quotes: DataFrame, now: Column, max_age_ns: int) -> DataFrame:
    """Quotes older than the limit; at the limit they are still good. One row per order."""
    return quotes.where(now - F.col("submitted_ns") > max_age_ns).dropDuplicates(["order_id"])
