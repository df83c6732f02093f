"""Ex-post metrics: markouts, spread capture, volumes, inventory, P&L, regimes, drawdown, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import WIDTH, backward_asof, forward_asof
from .running import BUCKET, lagged, numbered, running_sums, with_halo

SECOND = 10**9


def finite_mean(x: Column) -> Column:
    """Mean of finite values; null if there is none."""
    return F.avg(F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))


def markouts(fills: DataFrame, market: DataFrame, horizons_ns: list[int], tick: float, width: int = WIDTH) -> DataFrame:
    """One row per fill and horizon: the first midpoint at or after the fill plus the horizon, and the move in the fill's favour."""
    wide = fills.withColumn("horizon_ns", F.explode(F.array(*[F.lit(h).cast("bigint") for h in horizons_ns])))
    target = F.col("fill_timestamp_ns") + F.col("horizon_ns")
    mids = market.where(F.col("midpoint_ticks").isNotNull())
    found = forward_asof(wide, mids, ["symbol"], target, ["timestamp_ns", "midpoint_ticks"], width)
    move = F.col("side") * (F.col("_found.midpoint_ticks") - F.col("price_ticks"))
    return found.select(
        "symbol", "fill_id", "side", "quantity", "liquidity_role", "fill_timestamp_ns", F.col("price_ticks").alias("fill_price_ticks"), "horizon_ns", target.alias("target_timestamp_ns"),
        F.col("_found.timestamp_ns").alias("future_timestamp_ns"), F.col("_found.midpoint_ticks").alias("future_midpoint_ticks"), move.alias("markout_ticks"), (move * F.col("quantity") * tick).alias("markout_value"), F.when(F.col("price_ticks") != 0, move / F.col("price_ticks") * 10_000).alias("markout_bps"),
    )


def with_midpoint(fills: DataFrame, market: DataFrame, width: int = WIDTH) -> DataFrame:
    """fills with the last midpoint at or before the fill, null if there is none."""
    mids = market.where(F.col("midpoint_ticks").isNotNull())
    return backward_asof(fills, mids, ["symbol"], F.col("fill_timestamp_ns"), ["midpoint_ticks"], width).withColumn("midpoint_ticks", F.col("_found.midpoint_ticks")).drop("_found")


def spread_capture(fills_with_mid: DataFrame, tick: float) -> DataFrame:
    """Per symbol: realized half spread, effective spread and value captured against the midpoint at the fill."""
    edge = F.col("side") * (F.col("midpoint_ticks") - F.col("price_ticks"))
    return fills_with_mid.groupBy("symbol").agg(finite_mean(edge).alias("realized_spread_ticks"), (2 * finite_mean(edge)).alias("effective_spread_ticks"), F.sum(edge * F.col("quantity") * tick).alias("spread_capture"))


def regimes(market: DataFrame) -> DataFrame:
    """market with midpoint_change and the spread, liquidity and volatility regimes against each symbol's own means.

    The change is against the last midpoint that was not null; means are over all of the symbol's events.
    """
    inside = Window.partitionBy("symbol", "epoch").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, -1)
    near = F.last("midpoint_ticks", ignorenulls=True).over(inside)
    ends = market.groupBy("symbol", "epoch").agg(F.max_by("midpoint_ticks", F.when(F.col("midpoint_ticks").isNotNull(), F.col("sequence_number"))).alias("_e"))
    far = ends.select("symbol", "epoch", F.last("_e", ignorenulls=True).over(Window.partitionBy("symbol").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)).alias("_far"))
    m = market.withColumn("_near", near).join(far, ["symbol", "epoch"], "left")
    before = F.coalesce("_near", "_far")
    m = m.withColumn("midpoint_change", F.coalesce(F.abs(F.col("midpoint_ticks") - before), F.lit(0.0))).withColumn("_depth", (F.col("best_bid_quantity") + F.col("best_ask_quantity")).cast("double"))
    means = m.groupBy("symbol").agg(F.avg("spread_ticks").alias("_ms"), F.avg("_depth").alias("_md"), F.avg("midpoint_change").alias("_mc"))
    return m.join(means, "symbol").withColumns(
        {
            "spread_regime": F.when(F.col("spread_ticks") > F.col("_ms"), "wide").otherwise("tight"),
            "liquidity_regime": F.when(F.col("_depth") >= F.col("_md"), "deep").otherwise("thin"),
            "volatility_regime": F.when(F.col("midpoint_change") > F.col("_mc"), "high").otherwise("low"),
        }
    ).drop("_near", "_far", "_depth", "_ms", "_md", "_mc")


def rolling_volatility(market: DataFrame, window: int, width: int = BUCKET) -> DataFrame:
    """Per event with a midpoint: population deviation of the last max(window, 2) midpoint differences; 0 while there are fewer than two.

    Rows with a midpoint are numbered and cut into cells of width rows; a cell has the rows before it that its first windows reach.
    """
    m = max(window, 2)
    d = numbered(market.where(F.col("midpoint_ticks").isNotNull()), ["symbol"], ["sequence_number"], "_n", "sequence_number", width)
    d = with_halo(d, F.col("_n"), max(width, m), m)
    order = Window.partitionBy("symbol", "_cell").orderBy("_n")
    d = d.withColumn("_d", F.col("midpoint_ticks") - F.lag("midpoint_ticks").over(order))
    frame = order.rowsBetween(-(m - 1), 0)
    d = d.withColumn("volatility_ticks", F.when(F.count("_d").over(frame) >= 2, F.stddev_pop("_d").over(frame)).otherwise(0.0))
    return d.where(~F.col("_halo")).drop("_d", "_n", "_cell", "_halo")


def inventory_path(fills: DataFrame) -> DataFrame:
    """fills with running inventory, trade cash (ticks), turnover (ticks) and count, per symbol in fill_id order."""
    signed, value = F.col("side") * F.col("quantity"), F.col("quantity") * F.col("price_ticks")
    return running_sums(fills, ["symbol"], "fill_id", {"inventory": signed, "trade_cash_ticks": -F.col("side") * value, "turnover_ticks": value, "fill_count": F.lit(1)})


def drawdown(pnl: DataFrame, value: str, from_zero: bool = False, width: int = BUCKET) -> DataFrame:
    """Per symbol the largest fall below the running high; from_zero also counts an initial loss.

    A bucket of fills is summed up by its high, its low and its own largest fall; of two in a row the largest fall is either's own or
    from the first's high to the second's low. So falls inside buckets are found apart, and one row a bucket is scanned.
    """
    rows = pnl.select("symbol", "fill_id", F.col(value).alias("_v")).withColumn("_b", F.floor(F.col("fill_id") / F.lit(width)).cast("bigint"))
    high = F.max("_v").over(Window.partitionBy("symbol", "_b").orderBy("fill_id").rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.withColumn("_f", high - F.col("_v")).groupBy("symbol", "_b").agg(F.max("_v").alias("high"), F.min("_v").alias("low"), F.max("_f").alias("fall"))
    before = F.max("high").over(Window.partitionBy("symbol").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    if from_zero:
        before = F.greatest(F.lit(0).cast("double"), before.cast("double"))
    return parts.withColumn("_across", before - F.col("low")).groupBy("symbol").agg(F.max(F.greatest("fall", "_across")).alias("max_drawdown"))


def message_counts(messages: DataFrame, span_ns: int = SECOND, width_ns: int | None = None) -> DataFrame:
    """messages with n_window: how many of the symbol's messages lie in (t - span, t]. Each cell of time (64 spans, unless given) is counted alone, with the span before it."""
    cells = with_halo(messages, F.col("timestamp_ns"), max(width_ns or 64 * span_ns, span_ns), span_ns - 1)
    frame = Window.partitionBy("symbol", "_cell").orderBy("timestamp_ns").rangeBetween(-(span_ns - 1), 0)
    return cells.withColumn("n_window", F.count("*").over(frame)).where(~F.col("_halo")).drop("_cell", "_halo")


REGIMES = ("spread_regime", "liquidity_regime", "volatility_regime")


def pnl_by_regime(pnl: DataFrame, market: DataFrame, value: str, columns: tuple[str, ...] = REGIMES, width: int = WIDTH) -> DataFrame:
    """symbol, regime (which column), label, pnl_change and n: changes of value by the regimes of the last market row at or before each.

    P&L rows follow each other by (timestamp_ns, value); those without a finite value are passed over. Among market rows of one time
    the last sequence number counts, whatever it holds: a null label takes no change. Rows before any market row are left out, but
    the next change is still against them.
    """
    finite = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    rows = pnl.where(finite & F.col("timestamp_ns").isNotNull()).select("symbol", "timestamp_ns", F.col(value).alias("_value"))
    rows = lagged(rows, ["symbol"], ["timestamp_ns", "_value"], F.col("_value"), "_last", "timestamp_ns", width)
    rows = rows.select("symbol", "timestamp_ns", F.coalesce(F.col("_value") - F.col("_last"), F.lit(0.0)).alias("_change"))
    states = market.where(F.col("timestamp_ns").isNotNull()).select("symbol", "timestamp_ns", "sequence_number", *columns)
    found = backward_asof(rows, states, ["symbol"], F.col("timestamp_ns"), list(columns), width).where(F.col("_found").isNotNull())
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("regime"), F.col(f"_found.{c}").alias("label")) for c in columns]))
    each = found.select("symbol", "_change", each.alias("r")).select("symbol", "_change", "r.*").where("label is not null")
    return each.groupBy("symbol", "regime", "label").agg(F.sum("_change").alias("pnl_change"), F.count("*").alias("n"))
