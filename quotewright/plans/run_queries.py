"""Queries over fills, orders and runs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import quotes as Q
from ..operators import experiments, metrics, orders
from ..operators.selection import nearest_ranks
from ..sources.shared import written
from .bindings import BBO_SQL, L2_SQL, l2, table
from .book_queries import REGIME_SQL, market

MINUTE, HOUR, DAY = 60 * 10**9, 3_600 * 10**9, 86_400 * 10**9
HORIZONS, TICK = [10 * MINUTE, HOUR, DAY], 0.01
r9 = lambda c: F.round(c, 9).alias(c)


def fills(spark, sf_dir):
    """TRADE rows as fills: every fourth by a taker."""
    return fills_of(l2(spark, sf_dir))


def fills_of(events):
    return events.where("event_type = 'TRADE'").select("symbol", F.col("sequence_number").alias("fill_id"), "side", "price_ticks", "quantity", F.col("timestamp_ns").alias("fill_timestamp_ns"), F.when(F.col("sequence_number") % 4 == 0, "taker").otherwise("maker").alias("liquidity_role"))


_FILLS = "fl AS (SELECT symbol, sequence_number AS fill_id, side, price_ticks, quantity, timestamp_ns AS fill_timestamp_ns, CASE WHEN sequence_number % 4 = 0 THEN 'taker' ELSE 'maker' END AS liquidity_role FROM l2 WHERE event_type = 'TRADE')"
FILL_SQL = f"{L2_SQL}, {_FILLS}"


def _markouts(spark, sf_dir):
    return metrics.markouts(fills(spark, sf_dir), market(spark, sf_dir), HORIZONS, TICK)


def markouts_forward_asof(spark, sf_dir):
    m = _markouts(spark, sf_dir)
    return m.select("symbol", "fill_id", "horizon_ns", "target_timestamp_ns", "future_timestamp_ns", "future_midpoint_ticks", "markout_ticks", r9("markout_value"), r9("markout_bps"))


MARKOUT_SQL = f"""{BBO_SQL}, {_FILLS}, mids AS (SELECT symbol, timestamp_ns, sequence_number, CAST(midpoint_ticks AS DOUBLE) AS mid FROM market WHERE midpoint_ticks IS NOT NULL),
 tg AS (SELECT f.*, h.h AS horizon_ns, f.fill_timestamp_ns + h.h AS target_timestamp_ns FROM fl f CROSS JOIN (VALUES ({HORIZONS[0]}), ({HORIZONS[1]}), ({HORIZONS[2]})) h(h)),
 u AS (SELECT symbol, target_timestamp_ns AS t, 0 AS kind, 0 AS seq, fill_id, horizon_ns, side, price_ticks, quantity, target_timestamp_ns, NULL::DOUBLE AS mid, NULL::BIGINT AS ts FROM tg
  UNION ALL SELECT symbol, timestamp_ns, 1, sequence_number, NULL, NULL, NULL, NULL, NULL, NULL, mid, timestamp_ns FROM mids),
 f2 AS (SELECT *, first_value(mid IGNORE NULLS) OVER w AS fm, first_value(ts IGNORE NULLS) OVER w AS ft FROM u WINDOW w AS (PARTITION BY symbol ORDER BY t, kind, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 mk AS (SELECT symbol, fill_id, side, quantity, price_ticks, horizon_ns, target_timestamp_ns, ft AS future_timestamp_ns, fm AS future_midpoint_ticks, side * (fm - price_ticks) AS markout_ticks FROM f2 WHERE kind = 0)"""
MARKOUTS = f"WITH {MARKOUT_SQL} SELECT symbol, fill_id, horizon_ns, target_timestamp_ns, future_timestamp_ns, future_midpoint_ticks, markout_ticks, round(markout_ticks * quantity * CAST({TICK} AS DOUBLE), 9) AS markout_value, round(markout_ticks / price_ticks * 10000, 9) AS markout_bps FROM mk"


def markout_by_horizon(spark, sf_dir):
    return _markouts(spark, sf_dir).groupBy("horizon_ns").agg(F.count("markout_ticks").alias("n"), F.round(metrics.finite_mean(F.col("markout_ticks")), 6).alias("mean_markout_ticks")).withColumn("label", Q.horizon_label(F.col("horizon_ns")))


BY_HORIZON = f"WITH {MARKOUT_SQL} SELECT horizon_ns, count(markout_ticks) AS n, round(avg(markout_ticks), 6) AS mean_markout_ticks, (horizon_ns // 1000000000) || 's' AS label FROM mk GROUP BY 1"


def markout_by_side(spark, sf_dir):
    side = F.when(F.col("side") == 1, "bid").otherwise("ask").alias("side_name")
    return _markouts(spark, sf_dir).groupBy("horizon_ns", side).agg(F.round(metrics.finite_mean(F.col("markout_ticks")), 6).alias("mean_markout_ticks"))


BY_SIDE = f"WITH {MARKOUT_SQL} SELECT horizon_ns, CASE WHEN side = 1 THEN 'bid' ELSE 'ask' END AS side_name, round(avg(markout_ticks), 6) AS mean_markout_ticks FROM mk GROUP BY 1, 2"


def fill_midpoint_backward_asof(spark, sf_dir):
    return metrics.with_midpoint(fills(spark, sf_dir), market(spark, sf_dir)).select("symbol", "fill_id", "midpoint_ticks")


BACK_SQL = f"""{BBO_SQL}, {_FILLS}, u AS (SELECT symbol, fill_timestamp_ns AS t, 1 AS kind, 0 AS seq, fill_id, side, price_ticks, quantity, NULL::DOUBLE AS mid FROM fl
 UNION ALL SELECT symbol, timestamp_ns, 0, sequence_number, NULL, NULL, NULL, NULL, CAST(midpoint_ticks AS DOUBLE) FROM market WHERE midpoint_ticks IS NOT NULL),
 bk AS (SELECT * FROM (SELECT *, last_value(mid IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t, kind, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS midpoint_ticks FROM u) WHERE kind = 1)"""
BACKWARD = f"WITH {BACK_SQL} SELECT symbol, fill_id, midpoint_ticks FROM bk"


def spread_capture_attribution(spark, sf_dir):
    """Spread capture, fees and rebates, and what the net P&L leaves unexplained."""
    f = metrics.with_midpoint(fills(spark, sf_dir), market(spark, sf_dir))
    fee, rebate = Q.costs(F.col("quantity"), F.col("price_ticks"), F.col("liquidity_role"), "0.01", "0.01", "0.002", "0.03", "0.001")
    cap = metrics.spread_capture(f, TICK)
    cost = f.groupBy("symbol").agg(F.sum(fee).cast("double").alias("fees"), F.sum(rebate).cast("double").alias("rebates"))
    return cap.join(cost, "symbol").select("symbol", *[F.round(c, 6).alias(c) for c in ("realized_spread_ticks", "effective_spread_ticks", "spread_capture", "fees", "rebates")], F.round(F.col("spread_capture") - F.col("fees") + F.col("rebates"), 6).alias("explained"))


CAPTURE = f"""WITH {BACK_SQL}, c AS (SELECT b.symbol, avg(b.side * (b.midpoint_ticks - b.price_ticks)) AS rs, sum(b.side * (b.midpoint_ticks - b.price_ticks) * b.quantity * CAST({TICK} AS DOUBLE)) AS sc FROM bk b GROUP BY 1),
 k AS (SELECT symbol, CAST(sum(CASE WHEN liquidity_role = 'maker' THEN 0.01 ELSE 0.03 END * quantity + quantity * price_ticks * 0.01 * 0.001) AS DOUBLE) AS fees, CAST(sum(CASE WHEN liquidity_role = 'maker' THEN 0.002 ELSE 0 END * quantity) AS DOUBLE) AS rebates FROM fl GROUP BY 1)
SELECT symbol, round(rs, 6) AS realized_spread_ticks, round(2 * rs, 6) AS effective_spread_ticks, round(sc, 6) AS spread_capture, round(fees, 6) AS fees, round(rebates, 6) AS rebates, round(sc - fees + rebates, 6) AS explained FROM c JOIN k USING (symbol)"""


def fill_volume_turnover(spark, sf_dir):
    f = fills(spark, sf_dir)
    q = F.col("quantity")
    s = lambda c: F.coalesce(F.sum(F.when(c, q)), F.lit(0))
    return f.groupBy("symbol").agg(F.count("*").alias("fill_count"), F.sum(q).alias("total_volume"), s(F.col("side") == 1).alias("buy_volume"), s(F.col("side") == -1).alias("sell_volume"), s(F.col("liquidity_role") == "maker").alias("maker_volume"), (F.sum(q) - s(F.col("liquidity_role") == "maker")).alias("taker_volume"), F.sum(q * F.col("price_ticks")).alias("turnover_ticks"))


VOLUME = f"""WITH {FILL_SQL} SELECT symbol, count(*) AS fill_count, CAST(sum(quantity) AS BIGINT) AS total_volume, CAST(sum(CASE WHEN side = 1 THEN quantity ELSE 0 END) AS BIGINT) AS buy_volume, CAST(sum(CASE WHEN side = -1 THEN quantity ELSE 0 END) AS BIGINT) AS sell_volume,
 CAST(sum(CASE WHEN liquidity_role = 'maker' THEN quantity ELSE 0 END) AS BIGINT) AS maker_volume, CAST(sum(CASE WHEN liquidity_role = 'taker' THEN quantity ELSE 0 END) AS BIGINT) AS taker_volume, CAST(sum(quantity * price_ticks) AS BIGINT) AS turnover_ticks FROM fl GROUP BY 1"""


def inventory_path(spark, sf_dir):
    return metrics.inventory_path(fills(spark, sf_dir)).select("symbol", "fill_id", "inventory", "trade_cash_ticks", "turnover_ticks", "fill_count")


PATH_SQL = f"""{FILL_SQL}, ip AS (SELECT symbol, fill_id, fill_timestamp_ns, CAST(sum(side * quantity) OVER w AS BIGINT) AS inventory, CAST(sum(-side * quantity * price_ticks) OVER w AS BIGINT) AS trade_cash_ticks,
 CAST(sum(quantity * price_ticks) OVER w AS BIGINT) AS turnover_ticks, count(*) OVER w AS fill_count FROM fl WINDOW w AS (PARTITION BY symbol ORDER BY fill_id))"""
PATH = f"WITH {PATH_SQL} SELECT symbol, fill_id, inventory, trade_cash_ticks, turnover_ticks, fill_count FROM ip"


def inventory_stats(spark, sf_dir):
    p = metrics.inventory_path(fills(spark, sf_dir))
    i = F.col("inventory")
    return p.groupBy("symbol").agg(F.max(i).alias("max_inventory"), F.min(i).alias("min_inventory"), F.round(F.avg(F.abs(i)), 6).alias("mean_abs_inventory"), F.round(F.when(F.count("*") > 1, F.stddev_pop(i)).otherwise(0.0), 6).alias("inventory_std"), F.max_by(i, F.col("fill_id")).alias("final_inventory"))


STATS = f"""WITH {PATH_SQL} SELECT symbol, max(inventory) AS max_inventory, min(inventory) AS min_inventory, round(avg(abs(inventory)), 6) AS mean_abs_inventory, round(CASE WHEN count(*) > 1 THEN stddev_pop(CAST(inventory AS DOUBLE)) ELSE 0.0 END, 6) AS inventory_std,
 max_by(inventory, fill_id) AS final_inventory FROM ip GROUP BY 1"""


def near_limit_fraction(spark, sf_dir):
    p = metrics.inventory_path(fills(spark, sf_dir))
    return p.groupBy("symbol").agg(F.round(F.avg((F.abs("inventory") >= 0.8 * 200).cast("int")), 9).alias("near_limit_fraction"))


NEAR = f"WITH {PATH_SQL} SELECT symbol, round(avg(CASE WHEN abs(inventory) >= 160 THEN 1.0 ELSE 0.0 END), 9) AS near_limit_fraction FROM ip GROUP BY 1"


def _pnl(spark, sf_dir):
    return pnl_of(written(market(spark, sf_dir)))


def pnl_of(m):
    """The fills of a market table, marked at the last midpoint; the table is read several times."""
    p = metrics.inventory_path(written(metrics.with_midpoint(fills_of(m), m)))
    return p.withColumn("gross_ticks", F.col("trade_cash_ticks") + F.col("inventory") * F.col("midpoint_ticks"))


def cash_pnl_marked(spark, sf_dir):
    return _pnl(spark, sf_dir).select("symbol", "fill_id", "inventory", "trade_cash_ticks", "midpoint_ticks", "gross_ticks")


PNL_SQL = f"""{BACK_SQL}, pp AS (SELECT symbol, fill_id, t AS fill_timestamp_ns, midpoint_ticks, CAST(sum(side * quantity) OVER w AS BIGINT) AS inventory, CAST(sum(-side * quantity * price_ticks) OVER w AS BIGINT) AS trade_cash_ticks FROM bk WINDOW w AS (PARTITION BY symbol ORDER BY fill_id)),
 pl AS (SELECT *, trade_cash_ticks + inventory * midpoint_ticks AS gross_ticks FROM pp)"""
PNL = f"WITH {PNL_SQL} SELECT symbol, fill_id, inventory, trade_cash_ticks, midpoint_ticks, gross_ticks FROM pl"


def drawdown_cummax(spark, sf_dir):
    return metrics.drawdown(_pnl(spark, sf_dir), "gross_ticks")


def risk_high_watermark(spark, sf_dir):
    return metrics.drawdown(_pnl(spark, sf_dir), "gross_ticks", True)


_DD = "WITH {p}, d AS (SELECT symbol, {h} - gross_ticks AS f FROM pl) SELECT symbol, max(f) AS max_drawdown FROM d GROUP BY 1"
_HIGH = "max(gross_ticks) OVER (PARTITION BY symbol ORDER BY fill_id)"


def _by_regime(m, p):
    r = metrics.pnl_by_regime(p, metrics.regimes(m), "gross_ticks")
    label = lambda c: F.when(F.col("regime") == c, F.col("label")).alias(c)
    return r.select("symbol", *[label(c) for c in metrics.REGIMES], F.round("pnl_change", 6).alias("pnl_change"), "n")


def pnl_by_regime(spark, sf_dir):
    """Changes of gross P&L by each regime at the last market row at or before the fill."""
    m = written(market(spark, sf_dir))
    return _by_regime(m, pnl_of(m).withColumnRenamed("fill_timestamp_ns", "timestamp_ns"))


def pnl_by_regime_equal_times(spark, sf_dir):
    """The same with all times cut to six hours, so that many rows share one: P&L follows by (time, value), the last market row counts."""
    m = written(market(spark, sf_dir))
    coarse = lambda c: F.expr(f"{c} - {c} % {6 * HOUR}")
    return _by_regime(m.withColumn("timestamp_ns", coarse("timestamp_ns")), pnl_of(m).withColumn("timestamp_ns", coarse("fill_timestamp_ns")))


_REGIME = f"""WITH {PNL_SQL}, {REGIME_SQL[len(BBO_SQL) + 2:]}, pv AS (SELECT symbol, fill_timestamp_ns - fill_timestamp_ns % {{cut}} AS t, CAST(gross_ticks AS DOUBLE) AS v FROM pl WHERE gross_ticks IS NOT NULL),
 pc AS (SELECT symbol, t, coalesce(v - lag(v) OVER (PARTITION BY symbol ORDER BY t, v), 0.0) AS change FROM pv),
 rs AS (SELECT symbol, timestamp_ns - timestamp_ns % {{cut}} AS t, spread_regime, liquidity_regime, volatility_regime FROM rg QUALIFY row_number() OVER (PARTITION BY symbol, t ORDER BY sequence_number DESC) = 1),
 c AS (SELECT pc.symbol, pc.change, rs.spread_regime, rs.liquidity_regime, rs.volatility_regime FROM pc ASOF JOIN rs ON pc.symbol = rs.symbol AND pc.t >= rs.t)
SELECT symbol, spread_regime, liquidity_regime, volatility_regime, round(CAST(sum(change) AS DOUBLE), 6) AS pnl_change, count(*) AS n FROM c GROUP BY GROUPING SETS ((symbol, spread_regime), (symbol, liquidity_regime), (symbol, volatility_regime))"""
BY_REGIME, BY_REGIME_EQUAL_TIMES = _REGIME.format(cut=1), _REGIME.format(cut=6 * HOUR)


def _transitions(spark, sf_dir):
    """orders as transitions: O live, P partially filled, F filled; some orders get an extra step that their status forbids."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", F.array(F.lit("live"))).when(F.col("o_orderstatus") == "P", F.array(F.lit("live"), F.lit("partially_filled"))).otherwise(F.array(F.lit("live"), F.lit("filled")))
    late = F.when(F.col("o_orderkey") % 10 == 0, F.concat(status, F.array(F.lit("live")))).otherwise(status)
    return o.select(F.col("o_orderkey").alias("order_id"), F.posexplode(late).alias("transition_id", "new_status"))


def illegal_transitions_anti_join(spark, sf_dir):
    t = orders.illegal_transitions(_transitions(spark, sf_dir))
    return t.select("order_id", F.col("transition_id").cast("bigint").alias("transition_id"), "previous_status", "new_status")


TRANSITION_SQL = """tr AS (SELECT o_orderkey AS order_id, unnest(range(len(s))) AS transition_id, unnest(s) AS new_status FROM (SELECT o_orderkey, list_concat(CASE o_orderstatus WHEN 'O' THEN ['live'] WHEN 'P' THEN ['live', 'partially_filled'] ELSE ['live', 'filled'] END,
 CASE WHEN o_orderkey % 10 = 0 THEN ['live'] ELSE CAST([] AS VARCHAR[]) END) AS s FROM orders))"""
ILLEGAL = f"""WITH {TRANSITION_SQL}, p AS (SELECT *, coalesce(lag(new_status) OVER (PARTITION BY order_id ORDER BY transition_id), 'pending_arrival') AS previous_status FROM tr)
SELECT order_id, transition_id, previous_status, new_status FROM p WHERE new_status = 'live' AND previous_status <> 'pending_arrival'"""


def order_activity_counts(spark, sf_dir):
    t = _transitions(spark, sf_dir)
    n = lambda s: F.count_if(F.col("new_status") == s)
    one = t.agg(F.count_distinct(F.when(F.col("transition_id") == 0, F.col("order_id"))).alias("submitted"), n("filled").alias("filled"), n("partially_filled").alias("partially_filled"), n("cancelled").alias("cancelled"))
    return one.withColumns({"fill_rate": F.coalesce(F.round(F.try_divide("filled", "submitted"), 9), F.lit(0.0)), "cancel_to_fill": F.round(F.try_divide("cancelled", "filled"), 9)})


ACTIVITY = f"""WITH {TRANSITION_SQL}, c AS (SELECT count(DISTINCT CASE WHEN transition_id = 0 THEN order_id END) AS submitted, CAST(count_if(new_status = 'filled') AS BIGINT) AS filled, CAST(count_if(new_status = 'partially_filled') AS BIGINT) AS partially_filled, CAST(count_if(new_status = 'cancelled') AS BIGINT) AS cancelled FROM tr)
SELECT *, round(filled / submitted, 9) AS fill_rate, round(cancelled / filled, 9) AS cancel_to_fill FROM c"""


def average_fill_price(spark, sf_dir):
    """Line items as fills of their orders, prices in cents per unit."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    f = l.select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").cast("bigint").alias("quantity"), F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("bigint").alias("price_ticks"))
    return orders.average_fill_price(f).withColumn("average_fill_price_ticks", F.round("average_fill_price_ticks", 6))


AVERAGE = """SELECT order_id, CAST(sum(q) AS BIGINT) AS filled_quantity, CAST(sum(q * p) AS BIGINT) AS notional_ticks, round(CAST(sum(q * p) AS DOUBLE) / CAST(sum(q) AS DOUBLE), 6) AS average_fill_price_ticks
FROM (SELECT l_orderkey AS order_id, CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) AS p FROM lineitem) GROUP BY 1"""


def _all_adds(spark, sf_dir):
    return l2(spark, sf_dir).where("event_type = 'ADD'")


_OPEN = "oo AS (SELECT * FROM l2 WHERE event_type = 'ADD')"


def worst_case_exposure(spark, sf_dir):
    """The exposure with every ADD as an open order."""
    inv = metrics.inventory_path(fills(spark, sf_dir)).groupBy("symbol").agg(F.max_by("inventory", "fill_id").alias("inventory"))
    return orders.worst_case_exposure(_all_adds(spark, sf_dir), inv)


EXPOSURE = f"""WITH {PATH_SQL}, {_OPEN}, i AS (SELECT symbol, max_by(inventory, fill_id) AS inventory FROM ip GROUP BY 1), o AS (SELECT symbol, sum(CASE WHEN side = 1 THEN quantity ELSE 0 END) AS b, sum(CASE WHEN side = -1 THEN quantity ELSE 0 END) AS a, sum(quantity) AS q, count(*) AS n FROM oo GROUP BY 1)
SELECT symbol, CAST(inventory + coalesce(b, 0) AS BIGINT) AS worst_long, CAST(inventory - coalesce(a, 0) AS BIGINT) AS worst_short, CAST(coalesce(q, 0) AS BIGINT) AS open_quantity, coalesce(n, 0) AS open_orders FROM i LEFT JOIN o USING (symbol)"""


def pretrade_first_reason(spark, sf_dir):
    """ADD rows as order requests against limits, with a context made from their sequence numbers."""
    n = F.col("sequence_number")
    e = l2(spark, sf_dir).where("event_type = 'ADD'")
    ctx = e.select("symbol", "sequence_number", "side", "price_ticks", "quantity", (n % 5 == 0).alias("reduce_only"), (n * 31 % 121 - 60).alias("inventory"), (n % 23 == 0).alias("killed"), (n % 29 != 0).alias("in_session"), (n * 7 % 90).alias("open_bid"), (n * 11 % 70).alias("open_ask"), (n % 12).alias("open_orders"), (n % 9).alias("spread_ticks"), (n * 13 % 40 / 10.0).alias("volatility_ticks"))
    reason = orders.pretrade_reason({"max_order_size": 40, "max_total_open_quantity": 140, "max_open_orders": 10, "max_abs_inventory": 120, "minimum_spread_ticks": 2, "max_volatility_ticks": 3.5})
    return ctx.select("symbol", "sequence_number", F.coalesce(reason, F.lit("accepted")).alias("reason"))


PRETRADE = f"""WITH {L2_SQL}, c AS (SELECT symbol, sequence_number, side, price_ticks, quantity, sequence_number % 5 = 0 AS ro, sequence_number * 31 % 121 - 60 AS inv, sequence_number % 23 = 0 AS killed, sequence_number % 29 <> 0 AS ses, sequence_number * 7 % 90 AS ob, sequence_number * 11 % 70 AS oa,
 sequence_number % 12 AS oc, sequence_number % 9 AS sp, sequence_number * 13 % 40 / CAST(10.0 AS DOUBLE) AS vol FROM l2 WHERE event_type = 'ADD'),
 d AS (SELECT *, ro AND inv * side < 0 AND quantity <= abs(inv) AS red, CASE WHEN side = 1 THEN inv + ob + quantity ELSE -(inv - oa - quantity) END AS worst FROM c)
SELECT symbol, sequence_number, CASE WHEN ro AND NOT red THEN 'invalid_order' WHEN NOT red AND killed THEN 'kill_switch' WHEN NOT ses THEN 'session_end' WHEN quantity > 40 THEN 'max_order_size' WHEN ob + oa + quantity > 140 THEN 'max_open_quantity' WHEN oc + 1 > 10 THEN 'max_open_orders'
 WHEN NOT red AND worst > 120 THEN 'position_limit' WHEN NOT red AND sp < 2 THEN 'spread_too_narrow' WHEN NOT red AND vol > 3.5 THEN 'volatility_too_high' ELSE 'accepted' END AS reason FROM d"""


def stale_quotes(spark, sf_dir):
    """ADD rows as open orders older than ten days at the symbol's last event."""
    q = _all_adds(spark, sf_dir).select("symbol", F.col("timestamp_ns").alias("submitted_ns"), F.col("sequence_number").alias("n"), F.concat_ws(":", "symbol", "sequence_number").alias("order_id"))
    last = l2(spark, sf_dir).groupBy("symbol").agg(F.max("timestamp_ns").alias("now_ns"))
    return orders.stale_quotes(q.join(last, "symbol"), F.col("now_ns"), 10 * DAY).select("order_id", "symbol", (F.col("now_ns") - F.col("submitted_ns")).alias("age_ns"))


STALE = f"WITH {L2_SQL}, {_OPEN}, m AS (SELECT symbol, max(timestamp_ns) AS now_ns FROM l2 GROUP BY 1) SELECT oo.symbol || ':' || sequence_number AS order_id, symbol, now_ns - timestamp_ns AS age_ns FROM oo JOIN m USING (symbol) WHERE now_ns - timestamp_ns > {10 * DAY}"


def group_mean_excl_null(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("v", F.when(F.col("l_quantity") > 5, F.col("l_discount")))  # noqa: E741
    return experiments.group_mean(l, "l_linenumber", "v").withColumn("mean", F.round("mean", 9))


GROUP_MEAN = "SELECT CAST(l_linenumber AS VARCHAR) AS group_key, round(avg(l_discount), 9) AS mean FROM lineitem WHERE l_quantity > 5 GROUP BY 1"


def experiment_grid_cross(spark, sf_dir):
    return experiments.grid(spark, strategy=["fixed", "inventory", "microprice"], latency_scale=["0.5", "1", "2"], queue_policy=["back", "front", "pro_rata"], fee_scale=["0", "1"])


GRID = """SELECT s AS strategy, l AS latency_scale, q AS queue_policy, f AS fee_scale, s || '__' || l || '__' || q || '__' || f AS case_name FROM (VALUES ('fixed'), ('inventory'), ('microprice')) a(s) CROSS JOIN (VALUES ('0.5'), ('1'), ('2')) b(l)
 CROSS JOIN (VALUES ('back'), ('front'), ('pro_rata')) c(q) CROSS JOIN (VALUES ('0'), ('1')) d(f)"""


def experiment_aggregate(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    s = experiments.summary(l, ["l_returnflag", "l_linestatus"], "l_quantity")
    return s.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(c) for c in ("mean", "median", "smallest", "largest")])


AGGREGATE = "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(median(l_quantity), 6) AS median, round(min(l_quantity), 6) AS smallest, round(max(l_quantity), 6) AS largest FROM lineitem GROUP BY 1, 2"


def percentile_nearest_rank(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return nearest_ranks(l, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95, "p05": 0.05})


PERCENTILE = "SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, quantile_disc(l_extendedprice, 0.05) AS p05 FROM lineitem GROUP BY 1"


def queue_policy_differs(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.avg("l_discount").alias("v"))
    return experiments.differs(g, ["l_linenumber"], "l_returnflag", "v").select(F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "n_policies", "differs")


DIFFERS = "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(DISTINCT l_returnflag) AS n_policies, count(DISTINCT l_returnflag) >= 2 AND max(v) - min(v) > 1e-12 AS differs FROM (SELECT l_linenumber, l_returnflag, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1"


def comparison_identity(spark, sf_dir):
    runs = l2(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n_events"), F.min("sequence_number").alias("first_sequence"), F.lit("simulated").alias("venue"))
    return experiments.identity(runs, ["n_events", "first_sequence", "venue"])


IDENTITY = f"""WITH {L2_SQL}, r AS (SELECT symbol, count(*) AS n_events, min(sequence_number) AS first_sequence, 'simulated' AS venue FROM l2 GROUP BY 1)
SELECT 'n_events' AS field, count(DISTINCT n_events) AS n_values, CAST(count_if(n_events IS NULL) AS BIGINT) AS n_null, count(DISTINCT n_events) = 1 AS same FROM r UNION ALL SELECT 'first_sequence', count(DISTINCT first_sequence), 0, count(DISTINCT first_sequence) = 1 FROM r
UNION ALL SELECT 'venue', count(DISTINCT venue), 0, count(DISTINCT venue) = 1 FROM r"""


def histogram_bins(spark, sf_dir):
    f = fills(spark, sf_dir)
    return experiments.histogram(f, F.col("quantity"), 20)


HISTOGRAM = f"""WITH {FILL_SQL}, e AS (SELECT CAST(min(quantity) AS DOUBLE) AS a, CAST(max(quantity) AS DOUBLE) AS b FROM fl)
SELECT CAST(CASE WHEN a = b THEN 0 ELSE least(floor((quantity - a) * 20 / (b - a)), 19) END AS BIGINT) AS bin, count(*) AS n FROM fl CROSS JOIN e GROUP BY 1"""


def _ids(spark, sf_dir, cond):
    return l2(spark, sf_dir).where(cond).select("symbol", "sequence_number")


_A, _B = "event_type = 'ADD' and sequence_number % 2 = 0", "event_type = 'ADD' and sequence_number % 3 = 0"


def exposure_union(spark, sf_dir):
    return _ids(spark, sf_dir, _A).unionByName(_ids(spark, sf_dir, _B)).distinct()


def requested_minus_sent(spark, sf_dir):
    return _ids(spark, sf_dir, _A).join(_ids(spark, sf_dir, _B), ["symbol", "sequence_number"], "left_anti")


def live_intersection(spark, sf_dir):
    return _ids(spark, sf_dir, _A).join(_ids(spark, sf_dir, _B), ["symbol", "sequence_number"], "left_semi")


_SETS = f"WITH {L2_SQL} SELECT symbol, sequence_number FROM l2 WHERE {_A} {{op}} SELECT symbol, sequence_number FROM l2 WHERE {_B}"

QUERIES = {
    "markouts_forward_asof": (markouts_forward_asof, MARKOUTS), "markout_by_horizon": (markout_by_horizon, BY_HORIZON), "markout_by_side": (markout_by_side, BY_SIDE), "fill_midpoint_backward_asof": (fill_midpoint_backward_asof, BACKWARD),
    "spread_capture_attribution": (spread_capture_attribution, CAPTURE), "fill_volume_turnover": (fill_volume_turnover, VOLUME), "inventory_path": (inventory_path, PATH), "inventory_stats": (inventory_stats, STATS), "near_limit_fraction": (near_limit_fraction, NEAR),
    "cash_pnl_marked": (cash_pnl_marked, PNL), "drawdown_cummax": (drawdown_cummax, _DD.format(p=PNL_SQL, h=_HIGH)), "risk_high_watermark": (risk_high_watermark, _DD.format(p=PNL_SQL, h=f"greatest(0, {_HIGH})")), "pnl_by_regime": (pnl_by_regime, BY_REGIME), "pnl_by_regime_equal_times": (pnl_by_regime_equal_times, BY_REGIME_EQUAL_TIMES),
    "illegal_transitions_anti_join": (illegal_transitions_anti_join, ILLEGAL), "order_activity_counts": (order_activity_counts, ACTIVITY), "average_fill_price": (average_fill_price, AVERAGE), "worst_case_exposure": (worst_case_exposure, EXPOSURE),
    "pretrade_first_reason": (pretrade_first_reason, PRETRADE), "stale_quotes": (stale_quotes, STALE), "group_mean_excl_null": (group_mean_excl_null, GROUP_MEAN), "experiment_grid_cross": (experiment_grid_cross, GRID), "experiment_aggregate": (experiment_aggregate, AGGREGATE),
    "percentile_nearest_rank": (percentile_nearest_rank, PERCENTILE), "queue_policy_differs": (queue_policy_differs, DIFFERS), "comparison_identity": (comparison_identity, IDENTITY), "histogram_bins": (histogram_bins, HISTOGRAM),
    "exposure_union": (exposure_union, _SETS.format(op="UNION")), "requested_minus_sent": (requested_minus_sent, _SETS.format(op="EXCEPT")), "live_intersection": (live_intersection, _SETS.format(op="INTERSECT")),
}
