"""Queries over the order book, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import quotes as Q
from ..operators import book, metrics, queue
from ..operators.running import numbered, running_max
from ..schema import select_events, violation
from ..streaming.bars import counted_bars
from .bindings import BBO_SQL, EPOCH_SQL, L2_SQL, LEVEL_SQL, LEVELS, MID, l2

HOUR = 3_600 * 10**9
_QUOTE = "CAST(floor({c} - {h}) AS BIGINT) AS bid_ticks, CAST(CASE WHEN floor({c} - {h}) >= ceil({c} + {h}) THEN floor({c} - {h}) + 1 ELSE ceil({c} + {h}) END AS BIGINT) AS ask_ticks"
_QUOTE_OF = _QUOTE.format(c="c", h="h")


def market(spark, sf_dir):
    return book.market(l2(spark, sf_dir))


def bbo(spark, sf_dir):
    m = market(spark, sf_dir)
    r = lambda c: F.round(c, 9).alias(c)
    return m.select("symbol", "sequence_number", "timestamp_ns", "epoch", "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity", "spread_ticks", "midpoint_ticks", r("microprice_ticks"), r("imbalance"))


BBO = f"""WITH {BBO_SQL} SELECT symbol, sequence_number, timestamp_ns, epoch, best_bid_ticks, best_bid_quantity, best_ask_ticks, best_ask_quantity, spread_ticks, midpoint_ticks,
 round(CASE WHEN midpoint_ticks IS NOT NULL THEN CAST(best_ask_ticks * best_bid_quantity + best_bid_ticks * best_ask_quantity AS DOUBLE) / (best_bid_quantity + best_ask_quantity) END, 9) AS microprice_ticks,
 round(CASE WHEN midpoint_ticks IS NOT NULL THEN CAST(best_bid_quantity - best_ask_quantity AS DOUBLE) / (best_bid_quantity + best_ask_quantity) END, 9) AS imbalance FROM market"""


def bbo_interval_join(spark, sf_dir):
    e = book.bbo_relational(book.with_epochs(l2(spark, sf_dir)))
    return e.select("symbol", "sequence_number", "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity")


BBO_INTERVAL = f"WITH {BBO_SQL} SELECT symbol, sequence_number, best_bid_ticks, best_bid_quantity, best_ask_ticks, best_ask_quantity FROM market"


def book_delta(spark, sf_dir):
    return book.book_deltas(book.with_epochs(l2(spark, sf_dir)))


BOOK_DELTA = f"""WITH {LEVEL_SQL}, ends AS (SELECT symbol, epoch + 1 AS epoch, sum(q) AS total FROM (SELECT symbol, epoch, side, price_ticks, max_by(qty_after, sequence_number) AS q FROM lv GROUP BY ALL) GROUP BY 1, 2)
SELECT symbol, sequence_number, event_type, CAST(qty_before AS BIGINT) AS before, CAST(CASE WHEN event_type IN ('ADD', 'SNAPSHOT') THEN quantity ELSE least(quantity, qty_before) END AS BIGINT) AS applied, qty_after AS after,
 event_type IN ('CANCEL', 'TRADE') AND quantity > qty_before AS clamped FROM lv
UNION ALL SELECT e.symbol, e.sequence_number, e.event_type, CAST(coalesce(t.total, 0) AS BIGINT), CAST(coalesce(t.total, 0) AS BIGINT), 0, false FROM l2e e LEFT JOIN ends t USING (symbol, epoch) WHERE e.event_type = 'RESET'"""


def clamp_counters(spark, sf_dir):
    d = book.book_deltas(book.with_epochs(l2(spark, sf_dir)))
    return d.groupBy("symbol", "event_type").agg(F.count("*").alias("n_events"), F.count_if("clamped").alias("n_clamped"), F.sum("applied").alias("applied"))


CLAMP_COUNTERS = f"SELECT symbol, event_type, count(*) AS n_events, CAST(count_if(clamped) AS BIGINT) AS n_clamped, CAST(sum(applied) AS BIGINT) AS applied FROM ({BOOK_DELTA}) GROUP BY 1, 2"


def book_depth_topn(spark, sf_dir):
    """Depth after every event."""
    return book.top_n(book.with_epochs(l2(spark, sf_dir)), 5)


_TOP = f"""{LEVEL_SQL}, st AS (SELECT e.symbol, e.sequence_number, l.side, l.price_ticks, l.qty_after AS quantity,
 row_number() OVER (PARTITION BY e.symbol, e.sequence_number, l.side ORDER BY l.price_ticks * l.side DESC) AS rank
 FROM l2e e JOIN lv l ON l.symbol = e.symbol AND l.epoch = e.epoch AND l.sequence_number <= e.sequence_number AND e.sequence_number < l.seq_to AND l.qty_after > 0)"""
BOOK_DEPTH = f"WITH {_TOP} SELECT symbol, sequence_number, side, rank, price_ticks, quantity FROM st WHERE rank <= 5"


def weighted_imbalance(spark, sf_dir):
    return book.weighted_imbalance(book.with_epochs(l2(spark, sf_dir)), 5).withColumn("weighted_imbalance", F.round("weighted_imbalance", 9))


WEIGHTED = f"""WITH {_TOP} SELECT symbol, sequence_number, round((b - a) / (b + a), 9) AS weighted_imbalance FROM (SELECT symbol, sequence_number,
 sum(CASE WHEN side = 1 THEN CAST(quantity AS DOUBLE) / rank END) AS b, sum(CASE WHEN side = -1 THEN CAST(quantity AS DOUBLE) / rank END) AS a FROM st WHERE rank <= 5 GROUP BY 1, 2)"""


_ALL_LEVELS = [(s, MID - s - s * k) for s in (1, -1) for k in range(LEVELS)]


def level_quantity_lookup(spark, sf_dir):
    e = book.with_epochs(l2(spark, sf_dir))
    points = e.select("symbol", F.col("sequence_number").alias("seq"), F.explode(F.array(*[F.struct(F.lit(s).cast("tinyint").alias("side"), F.lit(p).cast("bigint").alias("price_ticks")) for s, p in _ALL_LEVELS])).alias("p")).select("symbol", "seq", "p.*")
    return book.quantity_at(e, points)


LOOKUP = f"""WITH {LEVEL_SQL} SELECT e.symbol, e.sequence_number AS seq, CAST(p.side AS TINYINT) AS side, CAST(p.price AS BIGINT) AS price_ticks, CAST(coalesce(l.qty_after, 0) AS BIGINT) AS quantity
 FROM l2e e CROSS JOIN (VALUES {", ".join(map(str, _ALL_LEVELS))}) p(side, price)
 LEFT JOIN lv l ON l.symbol = e.symbol AND l.epoch = e.epoch AND l.side = p.side AND l.price_ticks = p.price AND l.sequence_number <= e.sequence_number AND e.sequence_number < l.seq_to AND l.qty_after > 0"""


def book_invariants(spark, sf_dir):
    m = market(spark, sf_dir)
    return m.groupBy("symbol").agg(F.count("*").alias("n_events"), F.count_if("is_crossed").alias("n_crossed"), F.count_if((F.col("best_bid_ticks").isNotNull() & (F.col("best_bid_quantity") <= 0)) | (F.col("best_ask_ticks").isNotNull() & (F.col("best_ask_quantity") <= 0))).alias("n_nonpositive"))


INVARIANTS = f"""WITH {BBO_SQL} SELECT symbol, count(*) AS n_events, CAST(count_if(coalesce(best_bid_ticks >= best_ask_ticks, false)) AS BIGINT) AS n_crossed,
 CAST(count_if((best_bid_ticks IS NOT NULL AND best_bid_quantity <= 0) OR (best_ask_ticks IS NOT NULL AND best_ask_quantity <= 0)) AS BIGINT) AS n_nonpositive FROM market GROUP BY 1"""


def sweep_allocation(spark, sf_dir):
    """What orders of 60 take from each side after every event."""
    lv = book.ladder(book.with_epochs(l2(spark, sf_dir)), covers=60)
    return book.sweep(lv, ["symbol", "sequence_number", "side"], F.lit(60), [F.col("rank")]).select("symbol", "sequence_number", "side", "price_ticks", "taken")


SWEEP = f"""WITH {_TOP} SELECT symbol, sequence_number, side, price_ticks, taken FROM (SELECT symbol, sequence_number, side, price_ticks,
 CAST(greatest(0, least(quantity, 60 - (sum(quantity) OVER (PARTITION BY symbol, sequence_number, side ORDER BY rank) - quantity))) AS BIGINT) AS taken FROM st) WHERE taken > 0"""


def _segments(spark, sf_dir):
    """ADD events of each (symbol, epoch, side, price) as queue segments; every third is an own order."""
    e = book.with_epochs(l2(spark, sf_dir)).where("event_type = 'ADD'")
    return e.select(F.concat_ws(":", *[F.col(c).cast("string") for c in ("symbol", "epoch", "side", "price_ticks")]).alias("level"), F.col("sequence_number").alias("seg"), (F.col("sequence_number") % 3 == 0).alias("own"), "quantity")


_SEG = f"{EPOCH_SQL}, seg AS (SELECT symbol || ':' || epoch || ':' || side || ':' || price_ticks AS level, sequence_number AS seg, sequence_number % 3 = 0 AS own, quantity FROM l2e WHERE event_type = 'ADD')"
_ALLOC = "CAST(greatest(0, least(quantity, {b} - (sum(quantity) OVER (PARTITION BY level ORDER BY seg {d}) - quantity))) AS BIGINT)"


def queue_trade_budget(spark, sf_dir):
    return queue.trade_budget(_segments(spark, sf_dir), F.lit(70))


def queue_cancel_front(spark, sf_dir):
    return queue.cancel_front(_segments(spark, sf_dir), F.lit(40))


def queue_cancel_back(spark, sf_dir):
    return queue.cancel_back(_segments(spark, sf_dir), F.lit(40))


def queue_cancel_pro_rata(spark, sf_dir):
    return queue.cancel_pro_rata(_segments(spark, sf_dir), F.lit(40).cast("bigint"))


def queue_positions(spark, sf_dir):
    return queue.positions(_segments(spark, sf_dir))


PRO_RATA = f"""WITH {_SEG}, t AS (SELECT *, sum(quantity) OVER (PARTITION BY level) AS total FROM seg WHERE NOT own), c AS (SELECT *, least(40, total) AS c FROM t),
 b AS (SELECT *, (c * quantity) // total AS base, (c * quantity) % total AS rem FROM c)
SELECT level, seg, own, quantity, CAST(base + CASE WHEN row_number() OVER (PARTITION BY level ORDER BY rem DESC, seg) <= c - sum(base) OVER (PARTITION BY level) THEN 1 ELSE 0 END AS BIGINT) AS cancelled FROM b"""
POSITIONS = f"""WITH {_SEG} SELECT level, seg, quantity, external_ahead, own_ahead, external_behind FROM (SELECT *,
 CAST(coalesce(sum(CASE WHEN own THEN 0 ELSE quantity END) OVER (PARTITION BY level ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS external_ahead,
 CAST(coalesce(sum(CASE WHEN own THEN quantity ELSE 0 END) OVER (PARTITION BY level ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS own_ahead,
 CAST(coalesce(sum(CASE WHEN own THEN 0 ELSE quantity END) OVER (PARTITION BY level ORDER BY seg ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS external_behind FROM seg) WHERE own"""


def price_through_fills(spark, sf_dir):
    """Every ADD as an order, with the first later trade of its epoch that goes through it."""
    return queue.first_through(book.with_epochs(l2(spark, sf_dir)))


PRICE_THROUGH = f"""WITH {EPOCH_SQL} SELECT o.symbol, o.sequence_number AS order_seq, o.quantity, min(t.sequence_number) AS trade_seq FROM l2e o JOIN l2e t ON o.symbol = t.symbol AND o.epoch = t.epoch AND o.side = t.side
 AND o.price_ticks * o.side > t.price_ticks * t.side AND t.sequence_number > o.sequence_number WHERE o.event_type = 'ADD' AND t.event_type = 'TRADE' GROUP BY 1, 2, 3"""


def trade_reduction_band_join(spark, sf_dir):
    """Trades with the cancels of the same level within an hour, nearest first."""
    e = l2(spark, sf_dir)
    t = e.where("event_type = 'TRADE'").select("symbol", "side", "price_ticks", F.col("timestamp_ns").alias("t_ts"), F.col("sequence_number").alias("t_seq"))
    c = e.where("event_type = 'CANCEL'").select("symbol", "side", "price_ticks", F.col("timestamp_ns").alias("c_ts"), F.col("sequence_number").alias("c_seq"))
    hour = lambda c_: F.floor(c_ / HOUR)  # noqa: E731  cells of an hour turn the band into an equi-join with at most three cells
    c = c.withColumn("cell", F.explode(F.array(hour(F.col("c_ts")) - 1, hour(F.col("c_ts")), hour(F.col("c_ts")) + 1)))
    hit = t.withColumn("cell", hour(F.col("t_ts"))).join(c, ["symbol", "side", "price_ticks", "cell"]).where(F.abs(F.col("t_ts") - F.col("c_ts")) <= HOUR)
    rank = F.row_number().over(Window.partitionBy("symbol", "t_seq").orderBy(F.abs(F.col("t_ts") - F.col("c_ts")), "c_ts", "c_seq"))
    return hit.select("symbol", "side", "price_ticks", "t_seq", "c_seq", F.abs(F.col("t_ts") - F.col("c_ts")).alias("distance_ns"), rank.cast("bigint").alias("rank"))


BAND = f"""WITH {L2_SQL} SELECT t.symbol, t.side, t.price_ticks, t.sequence_number AS t_seq, c.sequence_number AS c_seq, abs(t.timestamp_ns - c.timestamp_ns) AS distance_ns,
 row_number() OVER (PARTITION BY t.symbol, t.sequence_number ORDER BY abs(t.timestamp_ns - c.timestamp_ns), c.timestamp_ns, c.sequence_number) AS rank
 FROM l2 t JOIN l2 c ON t.symbol = c.symbol AND t.side = c.side AND t.price_ticks = c.price_ticks AND abs(t.timestamp_ns - c.timestamp_ns) <= {HOUR} WHERE t.event_type = 'TRADE' AND c.event_type = 'CANCEL'"""


def ordered_channel_delivery(spark, sf_dir):
    """Messages that leave at their event's time, take a latency that depends on the sequence, and never overtake."""
    e = l2(spark, sf_dir).withColumn("send_plus_latency_ns", F.col("timestamp_ns") + (F.col("sequence_number") * 7919 % 3600) * 10**9)
    return running_max(e, ["symbol"], ["sequence_number"], F.col("send_plus_latency_ns"), "delivery_ns", "sequence_number").select("symbol", "sequence_number", "send_plus_latency_ns", "delivery_ns")


CHANNEL = f"""WITH {L2_SQL}, s AS (SELECT symbol, sequence_number, timestamp_ns + (sequence_number * 7919 % 3600) * 1000000000 AS send_plus_latency_ns FROM l2)
SELECT *, max(send_plus_latency_ns) OVER (PARTITION BY symbol ORDER BY sequence_number) AS delivery_ns FROM s"""


def canonical_contract_violations(spark, sf_dir):
    """The contract over rows whose fields are spoiled by rule."""
    e = l2(spark, sf_dir)
    n = F.col("sequence_number")
    bad = e.withColumns({"price_ticks": F.when(n % 7 == 3, F.lit(0).cast("bigint")).otherwise(F.col("price_ticks")), "quantity": F.when(n % 11 == 5, -F.col("quantity")).otherwise(F.col("quantity")), "side": F.when(n % 13 == 4, F.lit(None).cast("tinyint")).otherwise(F.col("side")), "event_type": F.when(n % 17 == 2, "AUCTION").otherwise(F.col("event_type"))})
    return bad.groupBy("symbol", F.coalesce(violation(), F.lit("ok")).alias("violation")).agg(F.count("*").alias("n"))


VIOLATIONS = f"""WITH {L2_SQL}, bad AS (SELECT symbol, sequence_number, CASE WHEN sequence_number % 17 = 2 THEN 'AUCTION' ELSE event_type END AS k, CASE WHEN sequence_number % 13 = 4 THEN NULL ELSE side END AS s,
 CASE WHEN sequence_number % 7 = 3 THEN 0 ELSE price_ticks END AS p, CASE WHEN sequence_number % 11 = 5 THEN -quantity ELSE quantity END AS q FROM l2)
SELECT symbol, CASE WHEN k = 'AUCTION' THEN 'unknown_event_type' WHEN k = 'RESET' AND (p <> 0 OR q <> 0) THEN 'reset_with_level' WHEN k <> 'RESET' AND s IS NULL THEN 'invalid_side'
 WHEN k <> 'RESET' AND p <= 0 THEN 'nonpositive_price' WHEN k <> 'RESET' AND q <= 0 THEN 'nonpositive_quantity' ELSE 'ok' END AS violation, count(*) AS n FROM bad GROUP BY 1, 2"""


def stream_order_issues(spark, sf_dir):
    """Regressions of time and sequence in an arrival order that swaps neighbours by rule."""
    e = l2(spark, sf_dir)
    e = e.withColumn("arrival", F.col("sequence_number") + F.when(F.col("sequence_number") % 9 == 4, 2).otherwise(0)).withColumn("tie", F.col("sequence_number"))
    w = Window.partitionBy("symbol").orderBy("arrival", "tie")
    e = e.withColumn("p_ts", F.lag("timestamp_ns").over(w)).withColumn("p_seq", F.lag("sequence_number").over(w))
    issues = F.filter(F.array(F.when(F.col("timestamp_ns") < F.col("p_ts"), "timestamp_regression"), F.when(F.col("sequence_number") <= F.col("p_seq"), "sequence_not_strictly_increasing")), lambda x: x.isNotNull())
    return e.select("symbol", "sequence_number", F.explode(issues).alias("code"))


ISSUES = f"""WITH {L2_SQL}, a AS (SELECT *, lag(timestamp_ns) OVER w AS p_ts, lag(sequence_number) OVER w AS p_seq FROM (SELECT *, sequence_number + CASE WHEN sequence_number % 9 = 4 THEN 2 ELSE 0 END AS arrival FROM l2)
 WINDOW w AS (PARTITION BY symbol ORDER BY arrival, sequence_number))
SELECT symbol, sequence_number, 'timestamp_regression' AS code FROM a WHERE timestamp_ns < p_ts UNION ALL SELECT symbol, sequence_number, 'sequence_not_strictly_increasing' FROM a WHERE sequence_number <= p_seq"""


def select_time_range_limit(spark, sf_dir):
    return select_events(l2(spark, sf_dir), 1_704_500_000_000_000_000, 1_706_000_000_000_000_000, 100)


RANGE_LIMIT = f"""WITH {L2_SQL} SELECT symbol, timestamp_ns, sequence_number, event_type, side, price_ticks, quantity FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sequence_number) AS n FROM l2
 WHERE timestamp_ns BETWEEN 1704500000000000000 AND 1706000000000000000) WHERE n <= 100"""


def timer_grid(spark, sf_dir):
    """Timer ticks every six hours from each symbol's first to its last event."""
    ends = l2(spark, sf_dir).groupBy("symbol").agg(F.min("timestamp_ns").alias("a"), F.max("timestamp_ns").alias("b"))
    return ends.select("symbol", F.explode(F.sequence("a", "b", F.lit(6 * HOUR))).alias("timer_ns"))


TIMER = f"WITH {L2_SQL}, e AS (SELECT symbol, min(timestamp_ns) AS a, max(timestamp_ns) AS b FROM l2 GROUP BY 1) SELECT symbol, unnest(range(a, b + 1, {6 * HOUR})) AS timer_ns FROM e"


def regime_classification(spark, sf_dir):
    m = metrics.regimes(market(spark, sf_dir))
    return m.select("symbol", "sequence_number", "midpoint_change", "spread_regime", "liquidity_regime", "volatility_regime")


REGIME_SQL = f"""{BBO_SQL}, ch AS (SELECT *, CAST(best_bid_quantity + best_ask_quantity AS DOUBLE) AS depth, coalesce(abs(midpoint_ticks - last_value(midpoint_ticks IGNORE NULLS) OVER
 (PARTITION BY symbol ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0.0) AS midpoint_change FROM market),
 rg AS (SELECT *, CASE WHEN spread_ticks > avg(spread_ticks) OVER s THEN 'wide' ELSE 'tight' END AS spread_regime, CASE WHEN depth >= avg(depth) OVER s THEN 'deep' ELSE 'thin' END AS liquidity_regime,
 CASE WHEN midpoint_change > avg(midpoint_change) OVER s THEN 'high' ELSE 'low' END AS volatility_regime FROM ch WINDOW s AS (PARTITION BY symbol))"""
REGIMES = f"WITH {REGIME_SQL} SELECT symbol, sequence_number, CAST(midpoint_change AS DOUBLE) AS midpoint_change, spread_regime, liquidity_regime, volatility_regime FROM rg"


def rolling_volatility(spark, sf_dir):
    return metrics.rolling_volatility(market(spark, sf_dir), 20).select("symbol", "sequence_number", F.round("volatility_ticks", 6).alias("volatility_ticks"))


VOLATILITY = f"""WITH {BBO_SQL}, d AS (SELECT symbol, sequence_number, midpoint_ticks - lag(midpoint_ticks) OVER (PARTITION BY symbol ORDER BY sequence_number) AS d FROM market WHERE midpoint_ticks IS NOT NULL)
SELECT symbol, sequence_number, round(CASE WHEN count(d) OVER w >= 2 THEN stddev_pop(CAST(d AS DOUBLE)) OVER w ELSE 0.0 END, 6) AS volatility_ticks FROM d WINDOW w AS (PARTITION BY symbol ORDER BY sequence_number ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"""


def message_rate_1s(spark, sf_dir):
    """Messages of a symbol in the second up to each."""
    return metrics.message_counts(l2(spark, sf_dir), metrics.SECOND).select("symbol", "sequence_number", "n_window")


def message_rate_1h(spark, sf_dir):
    """Messages of a symbol in the hour up to each."""
    return metrics.message_counts(l2(spark, sf_dir), HOUR).select("symbol", "sequence_number", "n_window")


MESSAGES = "WITH {l2} SELECT symbol, sequence_number, count(*) OVER (PARTITION BY symbol ORDER BY timestamp_ns RANGE BETWEEN {reach} PRECEDING AND CURRENT ROW) AS n_window FROM l2"


def quote_microprice_rule(spark, sf_dir):
    """The whole rule of quotes around the microprice: imbalance, inventory (by rule from the sequence number), volatility of the last 20 changes, a least width, taper and limits."""
    inv = (F.col("sequence_number") * 37 % 241 - 120).cast("bigint")
    m = metrics.rolling_volatility(market(spark, sf_dir), 20)
    q = Q.microprice_quotes(F.col("microprice_ticks"), F.col("imbalance"), inv, F.round("volatility_ticks", 6), 100, 0.25, 1.25, 2.0, 3.0, 0.5, 10)
    return m.select("symbol", "sequence_number", *[c.alias(name) for name, c in q.items()])


_D = "CAST({} AS DOUBLE)"
QUOTE_RULE = f"""WITH {BBO_SQL}, d AS (SELECT *, sequence_number * 37 % 241 - 120 AS inventory, midpoint_ticks - lag(midpoint_ticks) OVER (PARTITION BY symbol ORDER BY sequence_number) AS d FROM market WHERE midpoint_ticks IS NOT NULL),
 v AS (SELECT *, round(CASE WHEN count(d) OVER w >= 2 THEN stddev_pop(CAST(d AS DOUBLE)) OVER w ELSE 0.0 END, 6) AS vol FROM d WINDOW w AS (PARTITION BY symbol ORDER BY sequence_number ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 c AS (SELECT *, CAST(best_ask_ticks * best_bid_quantity + best_bid_ticks * best_ask_quantity AS DOUBLE) / (best_bid_quantity + best_ask_quantity) + {_D.format(2.0)} * (CAST(best_bid_quantity - best_ask_quantity AS DOUBLE) / (best_bid_quantity + best_ask_quantity))
  - {_D.format(3.0)} * (CAST(inventory AS DOUBLE) / {_D.format(100.0)}) AS c, greatest({_D.format(1.25)}, {_D.format(0.25)} + {_D.format(0.5)} * vol) AS h FROM v),
 q AS (SELECT *, {_QUOTE_OF} FROM c)
SELECT symbol, sequence_number, CASE WHEN inventory < 100 THEN bid_ticks END AS bid_ticks, CASE WHEN inventory > -100 THEN ask_ticks END AS ask_ticks,
 CAST(greatest(1, floor(CAST(10 AS DOUBLE) * (1.0 - CAST(0.75 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), abs(inventory) / CAST(100.0 AS DOUBLE))))) AS BIGINT) AS quantity FROM q"""


def bars_with_late_rows(spark, sf_dir):
    """Six-hour bars of trades that arrive up to two days late by rule: bars are final a day after their end, rows a day or more behind are late and counted."""
    e = l2(spark, sf_dir).withColumn("_at", F.col("timestamp_ns") + (F.col("sequence_number") * 7919 % 49) * HOUR).drop("sequence_number")
    arrived = numbered(e, ["symbol"], ["_at", "timestamp_ns", "price_ticks", "event_type", "quantity"], "sequence_number", "_at", 24 * HOUR)
    return counted_bars(arrived.drop("_at"), 6 * HOUR, 24 * HOUR)


LATE = f"""WITH {L2_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ns + (sequence_number * 7919 % 49) * {HOUR}, timestamp_ns, price_ticks, event_type, quantity) - 1 AS n FROM l2),
 b AS (SELECT *, coalesce(max(timestamp_ns) OVER (PARTITION BY symbol ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - timestamp_ns >= {24 * HOUR}, false) AS late, max(timestamp_ns) OVER (PARTITION BY symbol) AS stop FROM a),
 c AS (SELECT *, sum(CAST(late AS INTEGER)) OVER (PARTITION BY symbol ORDER BY n) AS late_rows, timestamp_ns - timestamp_ns % {6 * HOUR} AS start FROM b)
SELECT symbol, 'bar' AS kind, start AS start_ns, start + {6 * HOUR} AS end_ns, arg_min(price_ticks, n) AS open, max(price_ticks) AS high, min(price_ticks) AS low, arg_max(price_ticks, n) AS close, CAST(sum(quantity) AS BIGINT) AS volume, count(*) AS trades, CAST(NULL AS BIGINT) AS late_rows
 FROM c WHERE NOT late AND event_type = 'TRADE' GROUP BY symbol, start, stop HAVING stop - start - {6 * HOUR} >= {24 * HOUR}
UNION ALL SELECT symbol, 'late', timestamp_ns, n, NULL, NULL, NULL, NULL, NULL, NULL, CAST(late_rows AS BIGINT) FROM c WHERE late"""


def quote_fixed(spark, sf_dir):
    bid, ask = Q.rounded_quotes(F.col("midpoint_ticks"), F.lit(1.5))
    return market(spark, sf_dir).where("midpoint_ticks is not null").select("symbol", "sequence_number", bid.alias("bid_ticks"), ask.alias("ask_ticks"))


QUOTE_FIXED = f"WITH {BBO_SQL} SELECT symbol, sequence_number, {_QUOTE.format(c='midpoint_ticks', h='1.5')} FROM market WHERE midpoint_ticks IS NOT NULL"


def quote_inventory(spark, sf_dir):
    """Quotes skewed by an inventory that the sequence number stands in for, with tapered size and suppressed sides."""
    inv = (F.col("sequence_number") * 37 % 201 - 100).cast("bigint")
    m = market(spark, sf_dir).where("midpoint_ticks is not null").withColumn("inventory", inv)
    bid, ask = Q.rounded_quotes(F.col("midpoint_ticks") - F.col("inventory") * 4.0 / 100.0, F.lit(1.5))
    size = Q.tapered_quantity(10, F.col("inventory"), 100)
    return m.select("symbol", "sequence_number", F.when(F.col("inventory") < 100, bid).alias("bid_ticks"), F.when(F.col("inventory") > -100, ask).alias("ask_ticks"), size.alias("quantity"))


QUOTE_INVENTORY = f"""WITH {BBO_SQL}, i AS (SELECT *, sequence_number * 37 % 201 - 100 AS inventory FROM market WHERE midpoint_ticks IS NOT NULL), c AS (SELECT *, CAST(midpoint_ticks AS DOUBLE) - inventory * CAST(4.0 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS c FROM i),
 q AS (SELECT *, {_QUOTE.format(c='c', h='1.5')} FROM c)
SELECT symbol, sequence_number, CASE WHEN inventory < 100 THEN bid_ticks END AS bid_ticks, CASE WHEN inventory > -100 THEN ask_ticks END AS ask_ticks,
 CAST(greatest(1, floor(CAST(10 AS DOUBLE) * (1.0 - CAST(0.75 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), abs(inventory) / CAST(100.0 AS DOUBLE))))) AS BIGINT) AS quantity FROM q"""


def quote_microprice(spark, sf_dir):
    m = market(spark, sf_dir).where("midpoint_ticks is not null")
    bid, ask = Q.rounded_quotes(F.col("microprice_ticks") + F.lit(2.0) * F.col("imbalance"), F.lit(1.25))
    return m.select("symbol", "sequence_number", bid.alias("bid_ticks"), ask.alias("ask_ticks"))


QUOTE_MICRO = f"""WITH {BBO_SQL}, c AS (SELECT symbol, sequence_number, CAST(best_ask_ticks * best_bid_quantity + best_bid_ticks * best_ask_quantity AS DOUBLE) / (best_bid_quantity + best_ask_quantity)
 + CAST(2.0 AS DOUBLE) * (CAST(best_bid_quantity - best_ask_quantity AS DOUBLE) / (best_bid_quantity + best_ask_quantity)) AS c FROM market WHERE midpoint_ticks IS NOT NULL)
SELECT symbol, sequence_number, {_QUOTE.format(c='c', h='CAST(1.25 AS DOUBLE)')} FROM c"""


def row_fingerprint(spark, sf_dir):
    """Each event as the hex of its fixed-width big-endian record."""
    from ..sources.fingerprint import record_hex

    return l2(spark, sf_dir).select("symbol", "sequence_number", record_hex().alias("record_hex"))


FINGERPRINT = f"""WITH {L2_SQL} SELECT symbol, sequence_number, upper(lpad(to_hex(timestamp_ns), 16, '0') || lpad(to_hex(sequence_number), 16, '0')
 || CASE event_type WHEN 'ADD' THEN '01' WHEN 'CANCEL' THEN '02' WHEN 'TRADE' THEN '03' WHEN 'RESET' THEN '04' ELSE '05' END || CASE WHEN side IS NULL THEN '00' WHEN side = 1 THEN '01' ELSE 'FF' END
 || lpad(to_hex(price_ticks), 16, '0') || lpad(to_hex(quantity), 16, '0')) AS record_hex FROM l2"""


def stream_sha256(spark, sf_dir):
    from ..sources.fingerprint import stream_sha256 as sha

    return sha(l2(spark, sf_dir), ["symbol"])


STREAM_SHA = f"SELECT symbol, sha256(unhex(string_agg(record_hex, '' ORDER BY sequence_number))) AS stream_sha256, count(*) AS n_events FROM ({FINGERPRINT}) GROUP BY 1"

def _crossed(spark, sf_dir):
    """The stream with bids three ticks higher and asks three lower, so that they often meet."""
    up = F.when(F.col("side").isNull(), 0).otherwise(3 * F.col("side"))
    return book.with_epochs(l2(spark, sf_dir).withColumn("price_ticks", (F.col("price_ticks") + up).cast("bigint")))


def crossing_adds(spark, sf_dir):
    """Before, applied and after of every event of a stream that crosses, from prefix sums after the adds that are ignored are marked."""
    lv = book.level_changes(_crossed(spark, sf_dir))
    return lv.select("symbol", "sequence_number", F.col("qty_before").alias("before"), F.col("qty_applied").alias("applied"), F.col("qty_after").alias("after"), "clamped", "add_ignored")


def crossing_bbo(spark, sf_dir):
    """The top of book of a stream that crosses."""
    return book.bbo(_crossed(spark, sf_dir)).select("symbol", "sequence_number", "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity")


# Every epoch is walked row by row; b and a hold the quantities at the eleven prices from 9995.
_PUT = "CASE WHEN side = {s} THEN list_transform({c}, lambda x, i: CASE WHEN i = p THEN after ELSE x END) ELSE {c} END"
_AT = "list_{f}(list_transform({c}, lambda x, i: CASE WHEN x > 0 THEN i END))"
_BID_AT, _ASK_AT = _AT.format(f="max", c="b"), _AT.format(f="min", c="a")
_WALK = f"""WITH RECURSIVE {EPOCH_SQL}, n AS (SELECT symbol, epoch, sequence_number, event_type, side, quantity, price_ticks + 3 * side - 9994 AS p, row_number() OVER (PARTITION BY symbol, epoch ORDER BY sequence_number) AS k FROM l2e),
 walk AS (SELECT symbol, epoch, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS sequence_number, '' AS event_type, list_transform(range(11), lambda x: CAST(0 AS BIGINT)) AS b, list_transform(range(11), lambda x: CAST(0 AS BIGINT)) AS a,
  CAST(0 AS BIGINT) AS before, CAST(0 AS BIGINT) AS applied, CAST(0 AS BIGINT) AS after, false AS clamped, false AS add_ignored FROM (SELECT DISTINCT symbol, epoch FROM n)
 UNION ALL SELECT symbol, epoch, k, sequence_number, event_type, {_PUT.format(s=1, c='b')}, {_PUT.format(s=-1, c='a')}, before, applied, after, add_ignored OR (NOT grows AND quantity > before), add_ignored
 FROM (SELECT *, CAST(CASE WHEN grows THEN before + applied ELSE before - applied END AS BIGINT) AS after FROM (SELECT *, CAST(CASE WHEN add_ignored THEN 0 WHEN grows THEN quantity ELSE least(quantity, before) END AS BIGINT) AS applied
  FROM (SELECT n.*, w.b, w.a, n.event_type IN ('ADD', 'SNAPSHOT') AS grows, CASE n.side WHEN 1 THEN w.b[n.p] WHEN -1 THEN w.a[n.p] ELSE 0 END AS before,
   coalesce(n.event_type IN ('ADD', 'SNAPSHOT') AND CASE WHEN n.side = 1 THEN n.p >= {_ASK_AT.replace('(a,', '(w.a,')} ELSE n.p <= {_BID_AT.replace('(b,', '(w.b,')} END, false) AS add_ignored
  FROM walk w JOIN n ON n.symbol = w.symbol AND n.epoch = w.epoch AND n.k = w.k + 1))))"""
CROSSING_ADDS = f"{_WALK} SELECT symbol, sequence_number, before, applied, after, clamped, add_ignored FROM walk WHERE k > 0 AND event_type <> 'RESET'"
CROSSING_BBO = f"""{_WALK} SELECT symbol, sequence_number, CAST(bp + 9994 AS BIGINT) AS best_bid_ticks, coalesce(b[bp], 0) AS best_bid_quantity, CAST(ap + 9994 AS BIGINT) AS best_ask_ticks, coalesce(a[ap], 0) AS best_ask_quantity
 FROM (SELECT *, {_BID_AT} AS bp, {_ASK_AT} AS ap FROM walk WHERE k > 0)"""


def _text(levels):
    return F.array_join(F.transform(levels, lambda x: F.concat_ws(":", x["price_ticks"], x["quantity"])), " ")


def book_views(spark, sf_dir):
    """The book's view after every event: top of book, midpoint, and five levels of each side as price:quantity."""
    v = book.views(book.with_epochs(l2(spark, sf_dir)))
    return v.select("symbol", "sequence_number", "timestamp_ns", "best_bid_ticks", "best_ask_ticks", "best_bid_quantity", "best_ask_quantity", "midpoint_ticks", _text(F.col("bids")).alias("bids"), _text(F.col("asks")).alias("asks"))


_LEVELS = "coalesce(string_agg(CASE WHEN side = {s} THEN price_ticks || ':' || quantity END, ' ' ORDER BY rank), '') AS {c}"
BOOK_VIEWS = f"""WITH {BBO_SQL}, {_TOP.removeprefix(LEVEL_SQL).lstrip(', ')}, sides AS (SELECT symbol, sequence_number, {_LEVELS.format(s=1, c='bids')}, {_LEVELS.format(s=-1, c='asks')} FROM st WHERE rank <= 5 GROUP BY 1, 2)
SELECT m.symbol, m.sequence_number, m.timestamp_ns, m.best_bid_ticks, m.best_ask_ticks, m.best_bid_quantity, m.best_ask_quantity, m.midpoint_ticks, coalesce(s.bids, '') AS bids, coalesce(s.asks, '') AS asks FROM market m LEFT JOIN sides s USING (symbol, sequence_number)"""


def level_maps(spark, sf_dir):
    """The levels of each symbol after its last event, by price, as price:quantity."""
    m = book.level_maps(book.with_epochs(l2(spark, sf_dir)))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat_ws(":", x["key"], x["value"])), " ").alias(c)
    return m.select("symbol", text("bids"), text("asks"), "n_levels")


LEVEL_MAPS = f"""WITH {LEVEL_SQL}, ends AS (SELECT symbol, max(epoch) AS epoch FROM l2e GROUP BY 1), now AS (SELECT lv.* FROM lv JOIN ends USING (symbol, epoch) WHERE seq_to = 9223372036854775807 AND qty_after > 0)
SELECT e.symbol, coalesce(string_agg(CASE WHEN side = 1 THEN price_ticks || ':' || qty_after END, ' ' ORDER BY price_ticks), '') AS bids, coalesce(string_agg(CASE WHEN side = -1 THEN price_ticks || ':' || qty_after END, ' ' ORDER BY price_ticks), '') AS asks,
 count(n.symbol) AS n_levels FROM ends e LEFT JOIN now n USING (symbol) GROUP BY 1"""

QUERIES = {
    "crossing_adds": (crossing_adds, CROSSING_ADDS), "crossing_bbo": (crossing_bbo, CROSSING_BBO), "book_views": (book_views, BOOK_VIEWS), "level_maps": (level_maps, LEVEL_MAPS),
    "bbo": (bbo, BBO), "bbo_interval_join": (bbo_interval_join, BBO_INTERVAL), "book_delta": (book_delta, BOOK_DELTA), "issue_counters": (clamp_counters, CLAMP_COUNTERS), "book_depth_topn": (book_depth_topn, BOOK_DEPTH),
    "weighted_imbalance": (weighted_imbalance, WEIGHTED), "level_quantity_lookup": (level_quantity_lookup, LOOKUP), "book_invariants": (book_invariants, INVARIANTS), "sweep_allocation": (sweep_allocation, SWEEP),
    "queue_trade_budget": (queue_trade_budget, f"WITH {_SEG} SELECT *, {_ALLOC.format(b=70, d='')} AS consumed FROM seg"),
    "queue_cancel_front": (queue_cancel_front, f"WITH {_SEG} SELECT *, {_ALLOC.format(b=40, d='')} AS cancelled FROM seg WHERE NOT own"),
    "queue_cancel_back": (queue_cancel_back, f"WITH {_SEG} SELECT *, {_ALLOC.format(b=40, d='DESC')} AS cancelled FROM seg WHERE NOT own"),
    "queue_cancel_pro_rata": (queue_cancel_pro_rata, PRO_RATA), "queue_positions": (queue_positions, POSITIONS), "price_through_fills": (price_through_fills, PRICE_THROUGH), "trade_reduction_band_join": (trade_reduction_band_join, BAND),
    "ordered_channel_delivery": (ordered_channel_delivery, CHANNEL), "canonical_contract_violations": (canonical_contract_violations, VIOLATIONS), "stream_order_issues": (stream_order_issues, ISSUES),
    "select_time_range_limit": (select_time_range_limit, RANGE_LIMIT), "timer_grid": (timer_grid, TIMER), "regime_classification": (regime_classification, REGIMES), "rolling_volatility": (rolling_volatility, VOLATILITY),
    "message_rate_1s": (message_rate_1s, MESSAGES.format(l2=L2_SQL, reach=metrics.SECOND - 1)), "message_rate_1h": (message_rate_1h, MESSAGES.format(l2=L2_SQL, reach=HOUR - 1)), "quote_fixed": (quote_fixed, QUOTE_FIXED), "quote_inventory": (quote_inventory, QUOTE_INVENTORY), "quote_microprice": (quote_microprice, QUOTE_MICRO), "quote_microprice_rule": (quote_microprice_rule, QUOTE_RULE),
    "bars_with_late_rows": (bars_with_late_rows, LATE), "row_fingerprint": (row_fingerprint, FINGERPRINT), "stream_sha256": (stream_sha256, STREAM_SHA),
}
