"""The given tables in the roles of the engine's data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import numbered

DAY = 86_400 * 10**9
SYMBOLS, RESET_EVERY, LEVELS, MID = 5, 50, 8, 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a Level-2 stream of five symbols: bids below, asks above 10,000 ticks, a RESET at every 50th event id."""
    e = table(spark, sf_dir, "events")
    ns = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz)) * 1000")
    even = F.col("event_id") % 2 == 0
    kind = F.when(F.col("event_id") % RESET_EVERY == 0, "RESET").when(F.col("event_type").isin("signup", "view"), "ADD").when(F.col("event_type") == "click", "SNAPSHOT").when(F.col("event_type") == "purchase", "TRADE").otherwise("CANCEL")
    step = F.expr(f"(event_id div 2) % {LEVELS}")
    raw = e.select((F.col("user_id") % SYMBOLS).alias("symbol"), "event_id", ns.alias("timestamp_ns"), kind.alias("event_type"), F.when(even, 1).otherwise(-1).alias("side"), F.when(even, MID - 1 - step).otherwise(MID + 1 + step).alias("price_ticks"), (1 + F.floor("value").cast("bigint") % 50).alias("quantity"))
    reset = F.col("event_type") == "RESET"
    raw = numbered(raw, ["symbol"], ["timestamp_ns", "event_id"], "sequence_number", "timestamp_ns", DAY)
    return raw.select("symbol", "timestamp_ns", "sequence_number", "event_type", F.when(~reset, F.col("side")).cast("tinyint").alias("side"), F.when(reset, 0).otherwise(F.col("price_ticks")).cast("bigint").alias("price_ticks"), F.when(reset, 0).otherwise(F.col("quantity")).cast("bigint").alias("quantity"))


L2_SQL = f"""l2 AS (SELECT symbol, timestamp_ns, CAST(row_number() OVER (PARTITION BY symbol ORDER BY timestamp_ns, event_id) - 1 AS BIGINT) AS sequence_number,
 kind AS event_type, CASE WHEN kind = 'RESET' THEN NULL ELSE CAST(side AS TINYINT) END AS side,
 CAST(CASE WHEN kind = 'RESET' THEN 0 ELSE price_ticks END AS BIGINT) AS price_ticks, CAST(CASE WHEN kind = 'RESET' THEN 0 ELSE quantity END AS BIGINT) AS quantity
 FROM (SELECT event_id, user_id % {SYMBOLS} AS symbol, epoch_us(ts) * 1000 AS timestamp_ns,
  CASE WHEN event_id % {RESET_EVERY} = 0 THEN 'RESET' WHEN event_type IN ('signup', 'view') THEN 'ADD' WHEN event_type = 'click' THEN 'SNAPSHOT' WHEN event_type = 'purchase' THEN 'TRADE' ELSE 'CANCEL' END AS kind,
  CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side,
  CASE WHEN event_id % 2 = 0 THEN {MID - 1} - (event_id // 2) % {LEVELS} ELSE {MID + 1} + (event_id // 2) % {LEVELS} END AS price_ticks,
  1 + CAST(floor(value) AS BIGINT) % 50 AS quantity FROM events))"""
EPOCH_SQL = L2_SQL + """, l2e AS (SELECT *, CAST(sum(CASE WHEN event_type = 'RESET' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY sequence_number) AS BIGINT) AS epoch FROM l2)"""
LEVEL_SQL = EPOCH_SQL + """, lv0 AS (SELECT *, sum(CASE WHEN event_type IN ('ADD', 'SNAPSHOT') THEN quantity ELSE -quantity END) OVER (PARTITION BY symbol, epoch, side, price_ticks ORDER BY sequence_number) AS s
 FROM l2e WHERE event_type <> 'RESET'),
 lv1 AS (SELECT *, CAST(s - least(0, min(s) OVER (PARTITION BY symbol, epoch, side, price_ticks ORDER BY sequence_number)) AS BIGINT) AS qty_after FROM lv0),
 lv AS (SELECT *, coalesce(lag(qty_after) OVER k, 0) AS qty_before, lead(sequence_number, 1, 9223372036854775807) OVER k AS seq_to FROM lv1 WINDOW k AS (PARTITION BY symbol, epoch, side, price_ticks ORDER BY sequence_number))"""
BBO_SQL = LEVEL_SQL + """, best AS (SELECT e.symbol, e.sequence_number, max(CASE WHEN l.side = 1 THEN l.price_ticks END) AS best_bid_ticks, min(CASE WHEN l.side = -1 THEN l.price_ticks END) AS best_ask_ticks,
 max_by(l.qty_after, CASE WHEN l.side = 1 THEN l.price_ticks END) AS bq, min_by(l.qty_after, CASE WHEN l.side = -1 THEN l.price_ticks END) AS aq
 FROM l2e e LEFT JOIN lv l ON l.symbol = e.symbol AND l.epoch = e.epoch AND l.sequence_number <= e.sequence_number AND e.sequence_number < l.seq_to AND l.qty_after > 0 GROUP BY 1, 2),
 market AS (SELECT e.*, b.best_bid_ticks, b.best_ask_ticks, CASE WHEN b.best_bid_ticks IS NULL THEN 0 ELSE b.bq END AS best_bid_quantity, CASE WHEN b.best_ask_ticks IS NULL THEN 0 ELSE b.aq END AS best_ask_quantity,
 b.best_ask_ticks - b.best_bid_ticks AS spread_ticks, (b.best_bid_ticks + b.best_ask_ticks) / 2.0 AS midpoint_ticks FROM l2e e JOIN best b USING (symbol, sequence_number))"""
