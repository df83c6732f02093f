"""Queries over files that are written from the given tables in a vendor's or the canonical form and read back, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.running import BUCKET, numbered
from ..sources import canonical
from ..sources.incremental import IncrementalAdapter
from ..sources.paired import PairedAdapter
from ..sources.shared import shared_path, written
from .bindings import L2_SQL, l2, table

CANONICAL_SQL = f"WITH {L2_SQL} SELECT symbol, timestamp_ns, sequence_number, event_type, side, price_ticks, quantity FROM l2"


def canonical_csv_roundtrip(spark, sf_dir):
    """The stream written as canonical CSV and loaded again: text cells, null tokens, exact casts."""
    path = canonical.write_csv(l2(spark, sf_dir), shared_path(spark, "events") + ".csv")
    return canonical.load(spark, path, keys=("symbol",)).withColumn("symbol", F.col("symbol").cast("bigint"))


def canonical_parquet_roundtrip(spark, sf_dir):
    """The stream written as Parquet partitioned by symbol and loaded again, after a check of the row contract."""
    path = canonical.write_parquet(l2(spark, sf_dir), shared_path(spark, "events") + ".parquet", ("symbol",))
    return canonical.load_events(spark, path, keys=("symbol",)).withColumn("symbol", F.col("symbol").cast("bigint"))


def _arrivals(spark, sf_dir):
    """events in the order they arrive, with row for each symbol."""
    e = table(spark, sf_dir, "events")
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    e = e.select((F.col("user_id") % 5).alias("s"), "event_id", us.alias("us"), "event_type", (1 + F.floor("value").cast("bigint") % 50).alias("q"))
    return e.withColumn("row", F.row_number().over(Window.partitionBy("s").orderBy("us", "event_id")).cast("bigint"))


_ARRIVALS = """a AS (SELECT user_id % 5 AS s, event_id, epoch_us(ts) AS us, event_type, 1 + CAST(floor(value) AS BIGINT) % 50 AS q, row_number() OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS row FROM events)"""


def incremental_adapter(spark, sf_dir):
    """events as absolute amounts of levels, a snapshot row at every 40th, written as CSV, read as text and turned into canonical events."""
    even = F.col("event_id") % 2 == 0
    ticks = F.when(even, 9_999 - F.expr("(event_id div 2) % 8")).otherwise(10_001 + F.expr("(event_id div 2) % 8"))
    vendor = _arrivals(spark, sf_dir).select(
        F.lit("x").alias("exchange"), F.col("s").cast("string").alias("symbol"), F.col("us").alias("timestamp"), (F.col("us") + 7).alias("local_timestamp"), (F.col("event_id") % 40 == 0).cast("string").alias("is_snapshot"), F.when(even, "bid").otherwise("ask").alias("side"),
        (ticks.cast("decimal(12,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").alias("price"), F.when(F.col("event_type") == "purchase", 0).otherwise(F.col("q")).alias("amount"), "row",
    )
    path = canonical.write_csv(vendor, shared_path(spark, "vendor"))
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    out = IncrementalAdapter("0.01").checked(raw.withColumn("row", F.col("row").cast("bigint")), keys=("exchange", "symbol")).drop("exchange")
    return out.withColumn("symbol", F.col("symbol").cast("bigint"))


INCREMENTAL = f"""WITH {_ARRIVALS}, b AS (SELECT s AS symbol, row, (us + 7) * 1000 AS timestamp_ns, event_id % 40 = 0 AS snap, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side,
 CASE WHEN event_id % 2 = 0 THEN 9999 - (event_id // 2) % 8 ELSE 10001 + (event_id // 2) % 8 END AS price_ticks, CASE WHEN event_type = 'purchase' THEN 0 ELSE q END AS amount FROM a),
 e AS (SELECT *, snap AND NOT coalesce(lag(snap) OVER (PARTITION BY symbol ORDER BY row), false) AS edge FROM b),
 p AS (SELECT *, sum(CAST(edge AS INTEGER)) OVER (PARTITION BY symbol ORDER BY row) AS epoch FROM e),
 c AS (SELECT *, amount - coalesce(lag(amount) OVER (PARTITION BY symbol, epoch, side, price_ticks ORDER BY row), 0) AS change FROM p WHERE epoch > 0),
 o AS (SELECT symbol, row, 0 AS n, timestamp_ns, 'RESET' AS event_type, NULL AS side, 0 AS price_ticks, 0 AS quantity FROM c WHERE edge
  UNION ALL SELECT symbol, row, 1, timestamp_ns, 'SNAPSHOT', side, price_ticks, amount FROM c WHERE snap AND amount > 0
  UNION ALL SELECT symbol, row, 1, timestamp_ns, CASE WHEN change > 0 THEN 'ADD' ELSE 'CANCEL' END, side, price_ticks, abs(change) FROM c WHERE NOT snap AND change <> 0)
SELECT symbol, timestamp_ns, CAST(row_number() OVER (PARTITION BY symbol ORDER BY row, n) - 1 AS BIGINT) AS sequence_number, event_type, CAST(side AS TINYINT) AS side, CAST(price_ticks AS BIGINT) AS price_ticks, CAST(quantity AS BIGINT) AS quantity FROM o"""


def incremental_trades(spark, sf_dir):
    """The same stream with trades: purchases and clicks are taker trades of their level, which explain its reductions within six hours."""
    even = F.col("event_id") % 2 == 0
    ticks = F.when(even, 9_999 - F.expr("(event_id div 2) % 4")).otherwise(10_001 + F.expr("(event_id div 2) % 4"))
    price = (ticks.cast("decimal(12,2)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(12,2)").cast("string")
    a = written(_arrivals(spark, sf_dir))
    both = [F.lit("x").alias("exchange"), F.col("s").cast("string").alias("symbol"), F.col("us").alias("timestamp"), F.col("us").alias("local_timestamp"), price.alias("price"), "row"]
    trade = F.col("event_type").isin("purchase", "click")
    book = a.where(~trade).select(*both, (F.col("event_id") % 200 == 0).cast("string").alias("is_snapshot"), F.when(even, "bid").otherwise("ask").alias("side"), F.col("q").alias("amount"))
    trades = a.where(trade).select(*both, F.when(F.col("event_id") % 14 == 0, "unknown").when(even, "sell").otherwise("buy").alias("side"), (1 + F.col("q") % 9).alias("amount"))
    out = IncrementalAdapter("0.01", trade_match_window_ns=_WINDOW).checked(book, trades, keys=("exchange", "symbol")).drop("exchange")
    return out.withColumn("symbol", F.col("symbol").cast("bigint"))


_WINDOW = 6 * 3_600 * 10**9
# Pairs of a trade and a reduction are walked in the order in which trades take; l holds what is left of each reduction of a level.
INCREMENTAL_TRADES = f"""WITH RECURSIVE {_ARRIVALS}, r0 AS (SELECT s AS symbol, row, us * 1000 AS t, event_id, event_type IN ('purchase', 'click') AS trade, event_id % 200 = 0 AS snap, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side,
  CASE WHEN event_id % 2 = 0 THEN 9999 - (event_id // 2) % 4 ELSE 10001 + (event_id // 2) % 4 END AS price, q FROM a),
 b0 AS (SELECT *, snap AND NOT coalesce(lag(snap) OVER (PARTITION BY symbol ORDER BY row), false) AS edge FROM r0 WHERE NOT trade),
 b1 AS (SELECT *, sum(CAST(edge AS INTEGER)) OVER (PARTITION BY symbol ORDER BY row) AS epoch FROM b0),
 b AS (SELECT *, q - coalesce(lag(q) OVER (PARTITION BY symbol, epoch, side, price ORDER BY row), 0) AS change FROM b1 WHERE epoch > 0),
 red AS (SELECT symbol, side, price, row, t, -change AS q, row_number() OVER (PARTITION BY symbol, side, price ORDER BY t, row) AS j FROM b WHERE NOT snap AND change < 0),
 tr AS (SELECT symbol, side, price, row, t, 1 + q % 9 AS q FROM r0 WHERE trade AND event_id % 14 <> 0),
 pairs AS (SELECT symbol, side, price, tr.row AS trade, tr.q, red.j, row_number() OVER (PARTITION BY symbol, side, price ORDER BY tr.row, abs(red.t - tr.t), red.t, red.row) AS k, row_number() OVER (PARTITION BY symbol, side, price, tr.row ORDER BY abs(red.t - tr.t), red.t, red.row) = 1 AS new
  FROM tr JOIN red USING (symbol, side, price) WHERE abs(red.t - tr.t) <= {_WINDOW}),
 walk AS (SELECT symbol, side, price, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS rest, list(CAST(q AS BIGINT) ORDER BY j) AS l FROM red GROUP BY ALL
  UNION ALL SELECT symbol, side, price, k, rest - least(rest, l[j]), list_transform(l, lambda x, i: CASE WHEN i = j THEN x - least(rest, x) ELSE x END)
  FROM (SELECT w.symbol, w.side, w.price, p.k, CASE WHEN p.new THEN CAST(p.q AS BIGINT) ELSE w.rest END AS rest, w.l, p.j FROM walk w JOIN pairs p ON p.symbol = w.symbol AND p.side = w.side AND p.price = w.price AND p.k = w.k + 1)),
 last AS (SELECT symbol, side, price, arg_max(l, k) AS l FROM walk GROUP BY ALL),
 m AS (SELECT red.symbol, red.row, red.q - last.l[red.j] AS matched FROM red JOIN last USING (symbol, side, price)),
 c AS (SELECT b.*, coalesce(m.matched, 0) AS matched FROM b LEFT JOIN m USING (symbol, row)),
 o AS (SELECT symbol, row, 0 AS n, t, 'RESET' AS event_type, NULL AS side, 0 AS price, 0 AS quantity FROM c WHERE edge
  UNION ALL SELECT symbol, row, 1, t, 'SNAPSHOT', side, price, q FROM c WHERE snap AND q > 0
  UNION ALL SELECT symbol, row, 1, t, 'ADD', side, price, change FROM c WHERE NOT snap AND change > 0
  UNION ALL SELECT symbol, row, 1, t, 'TRADE', side, price, matched FROM c WHERE NOT snap AND matched > 0
  UNION ALL SELECT symbol, row, 2, t, 'CANCEL', side, price, -change - matched FROM c WHERE NOT snap AND -change > matched)
SELECT symbol, t AS timestamp_ns, CAST(row_number() OVER (PARTITION BY symbol ORDER BY row, n) - 1 AS BIGINT) AS sequence_number, event_type, CAST(side AS TINYINT) AS side, CAST(price AS BIGINT) AS price_ticks, CAST(quantity AS BIGINT) AS quantity FROM o"""


def _paired(spark, sf_dir):
    """(messages, book) of one day of one instrument, made from events: headerless files of one line per event id."""
    e = table(spark, sf_dir, "events").select("event_id", F.floor("value").cast("bigint").alias("v"))
    e = numbered(e.withColumn("_o", F.coalesce("event_id", F.lit(-(1 << 62)))), [], ["event_id"], "i", "_o", BUCKET).drop("_o")  # null ids come first
    time = F.expr("cast(34200 + cast(i as decimal(20,6)) / 1000 as decimal(20,6))").cast("string")
    ask, bid = F.expr("1000100 + 100 * (v % 3)"), F.expr("999900 - 100 * (v div 3 % 3)")
    messages = e.select("i", time.alias("c0"), F.expr("cast(1 + event_id % 5 as string)").alias("c1"), F.col("event_id").cast("string").alias("c2"), F.expr("cast(1 + v % 4 as string)").alias("c3"), F.expr("cast(case when event_id % 2 = 0 then 999900 - 100 * (v div 3 % 3) else 1000100 + 100 * (v % 3) end as string)").alias("c4"), F.expr("case when event_id % 2 = 0 then '1' else '-1' end").alias("c5"))
    level = lambda price, size: (price.cast("string"), size.cast("string"))
    cells = [c for p, q in ((ask, F.expr("1 + v % 7")), (bid, F.expr("1 + v % 5")), (ask + 1000, F.expr("v % 6")), (bid - 1000, F.expr("v % 4"))) for c in level(p, q)]
    book = e.select("i", *[c.alias(f"c{k}") for k, c in enumerate(cells)])
    return messages, book


def paired_adapter(spark, sf_dir):
    """Message and book files of one line per event, written headerless, read with their line numbers, and turned into canonical events."""
    parts = []
    for name, df in zip(("messages", "book"), _paired(spark, sf_dir)):
        path = shared_path(spark, name)
        df.repartitionByRange(4, "i").sortWithinPartitions("i").drop("i").write.csv(path)
        parts.append(written(canonical.read_vendor_csv(spark, path, False)))
    return PairedAdapter("0.01", "2024-01-02", 2, "UTC").checked(*parts)


_BOOK = "SELECT i, event_id, {side} AS side, {price} // 100 AS price_ticks, {size} AS q FROM e"
_SIDES = " UNION ALL ".join(
    _BOOK.format(side=s, price=p, size=q) for s, p, q in ((-1, "(1000100 + 100 * (v % 3))", "1 + v % 7"), (1, "(999900 - 100 * (v // 3 % 3))", "1 + v % 5"), (-1, "(1001100 + 100 * (v % 3))", "v % 6"), (1, "(998900 - 100 * (v // 3 % 3))", "v % 4"))
)
PAIRED = f"""WITH e AS (SELECT event_id, CAST(floor(value) AS BIGINT) AS v, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
 lv AS (SELECT * FROM ({_SIDES}) WHERE q > 0),
 d AS (SELECT coalesce(a.i, b.i + 1) AS i, coalesce(a.side, b.side) AS side, coalesce(a.price_ticks, b.price_ticks) AS price_ticks, coalesce(a.q, 0) - coalesce(b.q, 0) AS change
  FROM (SELECT * FROM lv WHERE i > 0) a FULL JOIN (SELECT * FROM lv WHERE i < (SELECT max(i) FROM e)) b ON a.i = b.i + 1 AND a.side = b.side AND a.price_ticks = b.price_ticks),
 m AS (SELECT i, 1 + event_id % 5 AS code, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS side, CASE WHEN event_id % 2 = 0 THEN 999900 - 100 * (v // 3 % 3) ELSE 1000100 + 100 * (v % 3) END // 100 AS price_ticks, 1 + v % 4 AS q FROM e),
 c AS (SELECT d.*, m.code, CASE WHEN m.code IS NULL THEN 0 WHEN m.code = 1 THEN least(m.q, greatest(change, 0)) ELSE -least(m.q, greatest(-change, 0)) END AS cause
  FROM d LEFT JOIN m ON m.i = d.i AND m.side = d.side AND m.price_ticks = d.price_ticks AND m.code BETWEEN 1 AND 4),
 o AS (SELECT 0 AS i, 0 AS stage, NULL AS side, 0 AS price_ticks, 'RESET' AS event_type, 0 AS quantity
  UNION ALL SELECT 0, 1, side, price_ticks, 'SNAPSHOT', q FROM lv WHERE i = 0
  UNION ALL SELECT i, 1, side, price_ticks, CASE WHEN cause > 0 THEN 'ADD' WHEN code = 4 THEN 'TRADE' ELSE 'CANCEL' END, abs(cause) FROM c WHERE cause <> 0
  UNION ALL SELECT i, 2, side, price_ticks, 'CANCEL', cause - change FROM c WHERE change - cause < 0
  UNION ALL SELECT i, 3, side, price_ticks, 'ADD', change - cause FROM c WHERE change - cause > 0)
SELECT 1704153600000000000 + 34200000000000 + i * 1000000 AS timestamp_ns, CAST(row_number() OVER (ORDER BY i, stage, coalesce(side, 2) DESC, -price_ticks * coalesce(side, 1)) - 1 AS BIGINT) AS sequence_number,
 event_type, CAST(side AS TINYINT) AS side, CAST(price_ticks AS BIGINT) AS price_ticks, CAST(quantity AS BIGINT) AS quantity FROM o"""

QUERIES = {
    "canonical_csv_roundtrip": (canonical_csv_roundtrip, CANONICAL_SQL), "canonical_parquet_roundtrip": (canonical_parquet_roundtrip, CANONICAL_SQL),
    "incremental_adapter": (incremental_adapter, INCREMENTAL), "incremental_trades": (incremental_trades, INCREMENTAL_TRADES), "paired_adapter": (paired_adapter, PAIRED),
}
