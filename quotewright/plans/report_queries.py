"""Queries over runs made from the given tables: plot data sets, comparisons, checks of artifacts; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import artifacts, comparison, metrics, plots
from ..sources import runs
from ..sources.shared import shared_path, written
from .bindings import L2_SQL, table
from .book_queries import market
from .run_queries import _FILLS, BACK_SQL, HORIZONS, PNL_SQL, TICK, fills_of, pnl_of

FEE = 0.002


def _folder(spark, sf_dir, *names):
    """A run folder with the tables asked for, some under their second names, as a run would leave it."""
    folder = shared_path(spark, "run")
    m = written(market(spark, sf_dir))
    f = fills_of(m)
    if "market" in names:
        m.select("symbol", "timestamp_ns", "sequence_number", "midpoint_ticks").write.parquet(f"{folder}/market_states.parquet")
    if "fills" in names:
        f.select("symbol", "side", "price_ticks", "quantity", F.col("fill_timestamp_ns").alias("exchange_fill_timestamp_ns"), (F.col("quantity") * 3 % 17).alias("external_ahead")).write.parquet(f"{folder}/fills.parquet")
    if "pnl" in names:
        p = written(pnl_of(m))
        net = F.col("gross_ticks") - F.lit(FEE) * F.col("turnover_ticks")
        at = [F.col("fill_timestamp_ns").alias("timestamp_ns"), F.col("fill_id").alias("row_no")]
        p.select("symbol", *at, F.col("gross_ticks").alias("gross_pnl"), net.alias("net_pnl")).write.parquet(f"{folder}/pnl.parquet")
        p.select("symbol", *at, "inventory").write.parquet(f"{folder}/inventory.parquet")
    if "markouts" in names:
        metrics.markouts(f, m, HORIZONS, TICK).select("symbol", "horizon_ns", "markout_ticks").write.parquet(f"{folder}/markouts.parquet")
    return folder


def _symbol():
    return F.col("symbol").cast("bigint").alias("symbol")


def report_series(spark, sf_dir):
    """Midpoint, inventory, gross and net P&L and drawdown of each symbol in 200 pixel columns, from a run's folder."""
    t = runs.tables(spark, _folder(spark, sf_dir, "market", "pnl"))
    pnl = plots.falls(t["pnl"].where("net_pnl is not null"), "net_pnl", "row_no")
    one = lambda df, series, y, order: df.select("symbol", F.lit(series).alias("series"), "timestamp_ns", F.col(order).alias("sequence_number"), F.col(y).alias("y"))
    every = one(t["market"], "midpoint", "midpoint_ticks", "sequence_number").union(one(t["inventory"], "inventory", "inventory", "row_no"))
    every = every.union(one(t["pnl"], "gross_pnl", "gross_pnl", "row_no")).union(one(t["pnl"], "net_pnl", "net_pnl", "row_no")).union(one(pnl, "drawdown", "fall", "row_no"))
    out = plots.pixel_columns(every, ["symbol", "series"], columns=200)
    return out.select(_symbol(), "series", "x0", "column", *[F.round(c, 6).alias(c) for c in ("first", "last", "lowest", "highest")], "n")


_NET = f"{PNL_SQL}, tu AS (SELECT symbol, fill_id, CAST(sum(quantity * price_ticks) OVER (PARTITION BY symbol ORDER BY fill_id) AS BIGINT) AS turnover FROM fl), np AS (SELECT pl.*, CAST(gross_ticks AS DOUBLE) - CAST({FEE} AS DOUBLE) * turnover AS net FROM pl JOIN tu USING (symbol, fill_id))"
SERIES = f"""WITH {_NET}, s AS (SELECT symbol, 'midpoint' AS series, timestamp_ns AS x, sequence_number AS o, CAST(midpoint_ticks AS DOUBLE) AS y FROM market UNION ALL SELECT symbol, 'inventory', fill_timestamp_ns, fill_id, CAST(inventory AS DOUBLE) FROM np
  UNION ALL SELECT symbol, 'gross_pnl', fill_timestamp_ns, fill_id, CAST(gross_ticks AS DOUBLE) FROM np UNION ALL SELECT symbol, 'net_pnl', fill_timestamp_ns, fill_id, net FROM np
  UNION ALL SELECT symbol, 'drawdown', fill_timestamp_ns, fill_id, max(net) OVER (PARTITION BY symbol ORDER BY fill_id) - net FROM np WHERE net IS NOT NULL),
 e AS (SELECT symbol, series, min(x) AS x0, max(x) AS x1 FROM s WHERE y IS NOT NULL GROUP BY ALL),
 c AS (SELECT s.*, x0, least(CAST(floor(CAST(x - x0 AS DOUBLE) / CAST(x1 - x0 + 1 AS DOUBLE) * 200) AS BIGINT), 199) AS "column" FROM s JOIN e USING (symbol, series) WHERE y IS NOT NULL)
SELECT symbol, series, x0, "column", round(arg_min(y, o), 6) AS first, round(arg_max(y, o), 6) AS last, round(min(y), 6) AS lowest, round(max(y), 6) AS highest, count(*) AS n FROM c GROUP BY symbol, series, x0, "column\""""


def report_points(spark, sf_dir):
    """Fills by side as markers: how many stand at a price in each of 100 pixel columns."""
    f = runs.tables(spark, _folder(spark, sf_dir, "fills"), ("fills",))["fills"]
    sided = f.withColumn("side", plots.side_name(F.col("side"))).where("side is not null")
    return plots.points(sided, ["symbol", "side"], "timestamp_ns", "price_ticks", 100).select(_symbol(), "side", "x0", "column", F.col("y").alias("price_ticks"), "n")


POINTS = f"""WITH {L2_SQL}, {_FILLS}, s AS (SELECT symbol, CASE WHEN side = 1 THEN 'bid' ELSE 'ask' END AS side, fill_timestamp_ns AS x, CAST(price_ticks AS DOUBLE) AS y FROM fl), e AS (SELECT symbol, side, min(x) AS x0, max(x) AS x1 FROM s GROUP BY ALL)
SELECT symbol, side, x0, least(CAST(floor(CAST(x - x0 AS DOUBLE) / CAST(x1 - x0 + 1 AS DOUBLE) * 100) AS BIGINT), 99) AS "column", y AS price_ticks, count(*) AS n FROM s JOIN e USING (symbol, side) GROUP BY ALL"""


def report_distributions(spark, sf_dir):
    """Histograms of markouts, inventory and the quantity ahead, over all symbols; the orders table is absent, so fills tell what was ahead."""
    t = runs.tables(spark, _folder(spark, sf_dir, "fills", "pnl", "markouts"))
    ahead = t["orders"].select("queue_ahead").union(t["fills"].select("queue_ahead"))
    named = lambda name, df, c: df.select(F.lit(name).alias("series"), F.col(c).alias("v"))
    roots = plots.distributions(named("markout_ticks", t["markouts"], "markout_ticks").union(named("queue_ahead", ahead, "queue_ahead")), ["series"], "v")
    wholes = plots.distributions(named("inventory", t["inventory"], "inventory"), ["series"], "v", plots.whole_bins)
    return roots.union(wholes)


DISTRIBUTIONS = f"""WITH {PNL_SQL}, mids AS (SELECT symbol, timestamp_ns, sequence_number, CAST(midpoint_ticks AS DOUBLE) AS mid FROM market WHERE midpoint_ticks IS NOT NULL),
 tg AS (SELECT f.*, h.h AS horizon_ns, f.fill_timestamp_ns + h.h AS t FROM fl f CROSS JOIN (VALUES ({HORIZONS[0]}), ({HORIZONS[1]}), ({HORIZONS[2]})) h(h)),
 first AS (SELECT * FROM mids QUALIFY row_number() OVER (PARTITION BY symbol, timestamp_ns ORDER BY sequence_number) = 1),
 mk AS (SELECT tg.side * (first.mid - tg.price_ticks) AS v FROM tg ASOF JOIN first ON tg.symbol = first.symbol AND tg.t <= first.timestamp_ns),
 s AS (SELECT 'markout_ticks' AS series, CAST(v AS DOUBLE) AS v FROM mk WHERE v IS NOT NULL UNION ALL SELECT 'queue_ahead', CAST(quantity * 3 % 17 AS DOUBLE) FROM fl UNION ALL SELECT 'inventory', CAST(inventory AS DOUBLE) FROM pl),
 e AS (SELECT series, min(v) AS low, max(v) AS high, CASE WHEN series = 'inventory' THEN greatest(1, least(40, CAST(ceil(max(v)) - floor(min(v)) AS BIGINT) + 1)) ELSE least(30, greatest(5, CAST(round_even(sqrt(count(*)), 0) AS BIGINT))) END AS bins FROM s GROUP BY 1)
SELECT series, bins, low, high, least(CAST(floor((v - low) * bins / (high - low)) AS BIGINT), bins - 1) AS bin, count(*) AS n FROM s JOIN e USING (series) GROUP BY ALL"""


def report_sensitivity(spark, sf_dir):
    """Mean markout against a latency, per symbol as strategy: lines of a sweep whose table has some of the columns that lines are made of."""
    t = runs.tables(spark, _folder(spark, sf_dir, "markouts"), ("markouts", "latency_sensitivity"))
    sweep = t["markouts"].groupBy(F.concat(F.lit("s"), "symbol").alias("strategy"), F.lit(1).alias("fee_multiplier"), F.col("horizon_ns").alias("order_entry_latency_ns")).agg(F.round(F.avg("markout_ticks"), 6).alias("markout_ticks"))
    return plots.sensitivity(t["latency_sensitivity"]).union(plots.sensitivity(sweep))


SENSITIVITY = f"""WITH {BACK_SQL}, mids AS (SELECT symbol, timestamp_ns, sequence_number, CAST(midpoint_ticks AS DOUBLE) AS mid FROM market WHERE midpoint_ticks IS NOT NULL),
 tg AS (SELECT f.*, h.h AS horizon_ns, f.fill_timestamp_ns + h.h AS t FROM fl f CROSS JOIN (VALUES ({HORIZONS[0]}), ({HORIZONS[1]}), ({HORIZONS[2]})) h(h)),
 first AS (SELECT * FROM mids QUALIFY row_number() OVER (PARTITION BY symbol, timestamp_ns ORDER BY sequence_number) = 1)
SELECT 's' || tg.symbol || ' · 1' AS label, horizon_ns / 1000.0::DOUBLE AS latency_us, round(avg(tg.side * (first.mid - tg.price_ticks)), 6) AS y FROM tg ASOF JOIN first ON tg.symbol = first.symbol AND tg.t <= first.timestamp_ns GROUP BY 1, 2"""


def _runs(spark, sf_dir):
    """Line numbers of lineitem as runs of one stream, with the documents that runs have."""
    l = table(spark, sf_dir, "lineitem").withColumn("run", F.concat(F.lit("line-"), F.col("l_linenumber").cast("string")))  # noqa: E741
    price = F.col("l_extendedprice").cast("double")
    g = l.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("fills"), F.sum(F.floor(price).cast("bigint")).alias("turnover"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"), F.count_if(F.col("l_discount") > 0.05).alias("risk"))
    d = lambda c: F.col(c).cast("double")
    doc = F.struct(
        F.struct(F.lit(1_000_000).cast("bigint").alias("events_processed")).alias("engineering"), F.struct(F.col("fills").alias("fill_events"), (d("fills") / d("n")).alias("fill_rate"), d("turnover").alias("turnover")).alias("trading_activity"),
        F.struct((d("turnover") / 100).alias("gross_pnl"), d("quantity").alias("fees"), F.when(F.col("fills") % 2 == 0, d("fills")).otherwise(float("nan")).alias("rebates"), (d("turnover") / 100 - d("quantity")).alias("net_pnl")).alias("pnl"),
        F.struct(F.col("quantity").alias("end_of_session"), (d("quantity") / d("n")).alias("mean_absolute")).alias("inventory"), F.struct(F.col("risk").alias("event_count")).alias("risk"),
    )
    shared = F.struct(F.when(F.col("run") != "line-3", F.col("run")).alias("run_name"), F.lit("x").alias("symbol"), F.lit("abc").alias("event_stream_sha256"), F.struct(F.lit("recorded").alias("kind")).alias("dataset_provenance"))
    return g.select(F.concat(F.lit("folder-"), "run").alias("folder"), doc.alias("metrics"), shared.alias("summary"), F.struct((F.col("n") * 3).alias("scheduler_events_processed")).alias("diagnostics"), F.struct(F.struct(F.lower("run").alias("name")).alias("strategy")).alias("config"))


def run_comparison(spark, sf_dir):
    """Eighteen columns of each run, once all are found to be of one stream, symbol, event count and provenance."""
    out = comparison.compare(_runs(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in out.dtypes])


_G = """g AS (SELECT 'line-' || l_linenumber AS run, count(*) AS n, CAST(count_if(l_returnflag = 'R') AS BIGINT) AS fills, CAST(sum(CAST(floor(CAST(l_extendedprice AS DOUBLE)) AS BIGINT)) AS BIGINT) AS turnover, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, CAST(count_if(l_discount > 0.05) AS BIGINT) AS risk FROM lineitem GROUP BY 1)"""
COMPARISON = f"""WITH {_G} SELECT CASE WHEN run = 'line-3' THEN 'folder-line-3' ELSE run END AS run_name, run AS strategy, 'x' AS symbol, CAST(1000000 AS BIGINT) AS events_processed, fills AS fill_events, round(CAST(fills AS DOUBLE) / CAST(n AS DOUBLE), 6) AS fill_rate,
 CAST(turnover AS DOUBLE) AS turnover, round(CAST(turnover AS DOUBLE) / 100, 6) AS gross_pnl, CAST(quantity AS DOUBLE) AS fees, CASE WHEN fills % 2 = 0 THEN CAST(fills AS DOUBLE) END AS rebates, round(CAST(turnover AS DOUBLE) / 100 - CAST(quantity AS DOUBLE), 6) AS net_pnl,
 CAST(NULL AS DOUBLE) AS maximum_drawdown, quantity AS end_inventory, round(CAST(quantity AS DOUBLE) / CAST(n AS DOUBLE), 6) AS mean_absolute_inventory, CAST(NULL AS DOUBLE) AS time_near_limits_fraction, risk AS risk_event_count, round(CAST(n * 3 AS DOUBLE) / 1000000, 6) AS scheduler_events_per_market_event,
 CAST(NULL AS DOUBLE) AS realized_spread_ticks FROM g"""


def run_identity(spark, sf_dir):
    """What runs must share, of runs whose symbols and streams differ by rule."""
    r = _runs(spark, sf_dir)
    mixed = r.withColumn("summary", F.struct("summary.run_name", F.when(F.col("folder") != "folder-line-4", "summary.symbol").alias("symbol"), F.expr("right(folder, 1)").alias("event_stream_sha256"), F.when(F.col("folder") != "folder-line-5", F.col("summary.dataset_provenance")).alias("dataset_provenance")))
    return comparison.identity(mixed)


IDENTITY = f"""WITH {_G}, m AS (SELECT run AS s FROM g) SELECT 'event_stream_sha256' AS field, count(DISTINCT s[-1:]) AS n_values, CAST(0 AS BIGINT) AS n_missing FROM m UNION ALL SELECT 'symbol', count(DISTINCT CASE WHEN s = 'line-4' THEN 'unknown' ELSE 'x' END), 0 FROM m
 UNION ALL SELECT 'event_count', 1, 0 UNION ALL SELECT 'dataset_provenance', 1, CAST(count_if(s = 'line-5') AS BIGINT) FROM m"""


def report_table(spark, sf_dir):
    """The first hundred suppliers and line numbers by revenue, as a report shows its cases, and how many there are."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    cases = l.groupBy("l_suppkey", "l_linenumber").agg(F.sum(F.floor(F.col("l_extendedprice").cast("double")).cast("bigint")).alias("revenue"), F.count("*").alias("n"))
    return comparison.ranked(cases, [F.desc("revenue"), "l_suppkey", "l_linenumber"])


TABLE = """WITH c AS (SELECT l_suppkey, l_linenumber, CAST(sum(CAST(floor(CAST(l_extendedprice AS DOUBLE)) AS BIGINT)) AS BIGINT) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT *, (SELECT count(*) FROM c) AS n_cases FROM c ORDER BY revenue DESC, l_suppkey, l_linenumber LIMIT 100"""


def artifact_checks(spark, sf_dir):
    """Breaches in a table of experiment cases made from orders and spoiled by rule, and in line items as fills of them."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    cases = o.select(
        F.when(k % 97 == 0, F.lit("")).when(k % 89 == 0, F.lit("case-1")).otherwise(F.concat(F.lit("case-"), k.cast("string"))).alias("run_name"), F.when(k % 83 == 0, F.lit(None)).when(k % 79 == 0, 7).otherwise(500).cast("bigint").alias("events_processed"),
        (k % 71 != 0).alias("synthetic_demonstration"), F.col("o_orderpriority").alias("strategy"),
    )
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    fills = [artifacts.Check("quantity is positive", each="l_quantity > 0"), artifacts.Check("discount is at most 0.05", each="l_discount <= 0.05"), artifacts.Check("a line is one row", unique=("l_orderkey", "l_linenumber")), artifacts.Check("has a venue", each="venue <> ''", needs=("venue",))]
    return artifacts.breaches(cases, "cases", artifacts.experiment_checks(500, 1000, True)).union(artifacts.breaches(l, "fills", fills))


CHECKS = """WITH c AS (SELECT CASE WHEN o_orderkey % 97 = 0 THEN '' WHEN o_orderkey % 89 = 0 THEN 'case-1' ELSE 'case-' || o_orderkey END AS run_name, CASE WHEN o_orderkey % 83 = 0 THEN NULL WHEN o_orderkey % 79 = 0 THEN 7 ELSE 500 END AS events_processed, o_orderkey % 71 <> 0 AS s FROM orders),
 r AS (SELECT 'cases' AS "table", unnest([1, count_if(run_name = ''), count(*) - count(DISTINCT run_name), count_if(coalesce(events_processed, 0) <> 500), count_if(NOT s), abs(count(*) - 1000)]) AS breaches,
   unnest(['required columns', 'run_name is a name', 'run_name is unique', 'events_processed is the runs''', 'classification is the runs''', 'case_count is the number of rows']) AS "check" FROM c
  UNION ALL SELECT 'fills', unnest([count_if(NOT l_quantity > 0), count_if(NOT l_discount <= 0.05), count(*) - count(DISTINCT (l_orderkey, l_linenumber)), 1]), unnest(['quantity is positive', 'discount is at most 0.05', 'a line is one row', 'has a venue']) FROM lineitem)
SELECT "table", "check", CAST(breaches AS BIGINT) AS breaches FROM r"""

QUERIES = {
    "report_series": (report_series, SERIES), "report_points": (report_points, POINTS), "report_distributions": (report_distributions, DISTRIBUTIONS), "report_sensitivity": (report_sensitivity, SENSITIVITY),
    "run_comparison": (run_comparison, COMPARISON), "run_identity": (run_identity, IDENTITY), "report_table": (report_table, TABLE), "artifact_checks": (artifact_checks, CHECKS),
}
