"""Mixing sources to target weights by Sainte-Laguë apportionment, native: SQL functions only.

Sources get weights, shares of a total and a limit of passes over their own words (targets). The total is cut into blocks of
as many words each, which go to the sources by highest quotients target / 1, target / 3, target / 5, ...; each source's blocks
go to its shards in the same way, by their words. In a shard the documents stand on a line in seeded order. Its quota is read
as whole passes over the line and, for the rest, blocks of the line at even steps from a seeded phase.

Highest quotients without listing them all: with n seats, m parties and shares p, a party's seats lie between
p * (n - m / 2) - 1/2 and p * (n + m / 2) + 1/2, as rounding moves each party by a half at most. All below is given at once;
the quotients between, about three a party, are ranked.

Scale: texts are read once; what is shuffled is a row of numbers a document. A shard is 65,536 words or a 65,536th of all
words, whichever is more, so that a hot source spreads over many tasks and no list of shards is long. The table of sources
(one row each) is ordered in one task. Joins are by keys, without hints.

Cases. Null or empty text: size 0, nothing taken. Null source: a source of its own, the last; an empty name is another source.
Null or repeated doc_id: every row counts by itself; equal rows are interchangeable. Empty table: no rows. A source smaller
than half a block may get nothing. Very long texts: any part of their line may be taken. Columns but doc_id, text and
source are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2
BLOCK, SEED = 32, 20_011
#: A shard holds about SHARD words, or one of SHARDS parts of all words if that is more.
SHARD, SHARDS = 1 << 16, 1 << 16
WORD = "[^\\x20\\x09-\\x0D]+"


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size (words) and two seeded draws that depend on a row's own values alone."""
    text = F.coalesce("text", F.lit(""))
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text))
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), drawn.alias("h"))
    return rows.select("doc_id", "source", "size", F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint").alias("draw"), F.substring("h", 9, 16).alias("place"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """sizes (source, source_size) with source_rank and target: share of all sizes by weight, none above limit times its size.

    Sources stop at their limit in the order of limit / weight; what the others get a weight unit then follows from sums.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))  # the table of sources: one row each
    s = sizes.withColumn("source_rank", F.row_number().over(by_name).cast("bigint"))
    s = s.withColumns({"_w": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int")), "_cap": F.col("source_size").cast("double") * limit})
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "source_rank")
    s = s.withColumns({"_all": F.sum("source_size").over(Window.partitionBy()) * F.lit(share), "_before": F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_rest": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("_free", F.col("_cap") * F.col("_rest") >= (F.col("_all") - F.col("_before")) * F.col("_w"))
    free = Window.partitionBy()
    left = F.col("_all") - F.coalesce(F.sum(F.when(~F.col("_free"), F.col("_cap"))).over(free), F.lit(0.0))
    unit = F.sum(F.when(F.col("_free"), F.col("_w"))).over(free)
    return s.select("source", "source_size", "source_rank", F.when(F.col("_free"), left * F.col("_w") / unit).otherwise(F.col("_cap")).alias("target"))


def highest_quotients(parties: DataFrame, group: list[str], order: str, votes: str, seats: Column, out: str) -> DataFrame:
    """parties with out: their seats in their group under votes / (2k + 1); among equal quotients the smaller order goes first."""
    w = Window.partitionBy(*group)
    names = parties.columns
    p = parties.withColumns({"_n": seats.cast("double"), "_v": F.col(votes).cast("double")}).withColumns({"_m": F.count("*").over(w), "_p": F.col("_v") / F.nullif(F.sum("_v").over(w), F.lit(0.0))})
    low = F.greatest(F.lit(0), F.floor(F.col("_p") * (F.col("_n") - F.col("_m") / 2) - 1.5))
    p = p.withColumns({"_low": F.when(F.col("_p") > 0, low).otherwise(0).cast("bigint"), "_high": F.ceil(F.col("_p") * (F.col("_n") + F.col("_m") / 2) + 1.5).cast("bigint")})
    p = p.withColumn("_open", F.col("_n").cast("bigint") - F.sum("_low").over(w))
    q = p.where(F.col("_p") > 0).select(*group, order, "_v", "_open", F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(F.col("_v") / (2 * F.col("_k") + 1)), order))
    won = q.withColumn("_won", (rank <= F.col("_open")).cast("bigint")).groupBy(*group, order).agg(F.sum("_won").alias("_more"))
    return p.join(won, [*group, order], "left").select(*names, (F.col("_low") + F.coalesce("_more", F.lit(0))).alias(out))


def mix(docs: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted), and where they come from:
    passes (whole copies), and start, phase, quota and blocks of its line, which spans() reads."""
    rows = scratch.cut(sized(docs, seed), "mix-sized")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    sources = highest_quotients(sources, [], "source_rank", "target", F.floor(F.sum("target").over(Window.partitionBy()) / block + 0.5), "n_blocks")
    width = F.greatest(F.lit(SHARD), F.expr(f"sum(source_size) over () div {SHARDS}"))
    sources = scratch.cut(sources.withColumn("n_shards", F.ceil(F.greatest("source_size", F.lit(1)) / width).cast("bigint")).withColumnRenamed("source", "_source"), "mix-sources")
    placed = rows.join(sources, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(F.col("draw"), F.col("n_shards")))
    line = ["source_rank", "shard"]
    shards = placed.groupBy(*line).agg(F.sum("size").alias("line_size"), F.first("n_blocks").alias("n_blocks"), F.first(F.col("target") >= F.col("source_size") * F.lit(float(limit))).alias("full"))
    shards = highest_quotients(shards, ["source_rank"], "shard", "line_size", F.col("n_blocks"), "won")
    whole = F.when(F.col("full"), limit).otherwise(F.least(F.lit(limit), F.coalesce(F.expr(f"won * {block} div nullif(line_size, 0)"), F.lit(0)))).cast("bigint")
    shards = shards.withColumns({"passes": whole, "blocks": F.expr(f"line_size div {block}")})
    rest = F.when(F.col("passes") >= limit, 0).otherwise(F.least("blocks", F.expr(f"(won * {block} - passes * line_size + {block // 2}) div {block}"))).cast("bigint")
    phase = F.when(F.col("blocks") > 0, F.pmod(F.col("shard") * 7919 + F.col("source_rank") * 104_729 + seed, F.col("blocks"))).otherwise(0)
    shards = shards.select(*line, "passes", "blocks", rest.alias("quota"), phase.alias("phase"))
    upto = Window.partitionBy(*line).orderBy("place", "draw", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    lined = placed.select("doc_id", "source", "size", "source_size", "target", *line, (F.sum("size").over(upto) - F.col("size")).alias("start"))
    out = lined.join(shards, line)

    def before(x: Column) -> Column:
        """Words of the quota's blocks before place x of the line."""
        x = F.least(x, F.col("blocks") * block)
        b = F.floor(x / block).cast("bigint")
        chosen = lambda i: F.floor((i * F.col("quota") + F.col("phase")) / F.col("blocks")).cast("bigint")
        first = F.lit(0)  # phase is below blocks
        return (chosen(b) - first) * block + (chosen(b + 1) - chosen(b)) * (x - b * block)

    part = F.when(F.col("quota") > 0, before(F.col("start") + F.col("size")) - before(F.col("start"))).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).cast("bigint").alias("taken"), "passes", "start", "phase", "quota", "blocks")


def spans(mixed: DataFrame, block: int = BLOCK) -> DataFrame:
    """mixed with spans: the words [start, end) of the document that are taken besides its whole passes, by block."""
    first, last = F.expr(f"start div {block}"), F.expr(f"least(blocks, (start + size + {block - 1}) div {block})")
    hits = F.expr(f"filter(sequence(_first, _last - 1), b -> ((b + 1) * quota + phase) div blocks > (b * quota + phase) div blocks)")
    cut = F.transform(hits, lambda b: F.struct(F.greatest(F.lit(0), b * block - F.col("start")).alias("start"), F.least("size", (b + 1) * block - F.col("start")).alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return mixed.withColumns({"_first": first, "_last": last}).withColumn("spans", F.when((F.col("quota") > 0) & (F.col("size") > 0) & (F.col("_last") > F.col("_first")), cut).otherwise(none)).drop("_first", "_last")


def op13_apportioned_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs, Scratch(spark)).select("doc_id", "size", "source_size", "target", "taken")


_quotients = lambda name, parties, group, order, votes, seats: f"""
{name}_q AS (SELECT p.{group}, p.{order}, row_number() OVER (PARTITION BY p.{group} ORDER BY p.{votes} / (2 * k + 1) DESC, p.{order}) AS i, {seats} AS n
  FROM {parties} p, generate_series(0, CAST(ceil(p.{votes} / {BLOCK}) AS BIGINT) + (SELECT count(*) FROM {parties})) AS g(k) WHERE p.{votes} > 0),
{name}_won AS (SELECT {group}, {order}, count(*) FILTER (i <= n) AS won FROM {name}_q GROUP BY ALL)"""  # noqa: E731
ORACLE = f"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
  md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_rank FROM s0),
s2 AS (SELECT *, CAST([3, 1, 2][(source_rank - 1) % 3 + 1] AS DOUBLE) AS w, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS every FROM s1),
s3 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  >= (every - coalesce(sum(cap) OVER (ORDER BY cap / w, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS free FROM s2),
s AS (SELECT 0 AS one, source, source_size, source_rank, CASE WHEN free THEN (every - coalesce(sum(cap) FILTER (NOT free) OVER (), 0)) * w / sum(w) FILTER (free) OVER () ELSE cap END AS target,
  CAST(ceil(greatest(source_size, 1) / greatest({SHARD}, sum(source_size) OVER () // {SHARDS})) AS BIGINT) AS n_shards FROM s3),
{_quotients("s", "s", "one", "source_rank", "target", f"CAST(floor((SELECT sum(target) FROM s) / {BLOCK} + 0.5) AS BIGINT)")},
p AS (SELECT r.doc_id, r.size, s.source_size, s.source_rank, s.target, coalesce(won, 0) AS n_blocks, CAST('0x' || h[1:8] AS BIGINT) % n_shards AS shard, h[9:24] AS place, CAST('0x' || h[1:8] AS BIGINT) AS draw
  FROM r JOIN s ON r.source IS NOT DISTINCT FROM s.source LEFT JOIN s_won USING (source_rank)),
l0 AS (SELECT source_rank, shard, CAST(sum(size) AS BIGINT) AS line_size, any_value(n_blocks) AS n_blocks, any_value(target >= 2 * source_size) AS whole FROM p GROUP BY ALL),
{_quotients("l", "l0", "source_rank", "shard", "line_size", "n_blocks").replace("CAST(ceil(p.line_size", "CAST(ceil(2 * p.line_size")},
l1 AS (SELECT l0.*, coalesce(won, 0) AS won, line_size // {BLOCK} AS blocks, CASE WHEN whole THEN 2 ELSE least(2, coalesce(coalesce(won, 0) * {BLOCK} // nullif(line_size, 0), 0)) END AS passes FROM l0 LEFT JOIN l_won USING (source_rank, shard)),
l AS (SELECT *, CASE WHEN passes >= 2 THEN 0 ELSE least(blocks, (won * {BLOCK} - passes * line_size + {BLOCK // 2}) // {BLOCK}) END AS quota,
  CASE WHEN blocks > 0 THEN (shard * 7919 + source_rank * 104729 + {SEED}) % blocks ELSE 0 END AS phase FROM l1),
d AS (SELECT p.*, l.passes, l.blocks, l.quota, l.phase, CAST(sum(size) OVER (PARTITION BY source_rank, shard ORDER BY place, draw, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM p JOIN l USING (source_rank, shard)),
e AS (SELECT *, least(stop - size, blocks * {BLOCK}) AS x0, least(stop, blocks * {BLOCK}) AS x1 FROM d),
f AS (SELECT *, (x0 // {BLOCK} * quota + phase) // nullif(blocks, 0) AS c0, ((x0 // {BLOCK} + 1) * quota + phase) // nullif(blocks, 0) AS d0,
  (x1 // {BLOCK} * quota + phase) // nullif(blocks, 0) AS c1, ((x1 // {BLOCK} + 1) * quota + phase) // nullif(blocks, 0) AS d1 FROM e)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(passes * size + CASE WHEN quota > 0 THEN (c1 - c0) * {BLOCK} + (d1 - c1) * (x1 % {BLOCK}) - (d0 - c0) * (x0 % {BLOCK}) ELSE 0 END AS BIGINT) AS taken FROM f
"""
