"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate in blocks: blocks of queries meet blocks of candidates by an equi-join on
the candidates' block, and a task multiplies one block by another. Scores are never stored; each round scores again.
A round holds, per query, an interval in which the k-th best key lies and how many keys lie above it; tasks count
keys into BINS bins of that interval, bins are summed over all tasks, and the interval shrinks to the bin of the k-th
key. A block passes on only its own top bins up to k keys: lower ones can't hold the k-th. Score bits come first, then
vec_id bits among the scores equal to the k-th, so that ties end exactly. The last round emits what is at or above it.

Cases. Vectors that are null or hold null or non-finite components take no part, nor do null ids. Repeated ids: every
row is a candidate, and a query of its own where its id is one; only itself is left out. Shorter vectors: missing components count as zeros; an empty vector scores 0.
Ties: smaller vec_id first. Fewer than k candidates: all. Empty table: no rows. Extra columns are ignored. Scores must
fit 63 bits, else OverflowError.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K, EVERY, SCALE = 5, 50, 256
BINS = 1 << 12
BLOCK, QUERIES = 8192, 1024  # vectors of a block, by a hash of their numbers
MEET = 32  # query blocks that meet a candidate block in one task
NONE = -(1 << 63)


def integer_vectors(t: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>) of the vectors that take part."""
    ok = t.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    return ok.select(F.col("vec_id").cast("bigint"), v.alias("v"))


def _matrix(lists, dim: int) -> np.ndarray:
    """An Arrow list column of integers as rows of floats, short rows padded with zeros; exact below 2**53."""
    out = np.zeros((len(lists), dim))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(lists.offsets.to_numpy())
    if len(flat):
        row = np.repeat(np.arange(len(lists)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _scored(batches, dim: int, exact: bool):
    """Of each row, a query block beside a candidate block: block number, the queries' numbers and ids, scores, candidate ids, state; scores of a query with itself are NONE."""
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for r in range(batch.num_rows):
            q, c, state = (col[k][r].values for k in ("qs", "cs", "state"))
            (rid, qid), (crid, cid) = ([x.field(n).to_numpy() for n in ("rid", "vec_id")] for x in (q, c))
            a, b = _matrix(q.field("v"), dim), _matrix(c.field("v"), dim)
            s = (a @ b.T).astype(np.int64) if exact else a.astype(np.int64) @ b.astype(np.int64).T
            s[rid[:, None] == crid[None, :]] = NONE
            of = {n: state.field(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi", "score")}
            order = np.argsort(state.field("rid").to_numpy())
            where = order[np.searchsorted(state.field("rid").to_numpy(), rid, sorter=order)]
            yield col["q"][r].as_py(), rid, qid, s, cid, {n: v[where] for n, v in of.items()}


def _keys(s: np.ndarray, cid: np.ndarray, state: dict, by_id: bool) -> np.ndarray:
    """What the round selects on: scores, or the negative ids of the candidates whose score is the k-th."""
    return np.where(s == state["score"][:, None], -cid[None, :], NONE) if by_id else s


def search(vectors: DataFrame, scratch: Scratch, k: int = K, every: int = EVERY, block: int = BLOCK, query_block: int = QUERIES, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of every query (ids divisible by every) among all other vectors."""
    spark = vectors.sparkSession
    vectors = scratch.cut(vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("rid")), "vectors")  # numbered once, as it is written
    one = F.struct("rid", "vec_id", "v")
    is_query = F.col("vec_id") % every == 0
    n, nq, dim, top, low, high = vectors.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.min("vec_id"), F.max("vec_id")).first()
    names = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not nq:
        return spark.createDataFrame([], names)
    dim, top = max(1, dim), top or 0
    bound = dim * top * top + 1
    if bound >= 1 << 62 or top >= 1 << 53:
        raise OverflowError("scores don't fit 63 bits")
    exact = bound < 1 << 53
    block = max(256, min(block, n // 32))
    nc, nb = max(1, math.ceil(n / block)), max(1, math.ceil(nq / query_block))
    dealt = lambda parts, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(parts)).cast("int")
    cs = scratch.cut(vectors.groupBy(dealt(nc, 1).alias("g")).agg(F.collect_list(one).alias("cs")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit((nb - 1) // MEET)))), "candidates")  # of about block vectors each, once for every MEET query blocks
    queries = vectors.where(is_query).withColumn("q", dealt(nb, 2))
    qs = scratch.cut(queries.groupBy("q").agg(F.collect_list(one).alias("qs")), "queries")
    state = queries.select("q", "rid", F.lit(-bound).cast("bigint").alias("lo"), F.lit(bound + 1).cast("bigint").alias("hi"), F.lit(0).cast("bigint").alias("above"), F.lit(0).cast("bigint").alias("score"), F.lit(False).alias("short"))

    # Queries, candidates and states grow with the table, and files of small numbers look small: none of them is broadcast.
    def meeting(state: DataFrame) -> DataFrame:
        with_state = qs.join(state.groupBy("q").agg(F.collect_list(F.struct("rid", "lo", "hi", "score")).alias("state")).hint("merge"), "q")
        return with_state.withColumns({"g": F.explode(F.sequence(F.lit(0), F.lit(nc - 1))), "h": F.expr(f"q div {MEET}").cast("int")}).join(cs.hint("merge"), ["g", "h"]).select("q", "qs", "cs", "state")

    def narrowed(state: DataFrame, by_id: bool, width: int) -> DataFrame:
        step = -(-width // bins)

        def histogram(batches):
            import pyarrow as pa

            for q, rid, _, s, cid, st in _scored(batches, dim, exact):
                key = _keys(s, cid, st, by_id)
                key = np.where((key >= st["lo"][:, None]) & (key < st["hi"][:, None]), key, NONE)
                m = min(k, key.shape[1])
                best = np.partition(key, key.shape[1] - m, axis=1)[:, key.shape[1] - m :]
                row, at = np.nonzero(best != NONE)
                found = np.stack([row, (best[row, at] - st["lo"][row]) // step], 1)
                u, count = np.unique(found, axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), q, np.int32)), pa.array(rid[u[:, 0]]), pa.array(u[:, 1]), pa.array(count)], ["q", "rid", "bin", "n"])

        counts = meeting(state).mapInArrow(histogram, "q int, rid bigint, bin bigint, n bigint").groupBy("q", "rid", "bin").agg(F.sum("n").alias("n"))
        above = Window.partitionBy("q", "rid").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)  # at most bins rows
        reached = counts.withColumn("cum", F.sum("n").over(above)).join(state.hint("merge"), ["q", "rid"]).where("cum >= %d - above and cum - n < %d - above" % (k, k))
        new = reached.select("q", "rid", (F.col("lo") + F.col("bin") * step).alias("lo"), (F.col("above") + F.col("cum") - F.col("n")).alias("above"))
        both = state.drop("lo", "hi", "above").join(new.hint("merge"), ["q", "rid"], "left")
        return scratch.cut(both.select("q", "rid", F.coalesce("lo", F.lit(-bound)).alias("lo"), F.coalesce(F.col("lo") + step, F.lit(bound + 1)).alias("hi"), F.coalesce("above", F.lit(0)).alias("above"), "score", (F.col("short") | F.col("lo").isNull()).alias("short")), "by-id" if by_id else "by-score")

    def rounds(state: DataFrame, by_id: bool, width: int) -> DataFrame:
        while width > 1:
            state = narrowed(state, by_id, width)
            width = -(-width // bins)
        return state

    state = rounds(state, False, 2 * bound + 1)
    # lo is now the k-th score; where there are fewer than k candidates, short says so and every candidate is in
    state = state.withColumn("score", F.when(F.col("short"), F.lit(-bound)).otherwise(F.col("lo"))).withColumns({"lo": F.lit(-high).cast("bigint"), "hi": F.lit(-low + 1).cast("bigint")})
    ties = scratch.cut(state.where(~F.col("short")), "ties")
    done = rounds(ties, True, high - low + 1).select("q", "rid", "score", F.col("lo").alias("lo"), F.lit(0).cast("bigint").alias("hi"))
    done = done.unionByName(state.where("short").select("q", "rid", "score", F.lit(NONE + 1).cast("bigint").alias("lo"), F.lit(0).cast("bigint").alias("hi")))

    def chosen(batches):
        import pyarrow as pa

        for _, rid, qid, s, cid, st in _scored(batches, dim, exact):
            t = st["score"][:, None]
            row, at = np.nonzero((s != NONE) & ((s > t) | (s == t) & (-cid[None, :] >= st["lo"][:, None])))
            best = np.lexsort((cid[at], -s[row, at], row))  # more than k only where ids repeat
            row, at = row[best], at[best]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, at = row[keep], at[keep]
            yield pa.RecordBatch.from_arrays([pa.array(rid[row]), pa.array(qid[row]), pa.array(cid[at]), pa.array(s[row, at])], ["rid", "query_id", "vec_id", "score"])

    out = meeting(scratch.cut(done, "done")).mapInArrow(chosen, "rid bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))  # k rows of a block at most
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = f"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), TRUE)),
c AS (SELECT rid, vec_id, generate_subscripts(embedding, 1) AS i, CAST(floor({SCALE} * CAST(unnest(embedding) AS DOUBLE)) AS BIGINT) AS x FROM v),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, o.vec_id, coalesce(s.score, 0) AS score FROM v q JOIN v o ON o.rid <> q.rid AND q.vec_id % {EVERY} = 0
  LEFT JOIN (SELECT a.rid AS ra, b.rid AS rb, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM c a JOIN c b ON a.i = b.i AND a.vec_id % {EVERY} = 0 GROUP BY 1, 2) s ON s.ra = q.rid AND s.rb = o.rid),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {K}
"""


def op5_histogram_topk(spark, sf_dir):
    return search(integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), Scratch(spark))
