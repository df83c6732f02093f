import math
import random

import pytest

from quotewright.llm import topk
from quotewright.llm.common import Scratch


def brute(by, k, every):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for q in by:
        if q % every == 0:
            best = sorted((-dot(by[q], by[j]), j) for j in by if j != q)[:k]
            out += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def test_ties_and_small_blocks(spark):
    rnd = random.Random(1)
    by = {i: [rnd.randint(-1, 1), rnd.randint(-1, 1)] for i in rnd.sample(range(-150, 400), 300)}
    by |= {1000 + i: [1, 1] for i in range(120)}  # a third of the rows is one vector
    v = spark.createDataFrame(list(by.items()), "vec_id bigint, v array<bigint>")
    assert found(topk.search(v, Scratch(spark), k=7, every=10, block=64, query_block=8, bins=8)) == brute(by, 7, 10)


def test_repeated_ids(spark):
    """Every row is a candidate and, where its id says so, a query."""
    rnd = random.Random(3)
    rows = [(rnd.randrange(30), [rnd.randint(-1, 1), rnd.randint(-1, 1)]) for _ in range(150)] + [(7, [1, 1])] * 40
    v = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>")
    want = []
    for i, (q, a) in enumerate(rows):
        if q % 10 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), j) for o, (j, b) in enumerate(rows) if o != i)[:5]
            want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert found(topk.search(v, Scratch(spark), k=5, every=10, block=64, query_block=8, bins=8)) == sorted(want)


def test_few_rows(spark):
    v = spark.createDataFrame([(0, [1]), (1, [-1]), (50, [])], "vec_id bigint, v array<bigint>")
    assert found(topk.search(v, Scratch(spark))) == brute({0: [1], 1: [-1], 50: [0]}, 5, 50)
    assert topk.search(v.where("vec_id = 1"), Scratch(spark)).count() == 0
    assert topk.search(v.where("vec_id = 0"), Scratch(spark)).count() == 0
    assert topk.search(v.limit(0), Scratch(spark)).count() == 0
    with pytest.raises(OverflowError):
        topk.search(spark.createDataFrame([(0, [1 << 40]), (1, [1])], "vec_id bigint, v array<bigint>"), Scratch(spark))


def test_which_vectors_take_part(spark):
    rows = [(0, [0.5, -0.001]), (1, None), (2, [1.0, None]), (3, [math.nan, 0.0]), (4, [math.inf, 0.0]), (None, [1.0, 1.0]), (5, [0.25, 0.25]), (5, [0.25, 0.25]), (6, [])]
    t = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, v string")
    assert found(topk.integer_vectors(t)) == [(0, [128, -1]), (5, [64, 64]), (5, [64, 64]), (6, [])]


def test_query(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    by = {r.vec_id: [math.floor(256 * x) for x in r.embedding] for r in t.collect()}
    assert found(topk.op5_histogram_topk(spark, sf)) == brute(by, 5, 50)
