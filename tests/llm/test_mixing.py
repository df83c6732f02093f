import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from quotewright.llm import mixing
from quotewright.llm.common import Scratch

WORD = re.compile("[^\x20\x09-\x0d]+")


def shares(sizes):
    """Targets by the rule as it reads: reshare what is above a limit until none is; sizes in order of sources."""
    weights = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    total, fixed = Fraction(3, 2) * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left, units = total - sum(fixed.values()), sum(weights[i] for i in free)
        now = {i: left * weights[i] / units for i in free}
        above = [i for i in free if now[i] > 2 * sizes[i]]
        if not above:
            return [float((fixed | now)[i]) for i in range(len(sizes))]
        fixed |= {i: Fraction(2 * sizes[i]) for i in above}


def check(docs, spark, near=mixing.BLOCK):
    got = mixing.mix(docs, Scratch(spark)).collect()
    rows = docs.select("doc_id", "text", "source").collect()
    size = defaultdict(int)
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    target = dict(zip(order, shares([size[s] for s in order])))
    assert Counter((r.doc_id, r.source, r.size, r.source_size) for r in got) == Counter((r.doc_id, r.source, len(WORD.findall(r.text or "")), size[r.source]) for r in rows)
    taken, shards = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        shards[s] = size[s] // mixing.SHARD + 1
        assert abs(taken[s] - target[s]) <= near * shards[s], (s, taken[s], target[s])
        if target[s] >= 2 * size[s]:
            assert taken[s] == 2 * size[s]
    return got


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = check(docs, spark)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, Scratch(spark)).collect()))  # reruns agree
    other = mixing.mix(docs, Scratch(spark), seed=5).collect()
    assert sorted(map(str, got)) != sorted(map(str, other))


def test_hard_rows(hard, none, spark):
    check(hard, spark)
    check(hard.selectExpr("doc_id", "text", "cast(null as string) source", "1 size", "2 target"), spark)
    assert mixing.mix(none, Scratch(spark)).collect() == []
    empty = spark.createDataFrame([(1, "", "a"), (1, None, ""), (None, " ", None)], "doc_id bigint, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.mix(empty, Scratch(spark)).collect()} == {(0, 0.0, 0)}


def test_hot_source_spreads_over_shards(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "repeat('w ', cast(200 + id % 300 as int)) as text", "if(id % 3 = 0, concat('s', id % 30), 'hot') as source")
    docs = docs.withColumn("text", docs.text)
    check(docs, spark)
    rows = mixing.sized(docs)
    assert rows.select("draw").distinct().count() > 800


def test_spans_are_what_is_taken(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for r in mixing.spans(mixing.mix(docs, Scratch(spark))).collect():
        assert r.taken == r.passes * r.size + sum(s.end - s.start for s in r.spans)
        ends = [x for s in r.spans for x in (s.start, s.end)]
        assert ends == sorted(ends) and (not ends or 0 <= ends[0] and ends[-1] <= r.size)


@pytest.mark.parametrize("votes,seats", [([5, 3, 1], 9), ([100, 1, 1, 1], 50), ([7, 7, 7], 10), ([1] * 20, 7), ([0, 10, 3], 1), ([0.3, 1e6, 12.5, 900], 77), ([4, 9], 0)])
def test_highest_quotients(spark, votes, seats):
    won = Counter()
    for _, i in sorted((-v / (2 * k + 1), i) for i, v in enumerate(votes) if v > 0 for k in range(seats))[:seats]:
        won[i] += 1
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(votes)], "g int, i int, v double")
    from pyspark.sql import functions as F

    got = {r.i: r.seats for r in mixing.highest_quotients(df, ["g"], "i", "v", F.lit(seats), "seats").collect()}
    assert got == {i: won[i] for i in range(len(votes))}
