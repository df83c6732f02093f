import hashlib
import zlib
from collections import Counter, defaultdict
from math import fmod

import numpy as np
import pytest

from quotewright.llm import prefixes
from quotewright.llm.common import Scratch

DDL = "conv_id bigint, turn bigint, role string, text string"


def turns_of(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        own[c].append((role or "", text or ""))
    if not rebuild:
        return own
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - int(fmod(c, 20)), [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(rows, rebuild):
    convs = turns_of(rows, rebuild)
    members = defaultdict(list)
    for c, t in convs.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    out = []
    for seq, cs in members.items():
        below = [(s, m) for s, m in members.items() if s[: len(seq)] == seq]
        kids = [s for s, _ in below if len(s) == len(seq) + 1]
        leaves = [s for s, _ in below if not any(u[: len(s)] == s and len(u) > len(s) for u, _ in below)]
        saved = sum((len(m) - 1) * len(s[-1][1].encode().split()) for s, m in below if s)
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(seq))
        out.append((min(cs), len(seq), min(members[seq[:-1]]) if seq else None, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def check(df, spark, rebuild, bits=64):
    t = (prefixes.rebuilt if rebuild else prefixes.ordered)(df)
    got = prefixes.trie(t, Scratch(spark), bits).collect()
    assert Counter(map(tuple, got)) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], rebuild)


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/conversations.parquet"), spark, True)


HARD = [
    (None, 1, "user", "no id"), (0, None, None, None), (0, 1, "user", "a b"), (0, 1, "user", "a b"), (0, 2, "user", ""), (1, 1, "", "x"), (5, 1, "user", "a b"), (5, 1, "assistant", "a b"), (-1, 1, "user", "q"), (-20, 3, "user", "a b c"),
    (-21, 1, "user", "a b"), (-21, 2, "user", "a b"), (40, 1, "user", "only"), (59, 1, "user", "w " * 5000), (47, 2, "user\n", "a"), (47, 1, "user", "\na"), (48, 1, "us", "er"), (100, 1, "user", "a"), (119, 9, "user", "a"), (118, 1, "x", "y"),
]


def test_hard_rows(spark):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in HARD], DDL + ", fp string, depth int, owner int")
    check(df, spark, True)
    check(df, spark, False)
    assert prefixes.trie(prefixes.rebuilt(df.limit(0)), Scratch(spark)).collect() == []


def many(seed, n, longest, kinds):
    r = np.random.default_rng(seed)
    return [(c, t, "user", f"t{r.integers(0, kinds)}") for c in range(n) for t in range(r.integers(1, longest))]


@pytest.mark.parametrize("bits", [0, 5])
def test_colliding_fingerprints_are_split(spark, bits):
    df = spark.createDataFrame(many(1, 40, 5, 3), DDL)
    assert not prefixes.disagreements(prefixes.fingerprints(prefixes.rebuilt(df), bits)).isEmpty()
    check(df, spark, True, bits)
    check(df, spark, False, bits)


def test_hot_prefix_and_long_conversations(spark):
    rows = [(c, t, "user", "same" if t < 2 else f"{c}") for c in range(300) for t in range(3)] + [(1000 + c, t, "user", f"same {t}") for c in range(3) for t in range(120)]
    check(spark.createDataFrame(rows, DDL), spark, False)


def test_fingerprints_go_on_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame(many(2, 20, 30, 50), DDL)
    try:
        want = sorted(prefixes.fingerprints(prefixes.ordered(df)).collect())
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        assert sorted(prefixes.fingerprints(prefixes.ordered(df)).collect()) == want
        check(df, spark, True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
