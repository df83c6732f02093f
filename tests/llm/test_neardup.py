import random
import re
import string

import numpy as np

from quotewright.llm import links, neardup
from quotewright.llm.common import Scratch, connected_components

WORD, LOWER = re.compile("[^\x20\x09-\x0d]+"), str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows, k):
    """(doc_id, n, component) of every row."""
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if i is not None and j is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return sorted((str(i), len(s), str(find(i))) for i, s in sets)


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_hard_documents(spark, hard, none):
    more = spark.createDataFrame([(100, "WORD"), (101, "a b c d"), (102, "A  b\nc D"), (103, "a b"), (3, "another text under a used id"), (104, "another text under a used id")], "doc_id bigint, text string")
    df = hard.select("doc_id", "text").union(more)
    assert got(neardup.classes(df, Scratch(spark))) == brute(rows_of(df), 4)
    assert neardup.classes(none, Scratch(spark)).count() == 0


def test_large_group_of_near_copies(spark):
    """A third of the rows are edited copies of one text; some are edited too much to be linked with any."""
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3, 4, 6, 9))):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**9)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(f"u{rnd.randrange(5000)}" for _ in range(60))) for i in range(200)]
    rows += [(3000 + i, rows[i][1]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(neardup.classes(df, Scratch(spark))) == brute(rows, 4)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (500, 400)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = {r.node: r.comp for r in connected_components(df, Scratch(spark), "t").collect()}
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {400: 400, 500: 400}
    assert connected_components(df.limit(0), Scratch(spark), "t").count() == 0


def test_resolve_loses_no_link(spark):
    """Against all pairs, on sets of numbers that share one key."""
    rnd = random.Random(2)
    sets = {i: frozenset(rnd.sample(range(30), rnd.randint(8, 14)) if i % 3 else rnd.sample(range(12), 10)) for i in range(60)}
    ok = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    keyed = spark.createDataFrame([(1, i) for i in sets], "key bigint, id bigint")
    stored = spark.createDataFrame([(i, 0, len(s), None, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in sets.items()], "id bigint, v bigint, n int, sig binary, s binary")
    comps = {r.node: r.comp for r in links.resolve(keyed, spark.createDataFrame([], "a bigint, b bigint"), stored, 80, 100, None, Scratch(spark), "t").collect()}
    up = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if ok(a, b):
                    up[a] = up[b] = min(up[a], up[b])
    assert {i: comps.get(i, i) for i in sets} == up


def test_pairs_of_the_last_pass(spark):
    """Every pair of different components that reaches the threshold is among them; heavily edited copies of one text meet few."""
    rnd = random.Random(9)
    sets, comp = {}, {}
    for i in range(120):
        s = set(range(100))
        for x in rnd.sample(range(100), rnd.choice((2, 8, 14, 15, 16, 18, 30))):
            s.remove(x)
            if rnd.random() < 0.9:
                s.add(rnd.choice((1000 + rnd.randrange(40), 10_000 + rnd.randrange(10**6))))
        sets[i], comp[i] = s, rnd.choice((0, 0, i))
    stored = spark.createDataFrame([(i, 0, len(s), bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in sets.items()], "id bigint, v bigint, n int, s binary")
    comps = spark.createDataFrame(list(comp.items()), "node bigint, comp bigint")
    scratch = Scratch(spark)
    met = {(r.a, r.b) for r in links.prefix_pairs(links.prefixes(stored, 80, 100, scratch, "t"), comps, 80, 100, scratch, "t").collect()}
    apart = [(a, b) for a in sets for b in sets if a < b and comp[a] != comp[b]]
    assert {(a, b) for a, b in apart if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])} <= met
    assert len(met) < len(apart) / 2


def test_signature_keys():
    """Two signatures that differ in at most DISTANCE values share a key."""
    rnd = np.random.default_rng(4)
    for _ in range(300):
        a = rnd.integers(0, 1 << 16, 32).astype(np.uint16)
        b = a.copy()
        b[rnd.choice(32, neardup.DISTANCE, replace=False)] ^= np.uint16(1)
        assert set(neardup.keys_of(a).tolist()) & set(neardup.keys_of(b).tolist())


def test_query(spark, sf):
    df = neardup.op7_hamming_near_duplicates(spark, sf)
    assert got(df) == brute(rows_of(spark.read.parquet(f"{sf}/documents.parquet")), 4)
    assert df.where("kept <> (doc_id = component_id)").count() == 0
