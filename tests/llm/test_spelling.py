import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quotewright.llm import spelling
from quotewright.llm.common import Scratch

RUN = re.compile("[A-Za-zÀ-ÿ]+")
DDL = "doc_id bigint, text string"


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def close(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n, out = counted(rows), {}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    for w in n:
        near = [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if close(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 5 * n[w] else None
        out[w] = [form, n[w], len(near), n[form] if form else None]
    for w in n:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return {w: tuple(r) for w, r in out.items()}


def check(spark, df):
    got = {r.word: (r.form, r.n, r.n_near, r.form_n, r.root) for r in spelling.variants(df, Scratch(spark)).collect()}
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])
    return got


def test_whole_table(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(60))


def chains():
    times = {"letters": 3300, "lettars": 650, "lettirs": 130, "lettir": 26, "lattir": 5, "abcdef": 5, "abcdeg": 5, "aaaaaaa": 60, "aaaaaa": 6, "aaaaaaaa": 5, "ètésoùÿ": 30, "etésoùÿ": 6, "aXbcde": 5, "×÷×÷×÷": 5, "short": 50}
    return [(i, " ".join([w] * k)) for i, (w, k) in enumerate(times.items())]


def test_chains_ties_and_equal_letters(spark):
    got = check(spark, spark.createDataFrame(chains(), DDL))
    assert got["lattir"][4] == "letters" and got["abcdef"][0] is None and got["aaaaaa"][0] == "aaaaaaa"


def test_hard_rows(hard, none, spark):
    check(spark, hard.unionByName(hard).unionByName(hard).unionByName(hard).unionByName(hard).withColumnRenamed("spans", "word"))
    assert spelling.variants(none, Scratch(spark)).collect() == []


def test_words_too_long_to_carry(spark):
    r = np.random.default_rng(3)
    base = "".join(chr(97 + x) for x in r.integers(0, 26, 64))
    words = [base, base[:30] + base[31:], base + "q", base + "qq", "é" + base + "q", base[:40] + "zz" + base[42:] + "q", base[:63] + "aq", "b" * 70, "b" * 69, "b" * 71, "b" * 30 + "c" + "b" * 40, base * 50, (base * 50)[:-1] + "é"]
    check(spark, spark.createDataFrame([(i, " ".join([w] * (5 + 37 * (i % 3)))) for i, w in enumerate(words)], DDL))


@pytest.mark.parametrize("bits", [0, 2])
def test_colliding_hashes_link_nothing(spark, monkeypatch, bits):
    """With hashes of a few bits, strings alone decide."""
    rows = [(i, text) for i, text in chains()] + [(100 + i, " ".join([f"word{c}x{d}z"] * 6)) for i, (c, d) in enumerate((c, d) for c in "abc" for d in "pqrs")]
    rows = [(i, t.replace("0", "o")) for i, t in rows]
    batch = [w for w in counted(rows)]
    total, deleted, place, own = spelling.deletion_keys(batch)
    owner = np.repeat(np.arange(len(batch)), [len(w) for w in batch])
    mask = np.uint64((1 << bits) - 1)
    n = counted(rows)
    by_key = {}
    for k, i, w, o in [(t & mask, -1, w, True) for t, w in zip(total, batch)] + [(d & mask, int(p), batch[j], bool(x)) for d, p, j, x in zip(deleted, place, owner, own)]:
        by_key.setdefault(int(k), []).append((i, o, 0, n[w], w))
    near, best = Counter(), {}
    for run in by_key.values():
        for word, count, m, other, *_ in spelling._of_run(run) if len(run) > 1 else ():
            near[word] += count
            best[word] = min(best.get(word, (1, "")), (-m, other))
    want = brute(rows)
    assert {w: near[w] for w in want} == {w: r[2] for w, r in want.items()}
    assert all(best[w][1] == r[0] for w, r in want.items() if r[0])


def test_deletion_hashes_equal_those_of_the_strings():
    words = ["abcdef", "aabbcc", "é", "ÿÿÿÿ", "x" * 40]
    total, deleted, place, own = spelling.deletion_keys(words)
    strings = [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]
    again = spelling.deletion_keys(strings)[0]
    assert list(again) == list(deleted) and list(spelling.deletion_keys(words)[0]) == list(total)
    assert sum(own) == sum(len({w[:i] + w[i + 1 :] for i in range(len(w))}) for w in words)
    assert len(spelling.deletion_keys([])[0]) == 0


def test_runs_are_found_in_bytes():
    text = "AbÀ×ÿĀé—xy¿À日a1b_c\tÉ \U0001f600q́z"
    assert [r.decode() for r in spelling.runs_of(text.encode())] == ["".join(c.lower() if c <= "Z" else c for c in r) for r in RUN.findall(text)]


def test_runs_across_batches(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        check(spark, spark.createDataFrame(chains(), DDL))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
