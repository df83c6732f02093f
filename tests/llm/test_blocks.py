"""Words hashed and texts scanned in blocks, small groups compared whole, and the driver's cleaning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotewright.llm import common, links, passages
from quotewright.llm.common import Scratch, text_hashes, word_edges, word_hashes, words_of


def test_words_are_hashed_alike_wherever_they_stand():
    rnd, seen = random.Random(20), {}
    for n in (0, 1, 2, 300, common.BYTES, 3 * common.BYTES + 5):
        text = bytes(rnd.choice(b"aAbBxyz \t\n\r\x0b\x0c\x00\x1c\x85\xc3\xa9") for _ in range(n))
        words, h = words_of(text), text_hashes(text)
        assert len(words) == len(h) == len(word_edges(text)) // 2
        assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist()))
        assert word_hashes(words).tolist() == h.tolist()
    assert len(set(seen.values())) == len(seen)
    long = b"q" * (2 * common.BYTES) + b" Ab"
    assert text_hashes(b" \n" + long).tolist() == text_hashes(long).tolist() and text_hashes(long)[1] == text_hashes(b"aB")[0]


def test_blocks_give_what_single_texts_give(spark, monkeypatch):
    rnd = random.Random(21)
    texts = []
    for _ in range(150):
        w = [f"w{rnd.randrange(60)}" for _ in range(rnd.choice((0, 1, 34, 40, 49, 50, 51, 90, 400)))]
        texts.append("".join(x + rnd.choice((" ", " ", " ", "  ", "\n", " \n\n")) for x in w) if rnd.random() < 0.7 else " ".join(w))
    df = spark.createDataFrame([*enumerate(texts), (900, None), (901, "\n")], "doc_id bigint, text string").coalesce(1)
    together = passages.scanned(df, 50).collect()
    monkeypatch.setattr(passages, "BLOCK", 1)
    assert len(together) > 500 and sorted(map(str, passages.scanned(df, 50).collect())) == sorted(map(str, together))


def test_small_groups_need_no_rounds(spark, monkeypatch):
    """Groups of two at a similarity below the threshold went through every round and the pass over all elements."""
    rnd = np.random.default_rng(22)
    own = [rnd.integers(0, 2**62, 40, dtype=np.uint64) for _ in range(30)]
    sets = [(2 * i + k, np.unique(np.r_[x[: 38 if i % 3 else 20], rnd.integers(0, 2**62, 2 if i % 3 else 20, dtype=np.uint64)]).tobytes()) for i, x in enumerate(own) for k in range(2)]
    df = spark.createDataFrame([(i, 0, len(s) // 8, None, bytearray(s)) for i, s in sets], "id bigint, v bigint, n int, sig binary, s binary")
    keyed = spark.createDataFrame([(i // 2, i, 2) for i, _ in sets], "key bigint, id bigint, c bigint")
    monkeypatch.setattr(links, "prefixes", lambda *a: pytest.fail("elements of all sets are read"))
    none = spark.createDataFrame([], "a bigint, b bigint")
    comps = links.resolve(keyed, none, df, 80, 100, None, Scratch(spark), "t", 16)
    assert {(r.node, r.comp) for r in comps.collect()} == {(2 * i + k, 2 * i) for i in range(30) if i % 3 for k in range(2)}


def test_large_groups_are_resolved_all_the_same(spark):
    """A group of 20 near copies and one of two: the first goes through the rounds."""
    rnd = np.random.default_rng(23)
    base = rnd.integers(0, 2**62, 100, dtype=np.uint64)
    sets = [(i, np.unique(np.r_[base[:95], rnd.integers(0, 2**62, 5, dtype=np.uint64)]).tobytes()) for i in range(20)] + [(i, np.unique(base[:50]).tobytes()) for i in (30, 31)]
    df = spark.createDataFrame([(i, 0, len(s) // 8, None, bytearray(s)) for i, s in sets], "id bigint, v bigint, n int, sig binary, s binary")
    keyed = spark.createDataFrame([(1, i, 22) for i, _ in sets] + [(2, 30, 2), (2, 31, 2)], "key bigint, id bigint, c bigint")
    comps = links.resolve(keyed, spark.createDataFrame([], "a bigint, b bigint"), df, 80, 100, None, Scratch(spark), "t", 16)
    assert {(r.node, r.comp) for r in comps.collect() if r.node != r.comp} == {(i, 0) for i in range(1, 20)} | {(31, 30)}


def test_driver_cleans_up_between_scratch_tables(spark, monkeypatch):
    """However many rounds a query takes, the driver cleans up again and again; before, only where a step dropped its tables."""
    cleaned = []
    scratch = Scratch(spark)
    monkeypatch.setattr(Scratch, "clean", lambda self: cleaned.append(self.cuts), raising=False)
    for i in range(2 * common.CUTS + 1):
        df = scratch.cut(spark.range(3).select(F.lit(i).alias("i")), "again")
    assert df.count() == 3 and cleaned == [common.CUTS, 2 * common.CUTS]
