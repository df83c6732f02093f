import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
from conftest import HARD
from tokenizers import Tokenizer

from quotewright.llm import packing
from quotewright.llm.common import Scratch


def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t


def check(rows, texts, width=packing.WIDTH):
    """Every id in one piece, windows gapless and within width."""
    t = tokenizer()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for k, found in pieces.items():
        ids, at = t.encode(texts[k] or "", add_special_tokens=False).ids + [0], 0
        for r in sorted(found, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= width
    return windows


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    windows = check(packing.op9_bin_slack_packing(spark, sf).collect(), {r.doc_id: r.text for r in docs.collect()})
    total = sum(x[1] for w in windows.values() for x in w)
    assert len(windows) * packing.WIDTH - total < 0.05 * total


def test_hard_documents(spark, hard, none):
    some = hard.where("doc_id is not null").dropDuplicates(["doc_id"])
    check(packing.pack(some, Scratch(spark)).collect(), dict(enumerate(HARD)))
    rows = packing.pack(hard, Scratch(spark)).collect()  # repeated and null ids are packed too
    assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 3 for r in rows) == 2
    assert packing.pack(none, Scratch(spark)).count() == 0


def test_fill_is_closest():
    rnd = random.Random(1)
    for _ in range(300):
        counts = {rnd.randint(1, 12): rnd.randint(1, 3) for _ in range(rnd.randint(1, 4))}
        room = rnd.randint(0, 40)
        used = packing.fill(counts, room)
        assert all(used[k] <= counts[k] for k in used)
        sums = [sum(k * n for k, n in zip(counts, c)) for c in product(*[range(n + 1) for n in counts.values()])]
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_plan_uses_everything_once():
    rnd = random.Random(4)
    h = {rnd.randint(1, 100): rnd.randint(1, 10_000) for _ in range(60)} | {100: 7}
    used = {}
    for times, pattern in packing.plan(h, 100):
        assert times > 0 and sum(k * c for k, c in pattern.items()) <= 100
        for k, c in pattern.items():
            used[k] = used.get(k, 0) + times * c
    assert used == h and packing.plan({}) == []
