import random

import public_tokenizers
import pytest
import tiktoken
from conftest import HARD

from quotewright.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_ranks(None, bpe.VOCABULARY))


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash_is_minimal(codec):
    assert sorted(codec.hash.order) == list(range(len(codec.ranks)))
    assert all(codec.whole(k) == (v,) for k, v in codec.ranks.items())
    assert codec.whole(b"certainly not an entry of it") is None


def test_ids_are_the_librarys(codec, library):
    encode, rnd = bpe.encoder(codec), random.Random(3)
    signs = [chr(c) for c in (*range(0x250), *range(0x2000, 0x2070), 0x85, 0x1680, 0x180E, 0x3000, 0xFEFF, 0x1F600, 0x200D, 0x661, 0x2167, 0x4E2D, 0xAC00)]
    texts = [t or "" for t in HARD] + ["ab" * 20_000, " " * 5000 + "x"]
    texts += ["".join(rnd.choice(signs if rnd.random() < 0.5 else "ab's 're12 \n\t.") for _ in range(rnd.randint(0, 15))) for _ in range(4000)]
    for t in texts:
        ids = encode(t).tolist()
        assert ids == library.encode_ordinary(t)
        assert b"".join(map(codec.tokens.__getitem__, ids)) == t.encode()


def test_memo_generations(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 7)
    encode = bpe.encoder(codec)
    text = " ".join(f"word{i % 40} other" for i in range(500))
    assert encode(text).tolist() == library.encode_ordinary(text)


def test_frames(spark, hard, none, codec, library):
    rows = bpe.encode_decode(hard, codec).collect()
    by = {r.doc_id: r.text for r in hard.collect()}
    assert len(rows) == hard.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(by[r.doc_id] or "") and bytes(r.decoded) == (by[r.doc_id] or "").encode()
    again = bpe.decode(bpe.encode_decode(hard, codec, decode=False), codec).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(bytes(r.decoded) for r in rows)
    assert bpe.encode_decode(none, codec).count() == 0
