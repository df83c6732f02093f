"""Byte-level BPE: encode whole texts, decode the ids.

Two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are vocabulary entries themselves.
The rest are merged over a doubly linked list of byte spans with a heap of (rank, place): lowest rank first, leftmost
first among equals, which gives the ids of the published merge loop in n log n.

Cases. Null and empty texts: no ids, empty bytes. Very long texts and pre-tokens: no limit; cost grows as n log n.
Repeated rows: each encoded. Empty table: no rows. Bytes that are no vocabulary entry of their own raise ValueError.
Columns but the id and the text are ignored, whatever their names. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
MEMO = 400_000  # pre-tokens a worker remembers before it starts again
LONG = 64  # characters; longer pre-tokens are not remembered, so that a memo is bounded by bytes


def load_ranks(spark: SparkSession | None, path: str) -> dict[bytes, int]:
    """The rank file, read on the driver from a local path, or by Spark from any store."""
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]  # a vocabulary, not data
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


class PerfectHash:
    """A minimal perfect hash over keys (compress, hash and displace): every key has a slot of its own in [0, n)."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        self.buckets = max(1, n // per_bucket)
        hashed = [xxhash.xxh3_128_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashed):
            groups[(h >> 64) % self.buckets].append(i)
        self.shift = [0] * self.buckets
        taken = bytearray(n)
        self.order = [0] * n
        free = None
        for b in sorted(range(self.buckets), key=lambda b: -len(groups[b])):
            g = groups[b]
            if not g:
                break
            if len(g) == 1:  # the last ones go straight to free slots
                if free is None:
                    free = [s for s in range(n) if not taken[s]]
                s = free.pop()
                self.shift[b] = -1 - s
                taken[s] = 1
                self.order[g[0]] = s
                continue
            d = 0
            while True:
                slots = [self._slot(hashed[i], d) for i in g]
                if len(set(slots)) == len(g) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(g, slots):
                taken[s] = 1
                self.order[i] = s

    def _slot(self, h: int, d: int) -> int:
        return ((h & 0xFFFFFFFF) + d * ((h >> 32 & 0xFFFFFFFF) | 1) + d * d * 0x9E37) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h >> 64) % self.buckets]
        return -1 - d if d < 0 else self._slot(h, d)


class Codec:
    """Encoder and decoder of one vocabulary; built once on the driver, shipped to the tasks (about as large as the vocabulary)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {i: t for t, i in ranks.items()}
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.slots: list[tuple[bytes, tuple[int]]] = [(b"", (0,))] * len(keys)
        for i, k in enumerate(keys):
            self.slots[self.hash.order[i]] = (k, (ranks[k],))

    def whole(self, piece: bytes) -> tuple[int, ...] | None:
        """First tier: the id of a pre-token that is an entry."""
        key, ids = self.slots[self.hash.slot(piece)]
        return ids if key == piece else None

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Second tier: a heap over linked bytes."""
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # of the span that starts here, and so where the next one starts
        before = list(range(-1, n))
        now = [-1] * n  # rank of the span here with the next one
        heap = []
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                now[i] = r
                heap.append((r, i))
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            r, i = pop(heap)
            if now[i] != r:
                continue
            j = end[i]
            k = end[i] = end[j]
            now[j] = now[i] = -1
            if k < n:
                before[k] = i
                q = get(piece[i : end[k]])
                if q is not None:
                    now[i] = q
                    push(heap, (q, i))
            p = before[i]
            if p >= 0:
                q = get(piece[p:k])
                now[p] = -1 if q is None else q
                if q is not None:
                    push(heap, (q, p))
        out, i = [], 0
        while i < n:
            r = get(piece[i : end[i]])
            if r is None:
                raise ValueError(f"byte {piece[i]} is no entry of the vocabulary")
            out.append(r)
            i = end[i]
        return tuple(out)


class _Memo(dict):
    """Pre-token -> its ids as little-endian 32-bit integers. Full, it becomes the old generation; what is used again comes back."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = np.array(self.codec.whole(raw) or self.codec.merge(raw), "<i4").tobytes()
        if len(piece) > LONG:
            return ids
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


_live: dict[int, tuple] = {}


def encoder(codec: Codec):
    """text -> ids as an int32 array, with a memo that lives as long as the Python worker."""
    key = len(codec.ranks) * 1_000_003 + hash(codec.pattern)
    found = _live.get(key)
    if found is None or found[0] != codec.ranks:
        found = _live[key] = (codec.ranks, _Memo(codec), regex.compile(codec.pattern))
    memo, split = found[1].__getitem__, found[2].findall
    return lambda text: np.frombuffer(b"".join(map(memo, split(text))), "<i4")


OUT_BYTES = 16 << 20


def encode_decode(docs: DataFrame, codec: Codec, id_col: str = "doc_id", text: str = "text", decode: bool = True) -> DataFrame:
    """(id, ids array<int>, decoded binary): the ids of every text and, from those ids, its bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codec = shared.value
        encode, token = encoder(codec), codec.tokens.__getitem__
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            at, flat, lengths, raw, size = 0, [], [], [], 0
            for i, x in enumerate(texts):
                ids = encode(x or "")
                flat.append(ids)
                lengths.append(len(ids))
                raw.append(b"".join(map(token, ids.tolist())) if decode else None)
                size += 4 * len(ids) + len(x or "")
                if size >= OUT_BYTES or i + 1 == len(texts):
                    offsets = np.zeros(len(lengths) + 1, np.int32)
                    np.cumsum(lengths, out=offsets[1:])
                    yield pa.RecordBatch.from_arrays([keys.slice(at, len(lengths)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat))), pa.array(raw, pa.binary())], ["id", "ids", "decoded"])
                    at, flat, lengths, raw, size = i + 1, [], [], [], 0

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, codec: Codec, id_col: str = "doc_id") -> DataFrame:
    """(id, decoded binary) of a table of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(codec.tokens)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token = shared.value.__getitem__
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(map(token, x or ())) for x in batch.column(1).to_pylist()], pa.binary())], ["id", "decoded"])

    kind = encoded.select(id_col).schema[0].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(run, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def op3_byte_bpe(spark, sf_dir):
    codec = Codec(load_ranks(spark, VOCABULARY))
    t = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), codec)
    return t.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
