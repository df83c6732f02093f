"""Packing of tokenized documents by minimum bin slack.

A document is cut into windows of WIDTH ids and one remainder. Remainders are packed by length: as long as any are left,
the longest one opens a window and a bitset subset-sum programme over the multiset of remaining lengths finds the
filling closest to WIDTH, whose counts come back by backtracking; the pattern is used as often as the counts allow. The
programme sees only the histogram (at most WIDTH lengths), so its plan is of bounded size whatever the input, and the
pieces find their windows by their rank among the pieces of their length.

Ranks need no task that holds all pieces of a length: a task numbers its own pieces of each length while it
tokenizes, and counts per (length, task) are summed up before them.

Cases. Null and empty texts: the closing id alone. Very long texts: whole; batches are cut by size. Equal lengths: ranked
by task and place. Added tokens of the tokenizer file (<|endoftext|>) inside texts: one id each, as the library has them. Repeated rows: each packed. Null doc_id: packed, carried as null. Empty table: no rows. Columns
but doc_id and text are ignored. A sequence shorter than WIDTH whose length is a power of two needs no padding.
"""

from __future__ import annotations

import base64
import json
import math
import zlib
from collections.abc import Iterator

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

WIDTH = 1024
CLOSING = 0
#: The vocabulary of byte_bpe_50k.json as ranks: the same ids (see the tests), at a seventh of the tokenizers library's time.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part bigint, place bigint"


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]  # a vocabulary, not data
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}


def load_added(spark: SparkSession, path: str) -> dict[str, int]:
    """The added tokens of a tokenizer file: wherever they stand in a text, they are one id, and what stands between them is cut alone."""
    if "://" in path:
        raw = "\n".join(r[0] for r in spark.read.text(path).collect())  # a vocabulary, not data
    else:
        with open(path) as f:
            raw = f.read()
    found = json.loads(raw)["added_tokens"]
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in found):
        raise ValueError(f"{path} has added tokens that depend on what stands beside them")
    return {x["content"]: x["id"] for x in found}


def cut_pieces(docs: DataFrame, ranks: dict[bytes, int], added: dict[str, int], width: int = WIDTH) -> DataFrame:
    """PIECES of every document; place is the piece's number among its task's pieces of that length."""
    ranks = {k: v for k, v in ranks.items() if v not in set(added.values())}
    shared = docs.sparkSession.sparkContext.broadcast((ranks, added))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import tiktoken
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ranks, added = shared.value
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        encode = lambda text: own.encode(text, allowed_special="all") if any(x in text for x in added) else own.encode_ordinary(text)
        places = [0] * (width + 1)
        names = [x.split()[0] for x in PIECES.split(", ")]
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) if text else []
                ids.append(CLOSING)
                n, raw = len(ids), memoryview(np.array(ids, "<u4").tobytes())
                for a in range(0, n, width):
                    k = min(width, n - a)
                    for c, v in zip(cols, (key, a, k, zlib.crc32(raw[4 * a : 4 * (a + k)]), n, part, places[k])):
                        c.append(v)
                    places[k] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is the largest that is at most room; few kinds of lengths are preferred."""
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        most = min(counts[length], room // length) if length <= room else 0
        k = 1
        while most > 0:  # the count in powers of two, so that layers grow with its logarithm
            k = min(k, most)
            new = (reach | reach << (k * length)) & mask
            if new != reach:
                layers.append((length, k, reach))
                reach = new
                if reach >> room & 1:
                    most = 0
                    break
            most -= k
            k *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(layers):
        if not before >> at & 1:
            at -= k * length
            used[length] = used.get(length, 0) + k
    return used


def plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, dict[int, int]]]:
    """(times, pattern) in order; the patterns use every piece of the histogram exactly once."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    out = []
    while counts:
        first = max(counts)
        if first == width:
            out.append((counts.pop(first), {first: 1}))
            continue
        counts[first] -= 1
        pattern = fill({k: n for k, n in counts.items() if n}, width - first)
        counts[first] += 1
        pattern[first] = pattern.get(first, 0) + 1
        times = min(counts[k] // c for k, c in pattern.items())
        for k, c in pattern.items():
            counts[k] -= times * c
            if not counts[k]:
                del counts[k]
        out.append((times, pattern))
    return out


def most_intervals(width: int) -> int:
    """A bound of intervals(), whatever the input: each of at most width patterns uses up a length, and k different lengths in one window add up to k (k + 1) / 2 at least."""
    return width * (math.isqrt(2 * width) + 1)


def intervals(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, per window, first sequence, offset): pieces of a length ranked in [from, to) go to these windows."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for times, pattern in patterns:
        offset = 0
        for length, c in sorted(pattern.items(), reverse=True):
            a = used.get(length, 0)
            rows.append((length, a, a + times * c, c, sequence, offset))
            used[length] = a + times * c
            offset += length * c
        sequence += times
    return rows


def pack(docs: DataFrame, scratch: Scratch, width: int = WIDTH, vocabulary: str = VOCABULARY, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = scratch.cut(cut_pieces(docs, load_ranks(spark, vocabulary), load_added(spark, tokenizer), width), "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = per_task.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    before = scratch.cut(before.select("length", "part", "n", F.coalesce("before", F.lit(0)).alias("before")), "before")
    histogram = {r[0]: r[1] for r in before.groupBy("length").agg(F.sum("n")).collect()}  # at most width rows
    rows = intervals(plan(histogram, width))
    if len(rows) > most_intervals(width):
        raise AssertionError(f"{len(rows)} intervals")
    where = spark.createDataFrame(rows or [(0,) * 6], "length bigint, a bigint, b bigint, per bigint, first bigint, at bigint")
    ranked = pieces.join(before.drop("n"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("place"))
    placed = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (F.col("rank") >= F.col("a")) & (F.col("rank") < F.col("b"))).drop(where["length"])  # at most most_intervals(width) rows
    k = F.col("rank") - F.col("a")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.expr("(rank - a) div per")).alias("sequence_id"), (F.col("at") + k % F.col("per") * F.col("length")).alias("offset"))


def op9_bin_slack_packing(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), Scratch(spark))
