"""Substring dedup: passages that repeat across documents, by paragraph MinHash banding.

Two steps, each of which removes what a smaller doc_id holds.

Paragraphs are lines of MIN_WORDS words or more, and runs of shorter lines that have as many; runs start at lines that
content chooses and overlap, so that copies are found wherever they stand among other lines. Equal ones are one from the start; distinct ones meet in MinHash bands
(BANDS of ROWS values), are confirmed by the exact Jaccard similarity of their 5-word shingles, 0.8 or more, and are
clustered by components. Each cluster keeps the paragraph of its smallest (doc_id, place) and what else that document
has of it; in other documents its paragraphs go whole, edited or not. Of pairs at 0.8, the bands find 99.7 %.

Passages also stand in the middle of lines, among other words, so the text that is left is searched for sequences of MIN_WORDS
words that another document holds, word by word. Few of them need hashing: windows of WINDOW words start at anchors, which
content alone chooses (the rightmost smallest shingle hash of every GAP consecutive ones), so that every sequence of
WINDOW + GAP - 1 = MIN_WORDS words holds a whole window, the same in each of its copies, whatever stands around it. Only
sequences that hold a window of two different texts are hashed and grouped; those with a smaller holder go. So no
MIN_WORDS words of two documents stay equal, and nothing else goes. A copy edited more often than every MIN_WORDS words
stays unless it is a paragraph of its own.

Texts of equal words are one from the start, too: of MIN_WORDS words or more, copies of the smallest doc_id go whole.

Cases. Null ids and null, empty or shorter texts: unchanged, no part taken. Very long texts: whole. Ties: the smallest
(doc_id, place) is kept. Repeats within one document alone: unchanged. Repeated ids: their rows are left unchanged, as
places in them are ambiguous; others still yield to them. Exact copies: the smallest id stays, the others' texts become
empty. Empty table: no rows. Extra columns stay, whatever their names; one named removed is replaced.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, append, connected_components, mix, multipliers, narrowed, shingles, text_hashes, word_edges
from .links import resolve, shared_keys

SHINGLE, WINDOW, GAP = 5, 20, 31
BANDS, ROWS = 8, 3
GROUP = 16  # paragraphs of a band's key that all meet each other; larger groups are resolved in rounds
MIN_WORDS = WINDOW + GAP - 1
STRIDE = 12  # words in which runs of short lines differ, at their starts and ends together
SEED = 77_003
SLICE = 1 << 16
TEXTS = 1_000  # texts that a task works on at a time
BLOCK = 1 << 18  # bytes of texts that are scanned as one; a longer text is scanned alone
TEXT, ANCHOR, PARAGRAPH = 0, 1, 2

_A = np.uint64(0x9E3779B97F4A7C15)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w consecutive values, in time linear in x: prefix and suffix minima of blocks of w."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


_LOW = np.uint64((1 << 24) - 1)


def anchors(s: np.ndarray, stops: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
    """Places of the smallest of every GAP consecutive hashes (by their high 40 bits, the rightmost among equals), ascending, those with room for a paragraph.

    starts, stops: of the sequences that stand in s one after another, if it isn't one."""
    n = len(s)
    if n < GAP:
        return np.zeros(0, np.int64)
    starts, stops = (np.zeros(1, np.int64), np.array([n])) if stops is None else (starts, stops)
    place = np.arange(n, dtype=np.uint64)
    low = sliding_min((s & ~_LOW) | (_LOW - (place & _LOW)), GAP) & _LOW  # the place, counted down in the low bits
    first = place[: n - GAP + 1]
    at = (first + ((_LOW - low - first) & _LOW)).astype(np.int64)
    inside = np.zeros(n + 1, np.int64)  # counts the sequences that have room for GAP hashes there
    room = stops - starts >= GAP
    np.add.at(inside, starts[room], 1)
    np.add.at(inside, stops[room] - GAP + 1, -1)
    whole = np.cumsum(inside)[: len(at)] > 0
    at = at[whole]
    at = at[np.append(np.ones(min(1, len(at)), bool), at[1:] != at[:-1])]
    last = stops[np.searchsorted(starts, at, "right") - 1] if len(starts) else at
    return at[at <= last - (WINDOW - SHINGLE + 1)]


def contents_of(rows: np.ndarray) -> np.ndarray:
    """The hash of each column's shingles, in order."""
    content = np.zeros(rows.shape[1], np.uint64)
    for r in rows:
        content = content * _A + r
    return mix(content).view(np.int64)


def hashed(h: np.ndarray) -> int:
    """A 64-bit hash of a sequence of words' or shingles' hashes."""
    return xxhash.xxh3_64_intdigest(h.tobytes()) - (1 << 63)


def thinned(at: np.ndarray, marks: list[int]) -> np.ndarray:
    """Which of the places (ascending) are kept: those of the smallest marks first, none within STRIDE of another, and no gap that has room for one."""
    kept, taken = np.zeros(len(at), bool), np.zeros(len(at), bool)
    first, last = np.searchsorted(at, at - STRIDE, "right").tolist(), np.searchsorted(at, at + STRIDE).tolist()
    for i in np.lexsort((at, marks)).tolist():
        if not taken[i]:
            kept[i] = taken[first[i] : last[i]] = True
    return kept


def runs_of(a: np.ndarray, b: np.ndarray, h: np.ndarray, least: int) -> np.ndarray:
    """(start, stop) of the runs of short lines (a, b) that follow each other, of at least that many words each.

    A run starts at a line and ends with the line that makes it long enough; of runs with one end the shortest is taken, and
    where lines are very short, content alone chooses which runs are left. So copies have the same runs whatever stands before
    them, and two runs of a text, which share less than `least` words and differ in STRIDE or more, aren't near each other by their
    own overlap. Two more start with the first line and end with the last one, so that no line is left out.
    """
    starts = a[: np.searchsorted(a, b[-1] - least, "right")]
    stops = b[np.searchsorted(b, starts + least)]
    shortest = np.append(np.flatnonzero(stops[1:] != stops[:-1]), len(stops) - 1)
    starts, stops = starts[shortest], stops[shortest]
    kept = thinned(starts + stops, [hashed(h[i:j]) for i, j in zip(starts.tolist(), b[np.searchsorted(a, starts)].tolist())])
    starts, stops = starts[kept], stops[kept]
    runs = np.unique(np.concatenate([starts << 32 | stops, [int(a[0]) << 32 | int(stops[0]), int(starts[-1]) << 32 | int(b[-1])]]))
    return np.stack([runs >> 32, runs & 0xFFFFFFFF], 1)


def paragraphs(starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray, h: np.ndarray, least: int) -> np.ndarray:
    """(a, b) of the paragraphs of texts that stand one after another, as places of words, by a, of equal ones the longest first.

    starts: the bytes at which words start; ends: at which lines end; firsts: each text's first word; h: the words' hashes.
    """
    cuts = np.concatenate([[0], np.searchsorted(starts, ends), [len(starts)]])
    some = np.flatnonzero(cuts[1:] > cuts[:-1])
    a, b = cuts[some], cuts[some + 1]
    long = b - a >= least
    found = [np.stack([a[long], b[long]], 1)]
    turns = np.union1d(np.flatnonzero(long[1:] != long[:-1]) + 1, np.searchsorted(a, firsts)).tolist()
    for i, j in zip([0, *turns], [*turns, len(a)]):
        if i < j and not long[i] and b[j - 1] - a[i] >= least:
            found.append(runs_of(a[i:j], b[i:j], h, least))
    found = np.concatenate(found)
    return found[np.lexsort((-found[:, 1], found[:, 0]))]


def line_ends(text: bytes) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(text, np.uint8) == ord("\n"))


def lines_of(text: bytes, h: np.ndarray, least: int) -> np.ndarray:
    """(a, b) of the paragraphs, as places of words, by a, of equal ones the longest first: lines of at least that many words, and the runs of shorter lines between them. h: the words' hashes."""
    return paragraphs(word_edges(text)[::2], line_ends(text), np.zeros(1, np.int64), h, least)


def band_keys(s: np.ndarray, spans: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A key for each band of each paragraph (a, b) of a text with shingles s."""
    cuts = np.stack([spans[:, 0], spans[:, 1] - SHINGLE + 1], 1).reshape(-1)
    s = np.append(s, np.uint64(0))
    step = max(1, SLICE // len(s))  # multipliers at a time: memory as the text
    mins = np.concatenate([np.minimum.reduceat(by[i : i + step, None] * s[None, :], cuts, axis=1)[:, ::2] for i in range(0, len(by), step)])
    keys = np.repeat(np.arange(1, BANDS + 1, dtype=np.uint64)[:, None], len(spans), 1)
    for row in range(ROWS):
        keys = keys * _A + mins[row::ROWS]
    return mix(keys).T.reshape(len(spans), BANDS).view(np.int64)


def scanned(docs: DataFrame, min_words: int) -> DataFrame:
    """(kind, doc_id, cls, start, stop, w, keys): every text of min_words words or more (stop: its words), its windows (stop: where the last paragraph that holds it starts, or -1) and its paragraphs; cls and w are hashes of the text's words and of the piece's content."""

    by = multipliers(BANDS * ROWS, SEED)

    def block(ids: list[int], texts: list[bytes]):
        """The columns of the texts' rows; arrays hold the words of all texts, one text after another."""
        text = b"\n".join(texts)
        edges = word_edges(text)
        h = text_hashes(text, edges)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        firsts = np.searchsorted(edges[::2], begin)
        sizes = np.diff(firsts, append=len(h))
        enough = sizes >= min_words
        if not enough.any():
            return None
        ids, first, size = np.array(ids, np.int64)[enough], firsts[enough], sizes[enough]
        cls = np.array([hashed(h[a : a + n]) for a, n in zip(first.tolist(), size.tolist())], np.int64)
        s = shingles(h, SHINGLE)
        at = anchors(s, first + size - SHINGLE + 1, first)
        lines = paragraphs(edges[::2], line_ends(text), firsts, h, min_words)
        line = np.full(len(at), -1)
        if len(lines):
            i = np.maximum(np.searchsorted(lines[:, 0], at, "right") - 1, 0)
            line = np.where((lines[i, 0] <= at) & (at + WINDOW <= lines[i, 1]), lines[i, 0], -1)
        of_at, of_line = (np.searchsorted(first, x, "right") - 1 for x in (at, lines[:, 0]))
        of = np.concatenate([np.arange(len(ids)), of_at, of_line])
        starts = np.concatenate([0 * ids, at - first[of_at], lines[:, 0] - first[of_line]])
        stops = np.concatenate([size, np.where(line < 0, -1, line - first[of_at]), lines[:, 1] - first[of_line]])
        w = np.concatenate([cls, contents_of(s[at[None, :] + np.arange(WINDOW - SHINGLE + 1)[:, None]]), np.array([hashed(h[a:b]) for a, b in lines.tolist()], np.int64)])
        parts = (len(ids), len(at), len(lines))
        keys = band_keys(s, lines, by).reshape(-1) if len(lines) else w[:0]
        return np.repeat((TEXT, ANCHOR, PARAGRAPH), parts), ids[of], cls[of], starts, stops, w, np.repeat((0, 0, BANDS), parts), keys

    def run(batches):
        import pyarrow as pa

        names = ["kind", "doc_id", "cls", "start", "stop", "w", "keys"]
        for batch in (whole.slice(i, TEXTS) for whole in batches for i in range(0, whole.num_rows, TEXTS)):
            got, ids, texts, size = [], [], [], 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and size + len(t) > BLOCK:
                    got.append(block(ids, texts))
                    ids, texts, size = [], [], 0
                ids.append(k)
                texts.append(t)
                size += len(t)
            got = [x for x in (*got, block(ids, texts) if texts else None) if x]
            if got:
                kind, doc, cls, a, b, w, sizes, keys = (np.concatenate(x) for x in zip(*got))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(doc), pa.array(cls), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(w), lists], names)

    raw = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary"))
    return raw.mapInArrow(run, "kind int, doc_id bigint, cls bigint, start int, stop int, w bigint, keys array<bigint>")


def _fetched(docs: DataFrame, wanted: DataFrame, scratch: Scratch, make, ddl: str) -> DataFrame:
    """wanted (doc_id, at) with columns made from (text, at) pairs, of the documents there are."""
    wanted = scratch.cut(wanted, "wanted")
    raw = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("doc_id is not null")
    both = narrowed(raw, wanted, "doc_id", "doc_id").join(wanted, "doc_id").select("doc_id", F.struct("text", "at").alias("both"))
    return append(both, "both", make, ddl, TEXTS).drop("both")


def merged_spans(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
    """The (a, b, src_doc) merged to disjoint (a, b, src_docs), which names every source."""
    merged: list[list] = []
    for a, b, src in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
            merged[-1][2].add(src)
        else:
            merged.append([a, b, {src}])
    return [(a, b, sorted(docs)) for a, b, docs in merged]


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and the white space behind them."""
    starts = word_edges(text)[::2]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(text)
    return b"".join([*out, text[at:]])


def paragraph_sets(docs: DataFrame, ids: DataFrame, contents: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, v, n, sig, s) of distinct paragraphs, read at their first place: links.within says what."""

    def make():
        import pyarrow as pa

        kind = pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int32()), ("s", pa.binary())]))

        def work(rows):
            out = []
            for r in rows:
                h, found = text_hashes(r["text"]), []
                for x in r["at"]:
                    own = h[x["start"] : x["stop"]]
                    if hashed(own) == x["w"]:  # else a repeated id's other text
                        s = np.unique(shingles(own, SHINGLE))
                        found.append({"id": x["w"], "n": len(s), "s": s.tobytes()})
                out.append(found)
            return [pa.array(out, kind)]

        return work

    wanted = contents.join(ids.withColumnRenamed("id", "w"), "w").groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("w", "first.start", "first.stop")).alias("at"))  # no more than a text has paragraphs
    got = _fetched(docs, wanted, scratch, make, "got array<struct<id:bigint,n:int,s:binary>>").select(F.explode("got").alias("g"))
    sets = got.select("g.id", F.lit(0).cast("bigint").alias("v"), "g.n", F.lit(None).cast("binary").alias("sig"), "g.s").dropDuplicates(["id"])
    return scratch.cut(sets, "sets")


def near_paragraphs(docs: DataFrame, lines: DataFrame, scratch: Scratch, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, a, b, src_doc): the paragraphs that go, as another document with a smaller id keeps a near copy."""
    contents = lines.groupBy("w").agg(F.min(F.struct("doc_id", "start", "stop")).alias("first"), F.max("doc_id").alias("last_doc"), F.first("keys").alias("keys"))
    contents = scratch.cut(contents, "contents")
    keyed = shared_keys(contents.select(F.explode("keys").alias("key"), F.col("w").alias("id")), scratch, "keyed", "c")
    sets = paragraph_sets(docs, keyed.select("id").distinct(), contents, scratch)
    keyed = keyed.join(sets.select("id"), "id", "left_semi")
    none = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    comps = resolve(keyed, none, sets, num, den, None, scratch, "near", GROUP)
    of = contents.join(comps.withColumnRenamed("node", "w"), "w", "left").select("w", F.coalesce("comp", "w").alias("comp"), F.col("first.doc_id").alias("first_doc"), "last_doc")
    clusters = of.groupBy("comp").agg(F.min("first_doc").alias("src_doc"), F.max("last_doc").alias("last")).where("src_doc < last").select("comp", "src_doc")
    sources = scratch.cut(of.join(clusters, "comp").select("w", "src_doc"), "sources")
    gone = narrowed(lines, sources, "w", "w").join(sources, "w").where("doc_id <> src_doc")
    return scratch.cut(gone.select("doc_id", F.col("start").alias("a"), F.col("stop").alias("b"), "src_doc"), "near-paragraphs")


def equal_passages(docs: DataFrame, windows: DataFrame, copies: DataFrame, gone: DataFrame, scratch: Scratch, min_words: int) -> DataFrame:
    """(doc_id, a, b, src_doc): min_words words that a smaller doc_id holds, outside the spans of gone and of whole copies."""
    def repeated(windows: DataFrame, name: str) -> DataFrame:
        several = scratch.cut(windows.groupBy("w").agg(F.min("cls").alias("one"), F.max("cls").alias("other")).where("one < other").select("w"), f"{name}-several")
        return scratch.cut(narrowed(windows, several, "w", "w").join(several, "w"), name)

    again = repeated(windows, "windows").join(copies.select("doc_id", "cls"), ["doc_id", "cls"], "left_anti")
    again = repeated(again.join(gone.select("doc_id", F.col("a").alias("line")), ["doc_id", "line"], "left_anti"), "again")  # some stand only in paragraphs that go
    again = again.groupBy("doc_id", "cls").agg(F.collect_list("start").alias("starts"))  # no more than a text has windows
    spans = gone.groupBy("doc_id").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    wanted = again.join(spans, "doc_id", "left").groupBy("doc_id").agg(F.collect_list(F.struct("cls", "starts", "spans")).alias("at"))  # one text, but for repeated ids

    def make():
        import pyarrow as pa

        def work(rows):
            ends, keys, places = [0], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for r in rows:
                h, n = text_hashes(r["text"]), 0
                for x in r["at"]:
                    if hashed(h) != x["cls"]:
                        continue
                    marked = np.zeros(len(h) - min_words + 1, bool)
                    for a in x["starts"]:
                        marked[max(0, a + WINDOW - min_words) : a + 1] = True
                    for y in x["spans"] or ():
                        marked[max(0, y["a"] - min_words + 1) : y["b"]] = False
                    at = np.flatnonzero(marked)
                    if len(at):
                        keys.append(shingles(h, min_words).view(np.int64)[at])
                        places.append(at)
                        n += len(at)
                ends.append(ends[-1] + n)
            found = pa.StructArray.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(places).astype(np.int32))], ["key", "at"])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)]

        return work

    places = _fetched(docs, wanted, scratch, make, "got array<struct<key:bigint,at:int>>").select("doc_id", F.explode("got").alias("g")).select("g.key", "doc_id", "g.at")
    places = scratch.cut(places, "places")
    scratch.keep("copies", "near-paragraphs", "places")
    holders = scratch.cut(places.groupBy("key").agg(F.min("doc_id").alias("src_doc"), F.max("doc_id").alias("last")).where("src_doc < last").select("key", "src_doc"), "holders")
    hits = narrowed(places, holders, "key", "key").join(holders, "key").where("doc_id <> src_doc")
    return hits.select("doc_id", F.col("at").alias("a"), (F.col("at") + min_words).alias("b"), "src_doc")


def dedup(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS, removed: str | None = "removed") -> DataFrame:
    """docs with the repeated passages removed from text, and a column of that name: array of (a, b, src_doc, src_docs), word spans, the smallest and all documents that hold the kept copies."""
    if min_words < MIN_WORDS:
        raise ValueError(f"windows are only certain to be found in {MIN_WORDS} words or more")
    raw = docs.select("doc_id", "text")
    rows = scratch.cut(scanned(raw, min_words), "scanned")
    texts = rows.where(f"kind = {TEXT}").select("doc_id", "cls", F.col("stop").alias("n"))
    first = texts.groupBy("cls").agg(F.min("doc_id").alias("src_doc"), F.max("doc_id").alias("last")).where("src_doc < last").select("cls", "src_doc")
    copies = scratch.cut(texts.join(first, "cls").where("doc_id <> src_doc"), "copies")
    near = near_paragraphs(raw, rows.where(f"kind = {PARAGRAPH}").select("doc_id", "start", "stop", "w", "keys"), scratch)
    scratch.keep("scanned", "copies", "near-paragraphs")
    equal = equal_passages(raw, rows.where(f"kind = {ANCHOR}").select("doc_id", "cls", "start", F.col("stop").alias("line"), "w"), copies, near, scratch, min_words)
    repeated = raw.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("c")).where("c > 1").select("doc_id")
    spans = copies.select("doc_id", F.lit(0).alias("a"), F.col("n").alias("b"), "src_doc").union(near).union(equal).join(repeated, "doc_id", "left_anti")
    spans = scratch.cut(spans.groupBy("doc_id").agg(F.collect_set(F.struct("a", "b", "src_doc")).alias("spans")), "spans")
    scratch.keep("spans")

    def make():
        import pyarrow as pa

        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("src_doc", pa.int64()), ("src_docs", pa.list_(pa.int64()))]))

        def work(rows):
            texts, found = [], []
            for r in rows:
                gone = merged_spans([(x["a"], x["b"], x["src_doc"]) for x in r["spans"] or []])
                texts.append(without(r["text"], [x[:2] for x in gone]) if gone else r["text"])
                found.append([{"a": a, "b": b, "src_doc": docs[0], "src_docs": docs} for a, b, docs in gone])
            return [pa.array(texts, pa.binary()), pa.array(found, kind)]

        return work

    # columns by place, so that no name can clash; texts that stay aren't shuffled, as far as the map of ids tells
    names = docs.columns
    own = {c: f"_c{i}" for i, c in enumerate(names)}
    key, text = own["doc_id"], own["text"]
    all_ = docs.toDF(*own.values())
    rest = [c for c in own.values() if c != text]
    joined = narrowed(all_, spans, "doc_id", key).join(spans.withColumnRenamed("doc_id", "_id"), F.col(key) == F.col("_id"), "left")
    both = joined.select(*rest, F.struct(F.col(text).cast("binary").alias("text"), "spans").alias("_both"))
    removed_type = "array<struct<a:int,b:int,src_doc:bigint,src_docs:array<bigint>>>"
    done = append(both, "_both", make, f"_text binary, _removed {removed_type}", TEXTS).select(*rest, F.col("_text").cast("string").alias("_text"), "_removed")
    stay = narrowed(all_, spans, "doc_id", key, False).select(*rest, F.col(text).alias("_text"), F.expr(f"cast(array() as {removed_type})").alias("_removed"))
    done = done.union(stay)
    out = [F.col("_text").alias(c) if c == "text" else F.col(own[c]).alias(c) for c in names if c != removed]
    return done.select(*out, F.col("_removed").alias(removed)) if removed else done.select(*out)


def op4_repeated_passages(spark, sf_dir):
    """One row per document: its class (component_id, the smallest doc_id that shared passages lead to), the documents it yields to (n_links) and those linked with it from either end (n_linked), what went and what stays."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = scratch.cut(dedup(docs, scratch), "done")
    edges = done.select(F.col("doc_id").alias("a"), F.explode(F.array_distinct(F.flatten("removed.src_docs"))).alias("b"))
    edges = scratch.cut(edges.where("a is not null").distinct(), "links")
    comps = connected_components(edges, scratch, "documents")
    linked = edges.select("a", "b").union(edges.select("b", "a")).groupBy("a").agg(F.count("*").alias("n_linked")).withColumnRenamed("a", "doc_id")
    spans = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["a"].cast("string"), x["b"].cast("string"), x["src_doc"].cast("string"))), ",")
    words = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, x: n + x["b"] - x["a"])
    facts = scratch.cut(comps.withColumnRenamed("node", "doc_id").join(linked, "doc_id"), "facts")
    some = narrowed(done, facts, "doc_id", "doc_id").join(facts, "doc_id", "left")  # other texts aren't shuffled
    out = some.unionByName(narrowed(done, facts, "doc_id", "doc_id", False), allowMissingColumns=True)
    return out.select("doc_id", F.coalesce("comp", "doc_id").alias("component_id"), F.size(F.array_distinct(F.flatten("removed.src_docs"))).cast("bigint").alias("n_links"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), words.alias("removed_words"), spans.alias("removed_spans"), "text")
