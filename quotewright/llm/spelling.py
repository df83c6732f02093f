"""Spelling variants: words that differ by one code point, and the frequent form that a rare one stands for.

Words are counted over all documents. From prefix and suffix sums of a polynomial hash NumPy gives, for all words of a batch
at once, the hash of each word and of each of its deletions (the word without one code point). Two words differ by one inserted
or deleted code point if and only if one is a deletion of the other, and by a replaced one if and only if their deletions at one
place are equal. So rows (key, place) are dealt by the key's leading bits (radix), sorted by key, and runs of equal keys are
read once: strings are compared there, so that a collision of hashes links nothing. A run gives every word in it the number of
its near words and the best of them, without making pairs; sums and minima over a word's runs do the rest. Forms are followed
to the last by doubling: a form has five times a word's count, so chains are short.

Scale: a document's words are counted in its task, where counts are given on when there are MEMO of them; from then on rows are
words, one for each code point. At one place a word has as many variants as there are letters, so runs are short whatever the
corpus. Rows of words above LONG code points carry an id instead of the word, or they would grow with the square of its length:
their pairs (again one place, so few) are joined with the words and compared there.

Cases. Null or empty text: no words. Null doc_id: an empty one. Repeated rows: all count. Ties between forms: the smallest in code
point order. Empty table: no rows. Very long runs: words like others, if they occur often enough. Columns but doc_id and text are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, texts_of

LEAST_CHARS, LEAST_COUNT, TIMES, EVERY = 6, 5, 5, 199
MEMO, MEMO_BYTES = 400_000, 48 << 20  # counts a task holds before it gives them on
LONG, OUT = 64, 200_000  # code points of a word that is carried along; rows of an output batch
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
RADIX_BITS = 20

#: Letters a-z and the two-byte sequences C3 80 to C3 BF (U+00C0 to U+00FF) make runs, in lower-cased UTF-8.
_SPACED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PLAIN = bytes([*range(128), *range(0x80, 0xC0), 0xC3])
_OTHER = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")


def runs_of(text: bytes) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF in a UTF-8 text, A-Z lower-cased."""
    text = text.lower()
    if text.translate(None, _PLAIN):
        text = _OTHER.sub(b" ", text)
    return text.translate(_SPACED).split()


def document_words(doc: str, text: bytes) -> Counter:
    """Runs of a text and how often they occur; those whose hash with the document EVERY divides lose the code point it names."""
    counts = Counter(runs_of(text))
    runs = list(counts)
    hashes = np.fromiter(map(zlib.crc32, runs, repeat(zlib.crc32(f"{doc}:".encode()))), np.int64, len(runs))
    cut = []
    for i in np.flatnonzero(hashes % EVERY == 0):
        run = runs[i].decode()
        at = int(hashes[i]) % len(run)
        cut.append(((run[:at] + run[at + 1 :]).encode(), counts.pop(runs[i])))
    for word, n in cut:
        counts[word] += n
    return counts


def _count(batches: Iterator) -> Iterator:
    import pyarrow as pa

    counts, held = {}, 0

    def given():
        words = pa.array(counts.keys(), pa.binary()).cast(pa.string())
        numbers = pa.array(counts.values(), pa.int64())
        for i in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([words.slice(i, 50_000), numbers.slice(i, 50_000)], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text")):
            if not text:
                continue
            for word, n in document_words("" if doc is None else str(doc), text).items():
                if len(word) < LEAST_CHARS:  # bytes: never more code points
                    continue
                if word in counts:
                    counts[word] += n
                else:
                    counts[word] = n
                    held += len(word)
            if len(counts) >= MEMO or held >= MEMO_BYTES:
                yield from given()
                counts, held = {}, 0
    yield from given()


def words(docs: DataFrame) -> DataFrame:
    """word, n and id of all words of LEAST_CHARS code points or more that occur LEAST_COUNT times or more."""
    counted = docs.select("doc_id", "text").mapInArrow(_count, "word string, n bigint").where(F.char_length("word") >= LEAST_CHARS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT).withColumn("id", F.xxhash64("word"))


KEYS = "key bigint, place int, own boolean, id bigint, n bigint, word string"


def _scan(sums: np.ndarray, place: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """Hashes of words and of their deletions: sums of code * BASE ** place, where what follows a deletion moves one place down."""
    terms = codes * sums[place]
    upto = np.cumsum(terms)
    before = np.append(np.uint64(0), upto)[starts]
    total = np.append(np.uint64(0), upto)[starts + lengths] - before
    prefix = upto - terms - np.repeat(before, lengths)
    suffix = np.repeat(total, lengths) - prefix - terms
    return total, prefix + suffix * _INVERSE


def deletion_keys(batch_words: list[str]) -> tuple[np.ndarray, ...]:
    """For a list of words: their hashes; and for all their code points in a row the deletion's hash, the place and whether it is the first of equal neighbours."""
    lengths = np.fromiter(map(len, batch_words), np.int64, len(batch_words))
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer("".join(batch_words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max(initial=0)) + 1, BASE, np.uint64)
    powers[0] = 1
    total, deleted = _scan(np.multiply.accumulate(powers), place, starts, lengths, mix(raw + np.uint64(1)))
    own = np.append(True, raw[1:] != raw[:-1]) | (place == 0) if len(raw) else np.zeros(0, bool)
    return total, deleted, place, own


def _keys(batches: Iterator) -> Iterator:
    import pyarrow as pa

    names = [f.split()[0] for f in KEYS.split(", ")]
    for batch in batches:
        every = batch.column(0).to_pylist()
        ends = np.cumsum([len(w) for w in every])
        i = 0
        while i < len(every):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + OUT)))
            part = every[i:j]
            total, deleted, place, own = deletion_keys(part)
            row = np.append(np.arange(len(part)), np.repeat(np.arange(len(part)), [len(w) for w in part]))
            short = pa.array([w if len(w) <= LONG else None for w in part], pa.string())
            at = pa.array(row)
            arrays = [np.append(total, deleted).view(np.int64), np.append(np.full(len(part), -1), place).astype(np.int32), np.append(np.ones(len(part), bool), own)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), batch.column(2).slice(i, j - i).take(at), batch.column(1).slice(i, j - i).take(at), short.take(at)], names)
            i = j


def without(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def _of_run(rows: list[tuple]) -> Iterator[tuple]:
    """What a run of equal keys says of its words: (word, near words, the best's count, the best, null, ...) or, where a word isn't at hand, ids and places of pairs."""
    if any(r[4] is None for r in rows):
        at = defaultdict(list)
        for place, own, i, _, _ in rows:
            at[place].append((i, place))
            if place >= 0 and own:
                at["own"].append((i, place))
        groups = [(p, q) for k, g in at.items() if k not in ("own", -1) for p, q in combinations(g, 2)]
        for a, b in [*groups, *((p, q) for p in at.get(-1, ()) for q in at.get("own", ()))]:
            yield None, None, None, None, a[0], a[1], b[0], b[1]
        return
    strings = defaultdict(lambda: defaultdict(list))
    for place, own, _, n, word in rows:
        groups = strings[without(word, place)]
        groups[place].append((-n, word))
        if place >= 0 and own:
            groups["own"].append((-n, word))
    for groups in strings.values():
        longer = sorted(groups.pop("own", ()))
        for n, word in groups.pop(-1, ()):
            if longer:
                yield word, len(longer), -longer[0][0], longer[0][1], None, None, None, None
            for _, other in longer:
                yield other, 1, -n, word, None, None, None, None
        for same in groups.values():
            if len(same) > 1:
                first, second = sorted(same)[:2]
                for x in same:
                    n, best = second if x == first else first
                    yield x[1], len(same) - 1, -n, best, None, None, None, None


NEAR = "word string, n_near bigint, best_n bigint, best string, a bigint, a_place int, b bigint, b_place int"


def _runs(batches: Iterator) -> Iterator:
    """Reads rows sorted by key; holds a batch and the run that is open."""
    import pyarrow as pa

    kinds = [{"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[f.split()[1]] for f in NEAR.split(", ")]
    names = [f.split()[0] for f in NEAR.split(", ")]

    def given(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)

    def rows_of(batch, i, j):
        return list(zip(*(batch.column(c).slice(i, j - i).to_pylist() for c in range(1, 6))))

    key, open_ = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
        out = []
        if keys[0] == key:
            open_ += rows_of(batch, 0, cuts[1])
            runs = 1
        else:
            runs = 0
        if runs < len(cuts) - 1:
            out += _of_run(open_) if len(open_) > 1 else ()
            lead, tail = cuts[runs:-1], cuts[runs + 1 :]
            many = (tail - lead > 1) & (tail < len(keys))
            if many.any():
                columns = [batch.column(c).take(pa.array(np.concatenate([np.arange(i, j) for i, j in zip(lead[many], tail[many])]))).to_pylist() for c in range(1, 6)]
                at = 0
                for size in (tail - lead)[many]:
                    out += _of_run(list(zip(*(c[at : at + size] for c in columns))))
                    at += size
            key, open_ = keys[-1], rows_of(batch, cuts[-2], cuts[-1])
        yield given(out)
    if len(open_) > 1:
        yield given(list(_of_run(open_)))


def near(listed: DataFrame, scratch: Scratch) -> DataFrame:
    """word, n_near and best (struct of n, negative, and word) of listed words (word, n, id) that have near words."""
    keys = listed.select("word", "n", "id").mapInArrow(_keys, KEYS).withColumn("radix", F.shiftrightunsigned("key", 64 - RADIX_BITS))
    dealt = keys.repartition("radix").sortWithinPartitions("key").drop("radix")
    found = scratch.cut(dealt.mapInArrow(_runs, NEAR), "spelling-near")
    one = lambda c: listed.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(f"{c}_n"))
    pairs = found.where("a is not null").join(one("a"), "a").join(one("b"), "b")
    rest = lambda c: F.when(F.col(f"{c}_place") < 0, F.col(f"{c}_word")).otherwise(F.concat(F.expr(f"substring({c}_word, 1, {c}_place)"), F.expr(f"substring({c}_word, {c}_place + 2)")))
    pairs = scratch.cut(pairs.where((rest("a") == rest("b")) & (F.col("a_word") != F.col("b_word"))).select("a_word", "a_n", "b_word", "b_n").distinct(), "spelling-pairs")
    sides = [pairs.select(F.col(f"{x}_word").alias("word"), F.lit(1).cast("bigint").alias("n_near"), F.col(f"{y}_n").alias("best_n"), F.col(f"{y}_word").alias("best")) for x, y in ("ab", "ba")]
    every = found.where("a is null").select("word", "n_near", "best_n", "best").union(sides[0]).union(sides[1])
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word and root: the last of the words that its form, that one's form and so on lead to."""
    links = scratch.cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        up = links.select(F.col("word").alias("w"), F.col("root").alias("r"))
        new = scratch.cut(links.join(up, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "spelling-roots")
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        links = new.select("word", "root")


def variants(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per word: word, n, n_near, form (the near word it stands for, or null), form_n and root."""
    listed = scratch.cut(words(docs), "spelling-words")
    best = listed.join(near(listed, scratch), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.n") >= TIMES * F.col("n"), F.col("best")).alias("best"))
    best = scratch.cut(best.select("word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.n")).alias("form_n")), "spelling-forms")
    last = roots(best.where("form is not null"), scratch)
    return best.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(docs, Scratch(spark)).select("word", "form", "root", "n", "n_near", "form_n")


def _oracle() -> str:
    from .prefixes import crc32_sql

    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE o AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {crc32_sql("(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)")} AS h FROM o),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1),
v AS (SELECT * FROM w WHERE length(word) >= {LEAST_CHARS} AND n >= {LEAST_COUNT}),
d AS (SELECT word, n, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM d a JOIN v ON v.word = a.rest UNION SELECT v.word, a.word, a.n FROM d a JOIN v ON v.word = a.rest),
b AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * n THEN other END AS form, CASE WHEN m >= {TIMES} * n THEN m END AS form_n FROM v LEFT JOIN b USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f AS last ON last.word = r.root AND last.form IS NULL
"""


ORACLE = _oracle()
