"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to character n-grams of itself
with its edges marked: the longest n of which any gram is known decides, by those grams' mean log frequency, from five
characters down to one. A text's score is the softmax of the mean over its words: one minus doubt, per word.

The model is fitted on a bounded sample of labelled rows, about SAMPLE_DOCS, chosen by a hash of their id. All words and
n-grams of that sample are counted in Spark and kept, as 64-bit hashes in sorted arrays with a row of logs for each; the
number of languages is taken to be small. Everything else reads all rows and whole texts.

Cases. Null texts and texts without a letter: ``und``, score 0. Null lang: not learned from. Null doc_id: not learned
from, held_out false. No row to learn from: ``und`` everywhere. Ties: the language that sorts first. Repeated rows: each
counts and is judged. Empty table: no rows. Extra columns stay unless named lang_pred or score.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_DOCS = 20_000
LONGEST = 5
SMOOTH = 0.1
UNIT = 1 << 16  # the weights of n-grams are logs in such fractions, so that sums don't depend on their order
MEMO, LONG = 300_000, 64  # words a worker remembers before it starts again, and the characters of the longest of them

_words = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows the model never learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counts(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        by = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by[lang].update(_words(text.lower()))
        rows = [(lang, w, n) for lang, c in by.items() for w, n in c.items()]
        a = list(zip(*rows)) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.string()), pa.array(a[1], pa.string()), pa.array(a[2], pa.int64())], ["lang", "word", "n"])


def hash_of(piece: str, k: int) -> int:
    """Of a word (k = 0) or an n-gram of k characters."""
    return xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass"), k) - (1 << 63)


def grams_of(word: str, k: int) -> list[str]:
    edged = f"^{word}$"
    return [g for i in range(len(edged) - k + 1) if (g := edged[i : i + k]) not in ("^", "$")]


def _pieces(batches: Iterator) -> Iterator:
    """Of (lang, word, n): (lang, k, h, n), the words and the n-grams with their weights."""
    import pyarrow as pa

    for batch in batches:
        found: Counter = Counter()
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            found[lang, 0, hash_of(word, 0)] += n
            weight = round(math.log1p(n) * UNIT)
            for k in range(1, LONGEST + 1):
                for g in grams_of(word, k):
                    found[lang, k, hash_of(g, k)] += weight
        a = list(zip(*found)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.string()), pa.array(a[1], pa.int32()), pa.array(a[2], pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "k", "h", "n"])


class Model:
    """Log frequencies per language of words (k = 0) and of character n-grams, by their hashes in ascending order."""

    def __init__(self, langs: list[str], k: np.ndarray, h: np.ndarray, lang: np.ndarray, n: np.ndarray):
        """lang: places in langs, which is sorted."""
        self.langs = langs
        self.tables = [self._logs(h[k == i], lang[k == i], n[k == i] / (UNIT if i else 1)) for i in range(LONGEST + 1)]

    @classmethod
    def of(cls, words: list[tuple[str, str, int]]) -> Model:
        """The model of counted words (lang, word, n)."""
        import pyarrow as pa

        columns = [pa.array(c) for c in zip(*words)]
        found = [(*k, n) for b in _pieces([pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])]) for *k, n in zip(*b.to_pydict().values())]
        langs = sorted({x[0] for x in found})
        return cls(langs, *(np.array([x[i] for x in found]) for i in (1, 2)), np.array([langs.index(x[0]) for x in found]), np.array([x[3] for x in found]))

    def _logs(self, h: np.ndarray, lang: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, row = np.unique(h, return_inverse=True)
        m = np.zeros((len(keys), len(self.langs)))
        m[row, lang] = n
        return keys, np.log((m + SMOOTH) / (m.sum(0) + SMOOTH * max(1, len(m)))).astype(np.float32)

    def _found(self, hashes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether each is known, and its row."""
        keys = self.tables[k][0]
        x = np.array(hashes, np.int64)
        at = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
        return (keys[at] == x if len(keys) else np.zeros(len(x), bool)), at

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word."""
        known, at = self._found([hash_of(w, 0) for w in words], 0)
        out = np.zeros((len(words), len(self.langs)), np.float32)
        out[known] = self.tables[0][1][at[known]]
        for i in np.flatnonzero(~known):
            for k in range(LONGEST, 0, -1):
                have, row = self._found([hash_of(g, k) for g in grams_of(words[i], k)], k)
                if have.any():
                    out[i] = self.tables[k][1][row[have]].mean(0)
                    break
        return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS) -> Model:
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    n = rows.count()
    share = min(1.0, sample / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    words = picked.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(_counts, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    pieces = words.mapInArrow(_pieces, "lang string, k int, h bigint, n bigint").groupBy("lang", "k", "h").agg(F.sum("n").alias("n"))
    got = pieces.toArrow()  # bounded by SAMPLE_DOCS: the pieces of that many texts
    names = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else None
    kept = sorted(names.dictionary.to_pylist()) if names is not None else []
    place = np.array([kept.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()] if kept else np.zeros(0, np.int64)
    return Model(kept, *(got.column(c).to_numpy() for c in ("k", "h")), place, got.column("n").to_numpy())


class _Memo:
    """Rows of words' scores, remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.start()

    def start(self) -> None:
        self.at: dict[str, int] = {}
        self.rows = np.zeros((4096, len(self.model.langs)), np.float32)
        self.used = 0

    def places(self, words: list[str]) -> np.ndarray:
        if self.used >= MEMO:  # between texts, so that places stay valid within one
            self.start()
        new = list(set(words).difference(self.at))
        if new:
            end = self.used + len(new)
            while end > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[self.used : end] = self.model.scores(new)
            self.at.update(zip(new, range(self.used, end)))
            self.used = end
        out = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        for w in new:
            if len(w) > LONG:
                del self.at[w]
        return out


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred (string) and score (double)."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = names.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = shared.value
        memo = _Memo(model) if model.langs else None
        for batch in batches:
            langs, scores = [], []
            for x in batch.column(where).to_pylist():
                if memo is None or not x or not any(map(str.isalpha, x)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at = memo.places(_words(x.lower()))
                mean = np.bincount(at, minlength=1).astype(np.float64) @ memo.rows[: at.max() + 1] / len(at) if len(at) > 50_000 else memo.rows[at].mean(0, dtype=np.float64)
                p = np.exp(mean - mean.max())
                langs.append(model.langs[int(p.argmax())])
                scores.append(float(p.max() / p.sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    plain = docs.select(*names)
    schema = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(run, schema)


def op8_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
