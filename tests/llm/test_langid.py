import math
import re
import zlib
from collections import Counter

from quotewright.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in langid.op8_language_id(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got.keys() == {r.doc_id for r in rows}
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out and r.lang]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_hard_documents(spark, hard, none):
    model = langid.fit(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows = langid.predict(hard, model).collect()
    assert len(rows) == hard.count()
    for r in rows:
        letters = bool(r.text) and any(map(str.isalpha, r.text))
        assert (r.lang_pred in model.langs) == letters and (letters or (r.lang_pred == "und" and r.score == 0))
    empty = langid.fit(none)
    assert {r.lang_pred for r in langid.predict(hard, empty).collect()} == {"und"}
    assert langid.predict(none, model).count() == 0


def test_learns_from_no_held_out_row_and_ties(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    t = spark.createDataFrame([(i, "abc", "en" if i in ids else "fr") for i in range(60)], "doc_id bigint, text string, lang string")
    assert langid.fit(t).langs == ["fr"]
    tie = langid.Model.of([("de", "same", 5), ("aa", "same", 5)])
    assert langid.predict(t.selectExpr("doc_id", "'same' as text"), tie).first().lang_pred == "aa"


def test_backoff():
    m = langid.Model.of([("x", "banana", 9), ("y", "kiwi", 9)])
    banana, bananas, kiw, qqq = m.scores(["banana", "bananas", "kiw", "qqq"])
    assert banana.argmax() == 0 and bananas.argmax() == 0 and kiw.argmax() == 1
    assert (qqq == 0).all()


def plain(learned, texts):
    """The method written plainly: (language, score) of each text, from counted (lang, word) pairs."""
    langs = sorted({lang for lang, _ in learned})

    def logs(table):
        sums = [sum(row.values()) for row in (Counter({p: n for (lang, p), n in table.items() if lang == one}) for one in langs)]
        size = len({p for _, p in table})
        return {p: [math.log((table.get((one, p), 0) + 0.1) / (total + 0.1 * size)) for one, total in zip(langs, sums)] for p in {p for _, p in table}}

    cut = lambda w, k: [g for i in range(len(w) + 3 - k) if (g := f"^{w}$"[i : i + k]) not in ("^", "$")]
    words = logs(learned)
    grams = {}
    for k in range(1, 6):
        table = Counter()
        for (lang, w), n in learned.items():
            for g in cut(w, k):
                table[lang, g] += math.log1p(n)
        grams[k] = logs(table)

    def score(w):
        if w in words:
            return words[w]
        for k in range(5, 0, -1):
            found = [grams[k][g] for g in cut(w, k) if g in grams[k]]
            if found:
                return [sum(x) / len(found) for x in zip(*found)]
        return [0.0] * len(langs)

    for text in texts:
        if not text or not any(map(str.isalpha, text)):
            yield "und", 0.0
            continue
        rows = [score(w) for w in re.findall(r"[^\W\d_]+", text.lower())]
        mean = [sum(x) / len(rows) for x in zip(*rows)]
        odds = [math.exp(x - max(mean)) for x in mean]
        yield langs[odds.index(max(odds))], max(odds) / sum(odds)


def test_query_against_the_plain_method(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learned = Counter()
    for r in rows:
        if r.lang and r.text and zlib.crc32(str(r.doc_id).encode()) % 3 != 1:
            learned.update((r.lang, w) for w in re.findall(r"[^\W\d_]+", r.text.lower()))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.op8_language_id(spark, sf).collect()}
    for r, (lang, score) in zip(rows, plain(learned, [r.text for r in rows])):
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-3
