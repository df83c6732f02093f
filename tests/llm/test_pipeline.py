import corpus_pipeline
import pytest
from test_neardup import brute

from quotewright.llm import secrets

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows before and after each stage."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, sf).write.parquet(path)
        new = spark.read.parquet(path)
        out.append((name, docs.collect(), new.collect(), new.columns))
        docs = new
    return out


def test_order_and_columns(stages):
    assert [s[0] for s in stages] == ["language_id", "near_duplicates", "substring_dedup", "secret_scan", "packing"]
    assert all(s[3] == DOCUMENTS for s in stages[:-1])


def test_decisions(spark, stages):
    (_, a, b, _), (_, _, c, _), (_, _, d, _), (_, _, e, _), (_, _, f, _) = stages
    assert len(b) >= 0.95 * len(a)
    keep = {int(i) for i, _, comp in brute([(r.doc_id, r.text) for r in b], 5) if i == comp}
    assert {r.doc_id for r in c} == keep
    assert {r.doc_id for r in d} == keep
    text = {r.doc_id: r.text for r in d}
    ranks = secrets.learn(spark.createDataFrame([(r.text,) for r in d], "text string"))
    assert all(r.text == secrets.redacted(text[r.doc_id], ranks) and r.n_chars == len(r.text) for r in e)
    assert {r.doc_id for r in f} == keep


def test_language_keeps_columns_of_the_same_names(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = {r.doc_id for r in corpus_pipeline.language(spark, docs, sf).collect()}
    mine = docs.selectExpr("doc_id", "7.0D as score", "'mine' as lang_pred", "text", "lang", "source", "n_chars")
    got = corpus_pipeline.language(spark, mine, sf)
    assert got.columns == mine.columns and {(r.doc_id, r.score, r.lang_pred) for r in got.collect()} == {(i, 7.0, "mine") for i in plain}


def test_run_and_empty(spark, sf, stages, tmp_path):
    got = corpus_pipeline.run(spark, sf).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got)) == sorted(map(key, stages[-1][2]))
    empty = str(tmp_path / "e")
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
