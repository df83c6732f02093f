"""The training-data pipeline: language ID, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotewright.deploy import ship
from quotewright.llm import langid, neardup, packing, passages, secrets
from quotewright.llm.common import Scratch

ORACLE_SQL = None  # no SQL for models, MinHash and tokenizers; tests compare each stage with a brute-force version

#: A document is rejected if it has no letter or its words speak for no language: the mean per-word odds are below this.
MIN_LANGUAGE_SCORE = 0.4


def _columns(docs: DataFrame, df: DataFrame) -> DataFrame:
    return df.select(*docs.columns)


def _rewritten(docs: DataFrame, df: DataFrame) -> DataFrame:
    """df with docs' columns, n_chars following the new text."""
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        df = df.withColumn("n_chars", F.char_length("text").cast(kind))
    return _columns(docs, df)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told. The model learns from the stage's own labelled rows."""
    ship(spark)
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}  # by place, so that columns named lang_pred or score stay as they are
    judged = langid.predict(docs.toDF(*own.values()), langid.fit(docs), own["text"])
    kept = judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE))
    return kept.select(*[F.col(x).alias(c) for c, x in own.items()])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near copies, by five-word shingles and a similarity of 0.8 or more."""
    ship(spark)
    found = neardup.classes(docs.select("doc_id", "text"), Scratch(spark), k=5)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return _columns(docs, docs.join(gone, "doc_id", "left_anti"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words or more that another document holds, and lines of 50 words or more that are near one of another
    document; the smallest doc_id keeps them. Documents stay, even emptied."""
    ship(spark)
    return _rewritten(docs, passages.dedup(docs, Scratch(spark), removed=None))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark."""
    ship(spark)
    return _rewritten(docs, secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 1024."""
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"), Scratch(spark))


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("substring_dedup", substrings), ("secret_scan", secret_scan), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written and read again before the next."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.cut(stage(spark, docs, sf_dir), f"stage-{i}-{name}")
        if i:
            scratch.drop(f"stage-{i - 1}-{STAGES[i - 1][0]}")
    return docs
