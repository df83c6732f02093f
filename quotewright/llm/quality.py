"""Quality rules as a bitmask ledger, in SQL functions only.

``ledger`` evaluates every rule once per document and stores measurements and failure bits; ``apply_policy`` reads
a versioned set of rules off the bits without touching a text again; ``ablation`` counts, by bitwise aggregation, what
each rule of a policy removes and what it alone removes.

Cases. Null text: no words, all counts 0. Empty and white-space texts: the same. Very long texts: a few arrays as long
as the text has words, in one row. Ties and repeated rows: each row is judged alone. Empty table: no rows. Other
columns are kept as they are unless ``ledger``'s own names clash with them; then the ledger's win.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

_SEP = "[\\x20\\x09-\\x0D]+"

#: (rule, its failure as SQL over the measurements). The place in the list is the bit; rules are only ever appended.
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_5grams", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("upper_case", "10 * n_upper > 5 * word_chars"),
    ("long_words", "100 * n_long_words > 10 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versions of the policy; a document is kept if it fails none of the version's rules.
POLICIES = {
    "base": ["few_words", "repeated_5grams"],
    "v1": ["few_words", "repeated_5grams", "symbols", "repeated_lines", "word_length"],
    "v2": ["few_words", "repeated_5grams", "symbols", "repeated_lines", "word_length", "upper_case", "long_words"],
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_long_words"]


def policy_mask(policy: str) -> int:
    return sum(BIT[r] for r in POLICIES[policy])


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text column, with MEASURES (long) and fail_bits (long).

    n_repeat_words: words in 5-word windows that occur twice or more in the text. The windows' 64-bit hashes are
    sorted beside their places; equal neighbours are repeated windows, and their sorted places are merged.
    """
    others = [c for c in docs.columns if c not in (text, "fail_bits", *MEASURES)]
    docs = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(others)], F.col(text).alias("_text"))  # by place, so that no name can clash
    rest = [f"_c{i}" for i in range(len(others))]
    t = F.coalesce(F.col("_text"), F.lit(""))
    bare = F.trim(t, F.lit(SPACES))
    df = docs.select(*[F.col(c) for c in rest], t.alias("_t"), F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _SEP)).alias("_w"))
    w = F.col("_w")
    hashes = F.when(F.size(w) < 6, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.struct(F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(5)]).alias("h"), i.alias("i")))
    )
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    df = df.select(*rest, "_t", "_w", F.array_sort(hashes).alias("_h"), lines.alias("_l"))
    h = F.col("_h")
    n = F.size(h)
    # places (from 1) in _h whose hash equals a neighbour's
    again = F.filter(h, lambda x, i: (x["h"] == F.get(h, i - 1)["h"]) | (x["h"] == F.get(h, i + 1)["h"]))
    again = F.when(n < 2, F.array().cast("array<int>")).otherwise(F.transform(again, lambda x: x["i"]))
    df = df.select(*rest, "_t", "_w", "_l", F.array_sort(again).alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    long_ = lambda c: c.cast("bigint")
    df = df.select(
        *rest,
        long_(F.size("_w")).alias("n_words"),
        long_(F.char_length(F.regexp_replace("_t", _SEP, ""))).alias("word_chars"),
        long_(F.char_length("_t") - F.char_length(reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), "#*$%&|<>", F.col("_t")))).alias("n_symbols"),
        long_(F.size("_l")).alias("n_lines"),
        long_(F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        long_(F.char_length("_t") - F.char_length(F.regexp_replace("_t", "[A-Z]+", ""))).alias("n_upper"),
        long_(F.size(F.filter("_w", lambda x: F.char_length(x) > 40))).alias("n_long_words"),
    )
    bits = [F.when(F.expr(cond), F.lit(1 << i).cast("bigint")).otherwise(F.lit(0).cast("bigint")) for i, (_, cond) in enumerate(RULES)]
    return df.select(*[F.col(r).alias(c) for r, c in zip(rest, others)], *MEASURES, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fail_bits"))


def apply_policy(led: DataFrame, policy: str = "v2") -> DataFrame:
    """led with base_failed and kept."""
    fails = lambda m: F.col("fail_bits").bitwiseAND(F.lit(m).cast("bigint")) != 0
    return led.withColumn("base_failed", fails(policy_mask("base"))).withColumn("kept", ~F.col("base_failed") & ~fails(policy_mask(policy)))


def ablation(led: DataFrame, policy: str = "v2") -> DataFrame:
    """One row per rule of the policy: rule, n_failed, n_only (documents that dropping just this rule would bring back)."""
    mask = policy_mask(policy)
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("bits")).agg(F.count("*").alias("n"))
    rules = POLICIES[policy]
    one = patterns.agg(*[F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(BIT[r]).cast("bigint")) != 0, F.col("n"))), F.lit(0)).alias(f"f{i}") for i, r in enumerate(rules)], *[F.coalesce(F.sum(F.when(F.col("bits") == BIT[r], F.col("n"))), F.lit(0)).alias(f"o{i}") for i, r in enumerate(rules)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f{i}").alias("n_failed"), F.col(f"o{i}").alias("n_only")) for i, r in enumerate(rules)])).alias("r")).select("r.*")


def op2_quality_ledger(spark, sf_dir):
    led = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return apply_policy(led).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "n_lines", "n_upper", "n_long_words")


_failed = lambda names: " OR ".join(f"({cond})" for name, cond in RULES if name in names)
ORACLE = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
windows AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 6),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i : i + 4]) AS c FROM windows),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again WHERE c > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
    length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS n_upper, len(list_filter(w, lambda x: length(x) > 40)) AS n_long_words
  FROM w LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({_failed(POLICIES["base"])}) AS base_failed, NOT ({_failed(POLICIES["v2"])}) AS kept,
  CAST({" + ".join(f"(CASE WHEN {cond} THEN {1 << i} ELSE 0 END)" for i, (_, cond) in enumerate(RULES))} AS BIGINT) AS fail_bits, n_lines, n_upper, n_long_words FROM m
"""
