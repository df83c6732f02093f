import re
from collections import Counter

from quotewright.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n, places = Counter(grams), set()
    for i, g in enumerate(grams):
        if n[g] > 1:
            places.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def check(df):
    led = quality.apply_policy(quality.ledger(df))
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in led.collect())
    want = Counter()
    for r in df.select("doc_id", "text").collect():
        b = brute(r.text)
        want[(r.doc_id, *b, b[0] < 10 or 100 * b[4] > 20 * b[0])] += 1
    assert got == want


def test_hard_texts(hard, none, spark):
    check(hard)
    check(none)
    check(spark.createDataFrame([(1, "a b c d e a b c d e"), (2, "x\nx\n \n\ny\nx"), (3, "a a a a a a a"), (4, "\x1c\x85 b")], "doc_id bigint, text string"))


def test_whole_table(spark, sf):
    check(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def test_ledger_is_native(spark, sf):
    plan = quality.op2_quality_ledger(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Exchange" not in plan


def test_policies_and_ablation(spark, sf):
    led = quality.ledger(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    rows = led.select("fail_bits").collect()
    mask = quality.policy_mask("v2")
    for r in quality.ablation(led, "v2").collect():
        bit = quality.BIT[r.rule]
        assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
        assert r.n_only == sum((x.fail_bits & mask) == bit for x in rows)
    kept = {p: quality.apply_policy(led, p).where("kept").count() for p in quality.POLICIES}
    assert kept["v2"] <= kept["v1"] <= kept["base"]
    assert quality.ablation(led.limit(0)).agg({"n_failed": "sum"}).first()[0] == 0


def test_clean_documents_stay(spark, sf):
    t = quality.apply_policy(quality.ledger(spark.read.parquet(f"{sf}/documents.parquet"))).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = t.where("quality = 1")
    assert good.where("kept").count() >= 0.95 * good.count()


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "some words here", 2, 3, 4, 5)], "doc_id int, text string, _t int, _w int, _c0 int, n_words int")
    got = quality.ledger(df).first()
    assert (got["_t"], got["_w"], got["_c0"], got["n_words"]) == (2, 3, 4, 3)
