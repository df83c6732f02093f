import random

import numpy as np

from quotewright.llm import passages
from quotewright.llm.common import Scratch, multipliers, word_hashes, words_of


def grams(text, n=50):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def shared(texts):
    """50-word sequences that two documents hold."""
    seen, twice = set(), set()
    for t in texts:
        g = grams(t)
        twice |= seen & g
        seen |= g
    return twice


def words(rnd, n):
    return [f"w{rnd.randrange(10**6)}" for _ in range(n)]


def test_passages_are_found_wherever_they_stand(spark):
    rnd = random.Random(1)
    passage = words(rnd, 60)
    rows = []
    for i in range(40):
        w = words(rnd, rnd.randrange(80, 200))
        at = rnd.randrange(len(w))
        rows.append((i + 1, " ".join(w[:at] + (passage if i < 25 else []) + w[at:])))
    rows.append((90, rows[30][1]))  # an exact copy
    rows.append((91, " ".join(["loop a b c d e f"] * 60)))  # repeats within one document only
    rows.append((92, " ".join(words(rnd, 30) + passage[:40] + words(rnd, 30))))  # too short a piece
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, removed string")
    assert passages.dedup(df, Scratch(spark), removed=None).columns == df.columns
    done = {r.doc_id: r for r in passages.dedup(df, Scratch(spark)).collect()}
    assert not shared(r.text for r in done.values())
    for i, text in rows:
        if 2 <= i <= 25:
            assert done[i].text.split() == [w for w in text.split() if w not in passage]
            assert [x.src_doc for x in done[i].removed] == [1]
        elif i == 90:
            assert done[i].text == ""
        else:
            assert done[i].text == text and not done[i].removed


def test_hard_documents(spark, hard, none):
    done = passages.dedup(hard, Scratch(spark))
    assert sorted(map(str, done.select("doc_id", "text").collect())) == sorted(map(str, hard.select("doc_id", "text").collect()))
    assert passages.dedup(none, Scratch(spark)).count() == 0


def test_repeated_ids_stay_unchanged(spark):
    rnd = random.Random(2)
    p = " ".join(words(rnd, 80))
    df = spark.createDataFrame([(1, p), (2, p), (2, "other text"), (3, p)], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in passages.dedup(df, Scratch(spark)).collect()) == [(1, p), (2, "other text"), (2, p), (3, "")]


def test_anchors_against_brute_force():
    rnd = np.random.default_rng(0)
    for n in (0, 27, 28, 29, 60, 500):
        s = rnd.integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)
        want = set()
        for t in range(n - passages.GAP + 1):
            high = s[t : t + passages.GAP] >> np.uint64(24)
            want.add(t + passages.GAP - 1 - int(high[::-1].argmin()))
        assert passages.anchors(s).tolist() == sorted(x for x in want if x <= n - 16)


def test_every_50_words_hold_a_whole_paragraph():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        s = rnd.integers(0, 2**63, 46, dtype=np.uint64)
        assert len(passages.anchors(s))


def test_edited_paragraphs(spark):
    """Copies of lines with words changed, inserted or left out go whole where the similarity is 0.8 or more, and only there."""
    rnd = random.Random(8)
    shingled = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, near, far = [], {}, set()
    for i in range(100):
        p = words(rnd, rnd.randrange(60, 130))
        q = list(p)
        for _ in range(rnd.choice((1, 2, 2, 3, 6))):
            at = rnd.randrange(len(q))
            rnd.choice((lambda: q.__setitem__(at, "changed"), lambda: q.insert(at, "more"), lambda: q.pop(at)))()
        a, b = shingled(p), shingled(q)
        own = " ".join(words(rnd, 30))
        rows += [(i, " ".join(p)), (500 + i, f"{own}\n" + " ".join(q))]
        if 100 * len(a & b) >= 80 * len(a | b) and len(q) >= 50:
            near[500 + i] = own + "\n"
        else:
            far.add(500 + i)
    assert len(near) > 25 and len(far) > 5
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    done = {r.doc_id: r.text for r in passages.dedup(df, Scratch(spark)).collect()}
    assert sum(done[i] == t for i, t in near.items()) >= 0.95 * len(near)
    assert all((w in done[i].split()) == (w in t.split()) for i, t in rows if i in far for w in ("changed", "more"))
    assert all(done[i] == t for i, t in rows if i < 500)


def test_bands_recall_at_the_threshold():
    """Pairs of paragraphs at a similarity of 0.8."""
    by, hit, rnd = multipliers(passages.BANDS * passages.ROWS, passages.SEED), 0, np.random.default_rng(2)
    n = 1000
    for _ in range(n):
        x = rnd.integers(0, 2**63, 100, dtype=np.uint64)
        rnd.shuffle(x[10:90])
        spans = np.array([[0, 90 + 4]])
        hit += bool(set(passages.band_keys(x[:90], spans, by)[0].tolist()) & set(passages.band_keys(x[10:], spans, by)[0].tolist()))
    assert hit / n > 0.98


def test_query(spark, sf):
    rows = passages.op4_repeated_passages(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs) and not shared(r.text for r in rows)
    flagged = {r.doc_id for r in rows if r.removed_words}
    for r in rows:
        assert (r.text == docs[r.doc_id]) == (r.doc_id not in flagged)
        assert r.component_id <= r.doc_id and (r.n_links > 0) == (r.doc_id in flagged)


def test_words_between_quotes_stay(spark):
    """Two 25-word quotes of one document with 20 own words between, on the same diagonal: no 50 words are shared."""
    rnd = random.Random(3)
    rows = []
    for i in range(20):
        p, q = words(rnd, 25), words(rnd, 25)
        rows += [(i, " ".join(words(rnd, 40) + p + words(rnd, 20) + q + words(rnd, 40))), (100 + i, " ".join(words(rnd, 60) + p + words(rnd, 20) + q + words(rnd, 30)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.text) for r in passages.dedup(df, Scratch(spark)).collect()) == sorted(rows)


def test_first_holder_has_only_a_part(spark):
    rnd = random.Random(4)
    rows, whole = [], {}
    for i in range(40):
        p = words(rnd, 55)
        part = p[5:50] if i % 2 else [*p[:4], "x", *p[5:50]]
        rows.append((i, " ".join(words(rnd, 30) + part + words(rnd, 30))))
        for k in (100, 200):
            own = words(rnd, 30), words(rnd, 30)
            rows.append((k + i, " ".join(own[0] + p + own[1])))
            whole[k + i] = " ".join(own[0] + own[1])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    done = {r.doc_id: r for r in passages.dedup(df, Scratch(spark)).collect()}
    assert not shared(r.text for r in done.values())
    for i, text in rows:
        assert done[i].text == (whole[i] if i >= 200 else text)
        assert [x.src_doc for x in done[i].removed] == ([i - 100] if i >= 200 else [])


def test_every_source_of_a_span_is_a_link(spark, tmp_path):
    rnd = random.Random(6)
    p, q = words(rnd, 60), words(rnd, 60)
    rows = [(1, " ".join(p + words(rnd, 20))), (5, " ".join(q + words(rnd, 20))), (9, " ".join(words(rnd, 20) + p + q)), (7, "alone")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.component_id, r.n_links, r.n_linked, r.removed_words) for r in passages.op4_repeated_passages(spark, str(tmp_path)).collect()}
    assert got == {1: (1, 0, 1, 0), 5: (1, 0, 1, 0), 9: (1, 2, 2, 120), 7: (7, 0, 0, 0)}


def edited(rnd, w, every):
    """w with a word changed about every so many."""
    w = list(w)
    for at in range(rnd.randrange(every), len(w), every):
        w[at] = f"x{rnd.randrange(10**6)}"
    return w


def in_lines(w, n):
    return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))


def test_shifted_lines(spark):
    """Copies of texts of short lines with an edit every 46 words go, whatever number of own lines stands before them."""
    rnd = random.Random(9)
    rows, size = [], {}
    for i in range(40):
        p, lines = words(rnd, 240), (12, 9, 17, 25)[i % 4]
        own = in_lines(words(rnd, 12 * (i % 3)), 12)
        size[1000 + i] = 12 * (i % 3)
        rows += [(i, in_lines(p, lines)), (1000 + i, own + "\n" + in_lines(edited(rnd, p, 46), lines))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    done = {r.doc_id: r for r in passages.dedup(df, Scratch(spark)).collect()}
    gone = {n: sum(x.b - max(x.a, size[1000 + i]) for i in range(n, 40, 3) for x in done[1000 + i].removed) for n in range(3)}
    assert all(gone[n] >= 0.9 * 240 * len(range(n, 40, 3)) for n in range(3)), gone
    assert all(done[i].text == t for i, t in rows if i < 1000)


def test_runs_of_one_text_are_never_near_each_other():
    rnd = random.Random(10)
    for longest in (2, 4, 9, 20, 49):
        for _ in range(20):
            text = "\n".join(" ".join(words(rnd, rnd.randrange(longest + 1))) for _ in range(rnd.randrange(1, 900 // longest))).encode()
            h = word_hashes(words_of(text))
            runs = passages.lines_of(text, h, 50).tolist()
            assert (runs and (runs[0][0], max(d for _, d in runs)) == (0, len(h))) or (not runs and len(h) < 50)
            for (a, b), (c, d) in zip(runs, runs[1:]):
                assert a <= c <= b and min(b - a, d - c) >= 50
                if a < c and b < d and a > 0 and d < len(h):  # not the two that hold the first and the last lines
                    both = max(0, b - c - 4)
                    assert 100 * both < 80 * (b - a - 4 + d - c - 4 - both)
    assert len(passages.lines_of(b"la la\n" * 100, word_hashes([b"la"] * 200), 50)) > 5  # equal lines, too


def plainly(docs):
    """What the query returns, by all pairs of paragraphs and all sequences of 50 words: {doc_id: (component_id, n_links, n_linked, removed_words, spans)}."""
    split = {i: (t or "").lower().split() for i, t in docs.items()}
    first, copies, paragraphs = {}, {}, []
    for i in sorted(docs):
        w = split[i]
        if len(w) >= 50 and first.setdefault(tuple(w), i) != i:
            copies[i] = first[tuple(w)]
        raw = (docs[i] or "").encode()
        paragraphs += [(i, a, b) for a, b in passages.lines_of(raw, word_hashes(words_of(raw)), 50).tolist()]
    sets = [{tuple(split[i][x : x + 5]) for x in range(a, b - 4)} for i, a, b in paragraphs]
    top = list(range(len(sets)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for x, p in enumerate(sets):
        for y in range(x):
            if 100 * len(p & sets[y]) >= 80 * len(p | sets[y]):
                top[max(root(x), root(y))] = min(root(x), root(y))
    source = {}
    for x, (i, _, _) in enumerate(paragraphs):
        source[root(x)] = min(i, source.get(root(x), i))
    spans = {i: [(0, len(split[i]), src)] for i, src in copies.items()}
    gone = {}
    for x, (i, a, b) in enumerate(paragraphs):
        if source[root(x)] != i:
            gone.setdefault(i, []).append((a, b, source[root(x)]))
    near = len(gone)
    holders, places = {}, []
    for i, w in split.items():
        if i not in copies:
            for a in range(len(w) - 49):
                if all(a + 50 <= x or a >= y for x, y, _ in gone.get(i, ())):
                    places.append((i, a, tuple(w[a : a + 50])))
                    holders[places[-1][2]] = min(i, holders.get(places[-1][2], i))
    for i, found in gone.items():
        spans.setdefault(i, []).extend(found)
    for i, a, key in places:
        if holders[key] != i:
            spans.setdefault(i, []).append((a, a + 50, holders[key]))
    merged = {i: passages.merged_spans(x) for i, x in spans.items()}
    edges = {(i, src) for i, x in merged.items() for _, _, docs in x for src in docs}
    comp = {i: i for i in docs}
    for _ in docs:
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    out = {}
    for i in docs:
        mine = merged.get(i, [])
        linked = len({e for e in edges if e[0] == i}) + len({e for e in edges if e[1] == i})
        out[i] = (comp[i], len({e for e in edges if e[0] == i}), linked, sum(b - a for a, b, _ in mine), ",".join(f"{a}:{b}:{src[0]}" for a, b, src in mine))
    return out, near


def test_query_against_all_pairs(spark, tmp_path):
    rnd = random.Random(11)
    docs, pool = {}, [in_lines(words(rnd, rnd.randrange(60, 160)), rnd.choice((9, 14, 30, 500))) for _ in range(25)]
    for i in range(120):
        parts = []
        for _ in range(rnd.randrange(1, 5)):
            kind = rnd.random()
            p = rnd.choice(pool)
            if kind < 0.3:
                parts.append(in_lines(words(rnd, rnd.randrange(5, 120)), rnd.choice((7, 20, 500))))
            elif kind < 0.55:
                parts.append(p)
            elif kind < 0.8:
                lines = p.split("\n")
                at = rnd.randrange(len(lines))
                parts.append("\n".join([*lines[:at], " ".join(edited(rnd, lines[at].split(), 200)), *lines[at + 1 :]]))
            else:
                parts.append(" ".join(words(rnd, 20) + p.split()[:55] + words(rnd, 20)))
        docs[i] = rnd.choice("\n ").join(parts)
    docs |= {200: docs[3], 201: docs[3].upper(), 202: None, 203: "", 204: "too short"}
    spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.component_id, r.n_links, r.n_linked, r.removed_words, r.removed_spans) for r in passages.op4_repeated_passages(spark, str(tmp_path)).collect()}
    want, near = plainly(docs)
    assert near > 30 and got == want
