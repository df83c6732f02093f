"""Secret scans: fixed patterns, and password guess costs of values in a credential context.

The base patterns give spans of kinds assign, access and hex. Kind guess is added for values after credential-like names
whose guess cost, found by dynamic programming, is GUESS_BITS or more: the cheapest way to cut the value into known
words, dates, repeats, keyboard walks and brute-force spans, in bits. Words are ranked by their frequency in all texts, without
the values of credential-like names, which would else be cheap for being known. Names are taken by whole parts. The programme
keeps one open span of each sort, so it is linear in the value's length.

Cases. Null and empty texts: no spans. Very long texts and values: whole, linear. Overlapping kinds: all kept; guess spans
inside an assign span are not repeated. Repeated rows: each scanned. Empty table: no rows. Offsets are code points, the
end is exclusive. Extra columns stay unless named spans.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, append

KINDS = ("assign", "access", "hex", "guess")
GUESS_BITS = 36.0
MARK = "[SECRET]"

_any = lambda s: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in s)
_assign = re.compile("(" + "|".join(map(_any, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_access = re.compile("AKIA[A-Z0-9]+")
_hex = re.compile("[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ of which the short are dropped
_names = ("pass", "pwd", "secret", "token", "key", "credential", "auth")
_parts = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")  # of an identifier: between signs, digits and changes of case
#: Parts that name a credential, pairs of parts that do, and words that do at the end of a part.
_credential = {"pass", "pwd", "password", "passwd", "passphrase", "passcode", "secret", "secrets", "token", "tokens", "credential", "credentials", "auth", "authorization"}
_keys = {"api", "private", "access", "secret"}
_endings = ("password", "passwd", "passphrase", "secret", "token", "apikey", "credential", "credentials")
# a whole identifier, a sign and a value; possessive, so that every character is read a bounded number of times
_context = re.compile(r"""(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)["']?+\x20*+(?:=>|:=|[:=])\x20*+["']?+(?:(?:[Bb]earer|[Bb]asic)\x20++)?+([^\s"'`,;<>(){}\[\]]++)""")


def credential(name: str) -> bool:
    """Whether an identifier names a credential by one of its whole parts: author, compass and passenger_id do not."""
    parts = [p.lower() for p in _parts.findall(name)]
    return any(p in _credential or p.endswith(_endings) for p in parts) or any(a in _keys and b in ("key", "keys") for a, b in zip(parts, parts[1:]))


def prose(text: str) -> str:
    """The text without the values of credential-like names, so that no secret is learned as a word."""
    if not any(w in text.lower() for w in _names):
        return text
    out, at = [], 0
    for m in _context.finditer(text):
        if credential(m[1]):
            out.append(text[at : m.start(2)])
            at = m.end(2)
    return "".join([*out, text[at:]])

#: The words that learn() ranks, and their lengths.
DICTIONARY, SHORTEST, LONGEST = 1 << 16, 3, 24
#: Frequent passwords, most frequent first; the rank is the guess count. Words of the corpus come after them.
WORDS = (
    "password passwd qwerty admin welcome letmein login dragon monkey master sunshine princess football baseball shadow superman "
    "iloveyou trustno hello freedom whatever secret secrets test testing guest root user default changeme example sample demo "
    "token key apikey none null true false string value your here placeholder redacted hidden private public server service "
    "database summer winter spring autumn monday friday love money house family flower orange banana coffee"
).split()
#: Words of four languages; letters that follow each other in one of them are cheap to guess.
COMMON = (
    "the and that have with this from they would there their what about which when make like time just know take people into year good some could them other than then look only come over think also back after work first well even want because these give most "
    "correct horse battery staple between through under different important government business question example knowledge available information management development account customer address number change public system program service standard special question "
    "provide support process create remove update delete enable disable option setting value object window button field table column message error warning subject language country market price product quality original beautiful yesterday tomorrow morning evening "
    "der die und den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei schon zwischen unter können "
    "geschichte gesellschaft entwicklung wissenschaft schlüssel kennwort benutzer verwaltung zukunft freundschaft arbeit möglich natürlich wichtig sprache deutsch jahr zeit mensch leben "
    "les des une est que pour dans qui par sur pas plus avec tout faire son mettre autre nous comme mais pouvoir même vous aussi bien sans être deux temps très savoir falloir voir quelque jour homme monde petit premier toujours histoire question langue travail moyen jeune ville chose "
    "los las una por con para como más pero sus este entre cuando muy sin sobre también hasta hay donde quien desde todo nos durante todos uno les contra otros ese eso había ante ellos esto antes algunos qué unos otro otras otra tanto esa estos mucho trabajo tiempo mundo gobierno ciudad lenguaje pueblo siempre"
).split()
_pairs = {a + b for w in (*COMMON, *WORDS) for a, b in zip(w, w[1:])}
PROSE = 2.0
_rank = {w: i + 1 for i, w in enumerate(WORDS)}
_rows = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_place = {c: (r, i + (0, 0.5, 0.75, 1.25)[r]) for r, row in enumerate(_rows) for i, c in enumerate(row)}
_date = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_leet = str.maketrans("@4310$5!", "aaeiossi")
SEGMENT, WALK, STEP, REPEAT, AGAIN, PERIODS = 1.0, math.log2(47), 2.0, 3.0, 0.05, 8


def _near(a: str, b: str) -> bool:
    p, q = _place.get(a), _place.get(b)
    return bool(p and q and p != q and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1)


def _bits(value: str) -> list[float]:
    """Brute-force bits of each character; in text of letters alone, those that follow as in prose are cheap."""
    if value.isalpha():
        out = []
        for a, b in zip(" " + value, value):
            turn = a.islower() and b.isupper()
            out.append(PROSE if not b.isascii() or not turn and (a + b).lower() in _pairs else math.log2(26) + turn)
        return out
    return [math.log2(10) if c.isdigit() else math.log2(26) if c.isalpha() and c.isascii() else math.log2(33) for c in value]


def guess_bits(value: str, ranks: dict[str, int] = _rank) -> float:
    """Bits of the cheapest segmentation of value. ranks: of lower-case words."""
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    if len(low) != n:
        low = value
    plain, bits, inf = low.translate(_leet), _bits(value), math.inf
    best = [0.0] + [inf] * n
    ends: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        m = _date.match(value, i)
        if m:
            ends.setdefault(m.end(), []).append((i, math.log2(120) + (math.log2(365) if len(m[0]) > 4 else 0)))
        for k in range(SHORTEST, min(LONGEST, n - i) + 1):
            for form, more in ((low, 0.0), (plain, 1.0)):
                r = ranks.get(form[i : i + k])
                if r:
                    ends.setdefault(i + k, []).append((i, math.log2(r + 1) + more + (low[i : i + k] != value[i : i + k])))
                    break
    brute = walk = inf
    again = [inf] * (PERIODS + 1)
    for i in range(n):  # the character i ends at i + 1
        brute = min(best[i] + SEGMENT, brute) + bits[i]
        walk = min(walk, best[i - 1] + SEGMENT + WALK) + STEP if i and _near(low[i - 1], low[i]) else inf
        now = min(brute, walk)
        for p in range(1, min(PERIODS, i) + 1):
            if value[i] == value[i - p]:
                again[p] = min(again[p], best[i] + SEGMENT + REPEAT) + AGAIN
                now = min(now, again[p])
            else:
                again[p] = inf
        for at, cost in ends.get(i + 1, ()):
            now = min(now, best[at] + SEGMENT + cost)
        best[i + 1] = now
    return best[n]


def find(text: str | None, ranks: dict[str, int] = _rank) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as in KINDS."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in _names):
        found = [("assign", m.start(), m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
        taken = [s[1:] for s in found]
        k = 0
        for m in _context.finditer(text):
            if not credential(m[1]):
                continue
            a, b = m.span(2)
            while k < len(taken) and taken[k][1] <= a:
                k += 1
            if not (k < len(taken) and taken[k][0] <= a and b <= taken[k][1]) and guess_bits(m[2], ranks) >= GUESS_BITS:
                found.append(("guess", a, b))
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in _hex.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def redacted(text: str | None, ranks: dict[str, int] = _rank) -> str | None:
    """The text with every span, overlapping ones merged, replaced by MARK."""
    spans = find(text, ranks)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += (text[at:a], MARK)
        at = max(at, b)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def learn(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> dict[str, int]:
    """Ranks of words: the frequent passwords, then the size most frequent words of all texts, of SHORTEST to LONGEST ASCII letters.

    A word beyond the size would cost more than 16 bits, about as much as its letters by brute force.
    """
    ends = ".,;:!?()[]{}<>\"'`*_-"

    def count(batches):
        import pyarrow as pa

        def words(found):
            by = Counter()
            for w, n in found.items():
                w = w.strip(ends)
                if SHORTEST <= len(w) <= LONGEST and w.isascii() and w.isalpha():
                    by[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array(list(by.values()), pa.int64())], ["word", "n"])

        found: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                found.update(prose(x).lower().split())
                if len(found) > 200_000:
                    yield words(found)
                    found = Counter()
        yield words(found)

    counts = docs.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    scratch = Scratch(docs.sparkSession)
    counts = scratch.cut(counts.withColumn("bucket", F.floor(F.log2("n") * 8).cast("int")), "counts")
    # the bucket of frequencies in which the size-th word lies; only its words need to be sorted, those above it all count
    left, least = size, -1
    for bucket, n in sorted(map(tuple, counts.groupBy("bucket").agg(F.count("*")).collect()), reverse=True):  # at most 8 * 64 rows
        if n >= left:
            least = bucket
            break
        left -= n
    frequent = [*counts.where(F.col("bucket") > least).select("word", "n").collect(), *counts.where(F.col("bucket") == least).orderBy(F.desc("n"), "word").limit(left).select("word", "n").collect()]  # size words at most
    scratch.drop("counts")
    frequent = [w for w, _ in sorted(frequent, key=lambda r: (-r[1], r[0]))]
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *frequent]))}


def scan(docs: DataFrame, text: str = "text", ranks: dict[str, int] | None = None) -> DataFrame:
    """docs with spans: array of (kind, start, end). ranks: learned from docs unless given."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks or learn(docs, text))  # DICTIONARY words

    def make():
        import pyarrow as pa

        ranks = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return lambda texts: [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find(x, ranks)] for x in texts], kind)]

    return append(docs, text, make, f"spans {SPANS}")


def redact(docs: DataFrame, text: str = "text", ranks: dict[str, int] | None = None) -> DataFrame:
    """docs whose text has every secret replaced by MARK; columns and their order stay. ranks: learned from docs unless given."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks or learn(docs, text))  # DICTIONARY words

    def make():
        import pyarrow as pa

        ranks = shared.value
        return lambda texts: [pa.array([redacted(x, ranks) for x in texts], pa.string())]

    own = [f"_c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index(text)
    done = append(docs.toDF(*own), own[at], make, "_text string")
    return done.select(*[F.col("_text" if i == at else c).alias(docs.columns[i]) for i, c in enumerate(own)])


def digest(spans: str = "spans") -> list:
    """The counts, the hash of the base spans and all spans as text."""
    s = F.col(spans)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return [count("assign"), count("access"), count("hex"), F.sha2(joined(F.filter(s, lambda x: x["kind"] != "guess")), 256).alias("base_sha256"), joined(s).alias("spans"), count("guess")]


def op10_secret_spans(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs.select("doc_id", "text")).select("doc_id", *digest())
