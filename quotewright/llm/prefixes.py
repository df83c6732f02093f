"""Conversation prefix trie: which prefixes conversations share, and what sharing them saves.

A conversation's turns are numbered and hashed; a NumPy scan gives the polynomial fingerprint of each of its prefixes (turn
hashes t, odd base B: F(d) = B * F(d - 1) + t(d), modulo 2**64, as a cumulative sum of t(i) * B**-i times B**d). Prefixes of
one depth and fingerprint are a candidate node. Each candidate is verified turn by turn: every member must have the last turn
of its representative (the smallest conv_id), and come from the same node one turn up. Where that holds everywhere, members
are equal throughout, by induction. Members that fail leave: from the turn at which they differ, their fingerprints are moved
by a hash of that turn, and the verification is repeated until nothing moves.

Rollup to parents in sums of members rather than level by level: a node belongs to its smallest member, whose own nodes are
those from some depth on. Every node and leaf below a node is then counted once, at its owner, and the rollup of a whole
subtree is one sum over the node's members, whatever the depth of the trie.

Scale: all texts are shuffled once for turns and once for verification; the rest are rows of numbers a turn. Verification
compares with a representative for each of SALTS groups of members, and these with one another: a first turn that all
conversations share is dealt over SALTS tasks. Sums are combined before the shuffle. Digests of members that end at a node
are made from chunks of at most CHUNK ids in order; a task holds one chunk and a hash state. One conversation is numbered in
one task that streams it, with a batch in memory.

Cases. Null role or text: empty. Null turn: first. Equal turns and repeated rows: all count, by role, then text. Null conv_id:
no conversation, left out. Empty table: no rows. A conversation without turns is a member of the root. Words are runs without
white space. Columns but conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SALTS, CHUNK = 64, 4096
BLOCK, HEADS = 20, 4  # conversations c - c % BLOCK lend up to HEADS - 1 first turns to those of their block
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
TURNS = "conv_id bigint, depth bigint, role string, text string"


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), role and text in order; a row of depth 0 before each conversation's turns."""
    return _dealt(conversations, F.col("conv_id")).mapInArrow(_turns(0), TURNS)


def _dealt(conversations: DataFrame, block) -> DataFrame:
    """Turns in order: block after block, the lender of a block first."""
    c = conversations.where("conv_id is not null").select(block.alias("block"), "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.repartition("block").sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", F.asc_nulls_first("turn"), "role", "text")
    return c.select("block", "conv_id", "role", "text")


def heads(conv: int) -> int:
    """How many first turns a conversation takes from that of its block."""
    return zlib.crc32(str(conv).encode()) % HEADS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Like ordered(), with the first turns of conversation c - c % BLOCK (as many as heads(c) says) in place of c's own first ones."""
    return _dealt(conversations, F.col("conv_id") - F.col("conv_id") % BLOCK).mapInArrow(_turns(HEADS - 1), TURNS)


def _turns(most: int):
    """Numbers turns; conversations other than their block's lender begin with its first ones, most at most. Holds a batch and those."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        block, lent, now, depth, skip = None, [], None, 0, 0
        for batch in batches:
            rows = []
            for b, c, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if b != block:
                    block, lent = b, []
                if c != now:
                    now, skip = c, heads(c) if most and c != b else 0
                    rows.append((c, 0, None, None))
                    rows += [(c, i + 1, *turn) for i, turn in enumerate(lent[:skip])]
                    depth = min(skip, len(lent))
                if c == b and len(lent) < most:
                    lent.append((role, text))
                if skip:
                    skip -= 1
                else:
                    depth += 1
                    rows.append((c, depth, role, text))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["conv_id", "depth", "role", "text"])

    return run


def powers(base: int, first: int, n: int) -> np.ndarray:
    """base ** (first, ..., first + n - 1) modulo 2**64."""
    x = np.full(n, base, np.uint64)
    x[0] = pow(base, first, 1 << 64)
    return np.multiply.accumulate(x)


def _scan(bits: int):
    """Adds words, fp and parent_fp; rows of a conversation are together, in order of depth. Only the lowest bits of a fingerprint are kept (all but in tests)."""
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        last = np.uint64(0)  # the open conversation's fingerprint, all bits
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            depth = batch.column(1).to_numpy()
            turns = np.zeros(n, np.uint64)
            words = np.zeros(n, np.int64)
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i in np.flatnonzero(depth):
                role, text = roles[i].encode(), texts[i].encode()
                turns[i] = xxhash.xxh64_intdigest(b"%d:%b%b" % (len(role), role, text))
                words[i] = len(text.split())
            starts = np.unique(np.append(0, np.flatnonzero(depth == 0)))
            lengths = np.diff(np.append(starts, n))
            place = np.arange(n) - np.repeat(starts, lengths)  # in its run: the exponent
            up, down = powers(BASE, 0, lengths.max() + 1), powers(_INVERSE, 0, lengths.max() + 1)
            total = np.cumsum(turns * down[place])
            before = np.append(np.uint64(0), total)[starts]
            fp = (total - np.repeat(before, lengths)) * up[place]
            if depth[0]:  # goes on from the batch before
                fp[: lengths[0]] += last * up[place[: lengths[0]] + 1]
            parent = np.append(last, fp[:-1])
            last = fp[-1]
            parent[depth == 0] = 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(words), pa.array((fp & mask).view(np.int64)), pa.array((parent & mask).view(np.int64))], [*batch.schema.names, "words", "fp", "parent_fp"]
            )

    return run


def fingerprints(turns: DataFrame, bits: int = 64) -> DataFrame:
    return turns.mapInArrow(_scan(bits), TURNS + ", words bigint, fp bigint, parent_fp bigint")


KEY = ["depth", "fp"]


def _differs(over=None):
    """Whether a row's last turn or parent is not that of its representative: the first of a window, or columns rep_*."""
    rep = lambda c: F.first(c).over(over) if over is not None else F.col(f"rep_{c}")
    return (F.col("parent_fp") != rep("parent_fp")) | (F.col("role") != rep("role")) | (F.col("text") != rep("text"))


def disagreements(rows: DataFrame) -> DataFrame:
    """The candidate nodes (depth, fp) with members that differ: from the representative of their salt, or this from that of all."""
    salted = rows.where("depth > 0").withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)))
    near, every = Window.partitionBy(*KEY, "salt").orderBy("conv_id"), Window.partitionBy(*KEY).orderBy("conv_id")
    local = salted.withColumns({"first": F.row_number().over(near) == 1, "off": _differs(near)}).where("first or off")
    return local.withColumn("off", F.col("off") | F.when(F.col("first"), _differs(every)).otherwise(False)).where("off").select(*KEY).distinct()


def verified(turns: DataFrame, scratch: Scratch, bits: int = 64) -> DataFrame:
    """conv_id, depth, words, fp and parent_fp such that prefixes of one depth are equal if and only if their fp is."""
    rows = scratch.cut(fingerprints(turns, bits), "trie-turns")
    for turn in itertools.count():
        bad = scratch.cut(disagreements(rows), "trie-disagreements")
        if bad.isEmpty():
            return rows.select("conv_id", "depth", "words", "fp", "parent_fp")
        members = rows.join(bad, KEY)
        smallest = members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"))
        reps = members.join(smallest, [*KEY, "conv_id"]).select(*KEY, *[F.col(c).alias(f"rep_{c}") for c in ("parent_fp", "role", "text")])
        off = members.join(reps, KEY).where(_differs()).withColumn("move", F.xxhash64(F.lit(turn), "parent_fp", "role", "text"))
        first = off.groupBy("conv_id").agg(F.min_by("move", "depth").alias("move"), F.min("depth").alias("at"))
        shift = lambda c, d: F.when(F.col("at") <= d, F.col(c).bitwiseXOR(F.col("move"))).otherwise(F.col(c)).alias(c)
        rest = [c for c in rows.columns if c not in ("fp", "parent_fp")]
        rows = scratch.cut(rows.join(first, "conv_id", "left").select(*rest, shift("fp", F.col("depth")), shift("parent_fp", F.col("depth") - 1)), "trie-turns")


def _digests(batches: Iterator) -> Iterator:
    """One hash for each node, from its chunks in order."""
    import pyarrow as pa

    now, sha, out = None, None, []
    names = ["depth", "fp", "ends_sha256"]
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names)
    for batch in batches:
        for depth, fp, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if now != (depth, fp):
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = (depth, fp), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if len(out) >= 10_000:
            yield flush()
            out = []
    if now:
        out.append((*now, sha.hexdigest()))
    if out:
        yield flush()


def ends(rows: DataFrame) -> DataFrame:
    """depth, fp and the digest of the members (conv_id, depth, fp) that end there."""
    chunk = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(CHUNK))
    chunks = rows.groupBy(*KEY, chunk.alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "chunk").select(*KEY, "ids").mapInArrow(_digests, "depth bigint, fp bigint, ends_sha256 string")


def trie(turns: DataFrame, scratch: Scratch, bits: int = 64) -> DataFrame:
    """One row per node of turns (as ordered() or rebuilt() give them): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (words that need not be read again where prefixes are shared) and ends_sha256."""
    whole = Window.partitionBy("conv_id")
    onward = whole.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = verified(turns, scratch, bits).withColumns({"length": F.max("depth").over(whole), "tail": F.sum("words").over(onward)})
    rows = scratch.cut(rows.drop("words"), "trie-rows")
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("owner"), F.min_by("tail", "conv_id").alias("tail"), F.max("length").alias("deepest"), F.count("*").alias("n_convs"), F.min("parent_fp").alias("parent_fp")
    )
    nodes = scratch.cut(nodes, "trie-nodes")
    own = nodes.groupBy(F.col("owner").alias("conv_id")).agg(F.min("depth").alias("since"), F.max("tail").alias("own_tail"), F.max((F.col("deepest") == F.col("depth")).cast("bigint")).alias("leaf"))
    below = F.col("depth") + 1
    once = F.when(F.col("depth") < F.col("since"), F.col("own_tail")).when(F.col("since").isNotNull(), F.col("tail")).otherwise(0)
    sums = rows.join(own, "conv_id", "left").groupBy(*KEY).agg(
        F.sum(F.coalesce((F.col("since") <= below) & (below <= F.col("length")), F.lit(False)).cast("bigint")).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).cast("bigint").alias("n_leaves"),
        F.sum(F.col("tail") - once).alias("saved_tokens"),
    )
    done = nodes.join(sums, KEY).join(ends(rows.where("depth = length")), KEY, "left")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("parent_fp"), F.col("owner").alias("parent_conv_id"))
    done = done.join(parents, ["depth", "parent_fp"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return done.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return trie(rebuilt(t), Scratch(spark))


#: CRC-32 in SQL, four bits at a time (CRC-32 of 0 to 15, shifted: fixed values).
_NIBBLES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def crc32_sql(s: str) -> str:
    nibble = f"CAST(instr('0123456789ABCDEF', hex(encode({s}))[i // 2 * 2 + 2 - i % 2]) - 1 AS BIGINT)"
    return f"xor(list_reduce(list_transform(range(0, 2 * octet_length(encode({s}))), lambda i: {nibble}), lambda a, x: xor(a >> 4, {_NIBBLES}[xor(a, x) % 16 + 1]), 4294967295), 4294967295)"


ORACLE = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS lender, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (SELECT c.conv_id, o.i, 0 AS part, o.role, o.text FROM c JOIN o ON o.conv_id = c.lender AND o.i <= c.h UNION ALL SELECT c.conv_id, o.i, 1, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id AND o.i > c.h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth, role, text FROM b),
p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS k FROM t
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
n AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words FROM p GROUP BY ALL),
e AS (SELECT depth, k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT * FROM p QUALIFY depth = max(depth) OVER (PARTITION BY conv_id)) GROUP BY ALL),
up AS (SELECT n.depth, n.k, m.conv_id AS parent_conv_id FROM n JOIN n m ON m.depth = n.depth - 1 AND m.k = left(n.k, 64 * (n.depth - 1))),
kids AS (SELECT depth - 1 AS depth, left(k, 64 * (depth - 1)) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
down AS (SELECT n.*, kids.n_children, unnest(range(0, n.depth + 1)) AS above FROM n LEFT JOIN kids USING (depth, k)),
roll AS (SELECT above AS depth, left(k, 64 * above) AS k, count(*) FILTER (n_children IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM down GROUP BY 1, 2)
SELECT n.conv_id, n.depth, up.parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, roll.n_leaves, roll.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN roll USING (depth, k) LEFT JOIN up USING (depth, k) LEFT JOIN kids USING (depth, k) LEFT JOIN e USING (depth, k)
"""
