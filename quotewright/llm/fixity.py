"""Merkle fixity audit of WARC records.

Pages become WARC response records, CENTURY to a file by page_id, with their byte ranges in the file. A record's leaf
hashes its range and its bytes' hash; every node hashes its children in order, FANOUT to a node, within a file and then
over files, up to one root per replica. An audit compares roots and descends: at each level only the children of nodes
that differ are joined, so intact branches are never read.

Cases. Null url or html: empty. Null page_id: files of their own, by a hash of the row. Repeated rows: records of
their own, one after another; equal ones are numbered. Empty replica: no root; every record of the other is missing.
Very long pages: hashed whole, in one row. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

CENTURY, FANOUT, LEVELS = 128, 16, 16
#: Where rows without an id go: files beyond all others.
NULL_FILES = 1 << 20


def warc_record(url: Column, html: Column) -> Column:
    """The bytes of a WARC/1.0 response record."""
    body = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n").cast("binary"), html.cast("binary"))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def records(pages: DataFrame) -> DataFrame:
    """(page_id, file, place, start, length, sha256): every record, its file, its place and byte range there and the hash of its bytes.

    The record's bytes are hashed where the page is read; only hashes are shuffled.
    """
    record = warc_record(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))
    hashed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.length(record).cast("bigint").alias("length"), F.sha2(record, 256).alias("sha256"))
    file = F.coalesce(F.expr(f"page_id div {CENTURY}"), F.expr(f"-1 - pmod(xxhash64(sha256), {NULL_FILES})"))
    order = Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "sha256")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hashed.withColumn("file", file).select("page_id", "file", (F.row_number().over(order) - 1).cast("bigint").alias("place"), before.cast("bigint").alias("start"), "length", "sha256")


def _parent(place: Column) -> Column:
    """The place of a node's parent; the nodes left of zero end under the same root as the others."""
    return F.when(place == -1, 0).otherwise(F.floor(place / FANOUT)).cast("bigint")


def _up(children: DataFrame, by: list[str], place: Column) -> DataFrame:
    """Parents of nodes (…, place, hash): at most FANOUT children each (one more at zero), in order."""
    parent = _parent(place)
    kids = F.array_sort(F.collect_list(F.struct("place", "hash")))
    return children.groupBy(*by, parent.alias("up")).agg(kids.alias("kids")).select(*by, F.col("up").alias("place"), F.sha2(F.array_join(F.transform("kids", lambda k: F.concat_ws(":", k["place"].cast("string"), k["hash"])), ","), 256).alias("hash"))


class Tree:
    """The levels of one replica: leaves, nodes inside files, files, and nodes over files up to the root."""

    def __init__(self, recs: DataFrame, scratch: Scratch, name: str, inner: int = 2):
        leaf = F.sha2(F.concat_ws(":", F.col("start").cast("string"), F.col("length").cast("string"), "sha256"), 256)
        self.leaves = scratch.cut(recs.select("file", "place", leaf.alias("hash"), "page_id", "start", "length", "sha256"), f"{name}-leaves")
        self.inner = []  # inside files, level by level; the last has one node per file where files keep to CENTURY
        level = self.leaves.select("file", "place", "hash")
        for i in range(inner):
            level = scratch.cut(_up(level, ["file"], F.col("place")), f"{name}-inner-{i}")
            self.inner.append(level)
        self.files = scratch.cut(level.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("k")).select(F.col("file").alias("place"), F.sha2(F.array_join("k.hash", ","), 256).alias("hash")), f"{name}-files")
        self.over = [self.files]
        for i in range(LEVELS):
            top = self.over[-1].agg(F.min("place"), F.max("place")).first()
            if top[0] is None or top[0] == top[1]:
                break
            self.over.append(scratch.cut(_up(self.over[-1], [], F.col("place")), f"{name}-over-{i}"))

    def root(self) -> str | None:
        row = self.over[-1].select("hash").first()
        return row[0] if row else None


def _differ(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Keys of the nodes that are not the same in both."""
    other = b.select(*on, F.col("hash").alias("other"))
    return a.join(other, on, "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select(*on)


def audit(a: Tree, b: Tree, scratch: Scratch) -> DataFrame:
    """(file, place) of every leaf that differs or that one replica lacks, found by descending from the roots."""
    up = max(len(a.over), len(b.over)) - 1
    bad = None
    for i in range(up, -1, -1):
        x, y = (t.over[i] if i < len(t.over) else t.over[-1].limit(0) for t in (a, b))
        if bad is not None and i + 1 < min(len(a.over), len(b.over)):  # only under what differs
            parent = _parent(F.col("place"))
            x, y = (t.withColumn("up", parent).join(bad.withColumnRenamed("place", "up"), "up", "left_semi").drop("up") for t in (x, y))
        bad = scratch.cut(_differ(x, y, ["place"]), f"bad-over-{i}")
    bad = bad.withColumnRenamed("place", "file")
    x, y = (t.inner[-1].join(bad, "file", "left_semi") for t in (a, b))
    bad = scratch.cut(_differ(x, y, ["file", "place"]), "bad-inner")
    below = [*(list(zip(a.inner, b.inner))[-2::-1]), (a.leaves, b.leaves)]
    for i, (x, y) in enumerate(below):
        up_ = bad.withColumnRenamed("place", "up")
        x, y = (t.select("file", "place", "hash").withColumn("up", _parent(F.col("place"))).join(up_, ["file", "up"], "left_semi").drop("up") for t in (x, y))
        bad = scratch.cut(_differ(x, y, ["file", "place"]), f"bad-{i}")
    return bad


def compare_replicas(first: DataFrame, second: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per record of the two replicas' pages: its place in each file, its hash, and status same, moved (its range alone differs), changed, missing or added."""
    a, b = Tree(records(first), scratch, "first"), Tree(records(second), scratch, "second")
    x = a.leaves.select("file", "place", "page_id", "start", "length", "sha256", F.lit(True).alias("in_first"))
    if a.root() == b.root():
        return x.select("file", "place", "page_id", "start", "length", "sha256", F.lit("same").alias("status"))
    bad = audit(a, b, scratch).withColumn("bad", F.lit(True))
    # of the second replica, only the records that the descent has found
    y = b.leaves.join(bad, ["file", "place"], "left_semi").select("file", "place", F.col("page_id").alias("page_2"), F.col("start").alias("start_2"), F.col("length").alias("length_2"), F.col("sha256").alias("sha_2"), F.lit(True).alias("in_second"))
    both = x.join(bad, ["file", "place"], "left").join(y, ["file", "place"], "full")
    status = F.when(F.col("in_first").isNull(), "added").when(F.col("bad").isNull(), "same").when(F.col("in_second").isNull(), "missing").when(F.col("sha256") == F.col("sha_2"), "moved").otherwise("changed")
    return both.select("file", "place", F.coalesce("page_id", "page_2").alias("page_id"), F.coalesce("start", "start_2").alias("start"), F.coalesce("length", "length_2").alias("length"), F.coalesce("sha256", "sha_2").alias("sha256"), status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage: a byte of every 97th page is changed, every 1009th page has lost its html."""
    html = F.when(F.col("page_id") % 1009 == 7, F.lit("")).when(F.col("page_id") % 97 == 5, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html"))
    return pages.withColumn("html", html)


def op6_merkle_fixity(spark, sf_dir):
    """Audits the pages' records against a replica with known damage; changed lengths move the ranges of the records behind."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return compare_replicas(pages, damaged(pages), Scratch(spark)).select("page_id", F.col("file").alias("file_id"), F.col("start").alias("range_start"), F.col("length").alias("range_length"), "sha256", "status")


_RECORD = """encode('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10)
 || 'Content-Type: application/http;msgtype=response' || chr(13) || chr(10) || 'Content-Length: ' || CAST(octet_length(encode({html})) + 44 AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10)
 || 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || chr(13) || chr(10) || {html} || chr(13) || chr(10) || chr(13) || chr(10))"""
_DAMAGED = "(CASE WHEN page_id % 1009 = 7 THEN '' WHEN page_id % 97 = 5 THEN '?' || substring(html, 2) ELSE html END)"
ORACLE = f"""
WITH r AS (SELECT page_id, page_id // {CENTURY} AS file_id, {_RECORD.format(html='html')} AS a, {_RECORD.format(html=_DAMAGED)} AS b FROM pages),
h AS (SELECT page_id, file_id, octet_length(a) AS la, octet_length(b) AS lb, sha256(a) AS ha, sha256(b) AS hb FROM r),
o AS (SELECT *, CAST(coalesce(sum(la) OVER w, 0) AS BIGINT) AS sa, CAST(coalesce(sum(lb) OVER w, 0) AS BIGINT) AS sb FROM h
 WINDOW w AS (PARTITION BY file_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT page_id, CAST(file_id AS BIGINT) AS file_id, sa AS range_start, CAST(la AS BIGINT) AS range_length, ha AS sha256,
 CASE WHEN sa = sb AND la = lb AND ha = hb THEN 'same' WHEN ha = hb THEN 'moved' ELSE 'changed' END AS status FROM o
"""
