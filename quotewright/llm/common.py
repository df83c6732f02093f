"""Plumbing shared by the corpus operators: shared scratch tables, words, hashing, components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is: runs without space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
CUTS = 5  # scratch tables after which the driver cleans up, so that what it holds does not grow with the number of rounds
BYTES = 1 << 16  # of a text that are hashed at a time

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where it is unset, a temporary one in local mode, as in tests; elsewhere an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"spark.checkpoint.dir is unset: {master} needs a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="quotewright-"))
    return _own[0]


class Scratch:
    """Written tables that cut lineage: a lost executor costs a reread, never a recomputation of the whole plan."""

    def __init__(self, spark: SparkSession):
        self.spark, self.top = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.at: dict[str, str] = {}
        self.cuts = 0
        where = spark._jvm.org.apache.hadoop.fs.Path(self.top)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)  # results may be read until the session ends

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read back; an earlier table of the same name is removed once the new one is there."""
        path, old = f"{self.top}/{name}-{len(self.at)}-{uuid.uuid4().hex[:8]}", self.at.get(name)
        df.write.parquet(path)
        self.at[name] = path
        if old:
            self._remove(old)
        self.cuts += 1
        if self.cuts % CUTS == 0:
            self.clean()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.at:
                self._remove(self.at.pop(name))

    def keep(self, *names: str) -> None:
        """Drops all but these, and cleans up."""
        self.drop(*set(self.at) - set(names))
        self.clean()

    def clean(self) -> None:
        """Lets the driver clean up what no plan refers to any longer: its memory holds broadcast tables, plans and their compiled code until then, and executors' disks hold shuffle files."""
        gc.collect()
        self.spark._jvm.System.gc()

    def _remove(self, path: str) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


_B, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_INVERSE = pow(_B, -1, 1 << 64)
_powers, _inverse = (np.cumprod(np.r_[np.uint64(1), np.full(BYTES, x, np.uint64)]) for x in (_B, _INVERSE))
_byte = np.random.default_rng(41).integers(0, 2**64, 256, dtype=np.uint64)
_byte[65:91] = _byte[97:123]  # A-Z count as a-z
_inside = ~np.isin(np.arange(256), list(SPACES.encode()))


def word_edges(text: bytes) -> np.ndarray:
    """Where words start and stop, by turns."""
    inside = _inside[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    return np.concatenate([[0] * bool(len(inside) and inside[0]), edges, [len(inside)] * bool(len(inside) and inside[-1])]).astype(np.int64)


def text_hashes(text: bytes | None, edges: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of a text's words with A-Z lower-cased, in order.

    A word's hash is the sum of its bytes' random values times the powers of an odd number, the first power one, mixed. The sums
    come from prefix sums over the text, BYTES at a time, so no word becomes an object; memory is bounded but for the words' own.
    """
    if not text:
        return np.zeros(0, np.uint64)
    x = np.frombuffer(text, np.uint8)
    edges = word_edges(text) if edges is None else edges
    sums, back = np.zeros(len(edges), np.uint64), np.zeros(len(edges), np.uint64)
    carry, power, inverse = 0, 1, 1
    for o in range(0, len(x), BYTES):
        part = x[o : o + BYTES]
        own = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_byte[part] * _powers[: len(part)], out=own[1:])
        i, j = np.searchsorted(edges, (o, o + len(part) + 1))
        at = edges[i:j] - o
        sums[i:j] = own[at] * np.uint64(power) + np.uint64(carry)
        back[i:j] = _inverse[at] * np.uint64(inverse)
        carry = (carry + int(own[-1]) * power) & _ALL
        power, inverse = power * int(_powers[len(part)]) & _ALL, inverse * int(_inverse[len(part)]) & _ALL
    return mix((sums[1::2] - sums[::2]) * back[::2])


def word_hashes(words: list[bytes]) -> np.ndarray:
    """The hashes of words, none of which is empty."""
    return text_hashes(b" ".join(words))


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text with A-Z lower-cased; bytes.split and bytes.lower know exactly the six separators and ASCII letters."""
    return text.lower().split() if text else []


_A, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, in order; a shorter sequence is one shingle as a whole, none has none."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        x = np.array([n], np.uint64)
        for w in h:
            x = x * _A + w
        return mix(x)
    x = h[: n - k + 1].copy()
    for i in range(1, k):
        x = x * _A + h[i : n - k + 1 + i]
    return mix(x)


def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def texts_of(batch, column: str) -> list[bytes | None]:
    """The column of an Arrow batch as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    c = batch.column(batch.schema.get_field_index(column))
    return c.cast(pa.large_binary() if pa.types.is_large_string(c.type) else pa.binary()).to_pylist()


def views(column) -> list[np.ndarray]:
    """The values of an Arrow binary column as arrays of 64-bit integers, without copying them."""
    import pyarrow as pa

    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [flat[a:b].view(np.uint64) for a, b in zip(offsets[:-1], offsets[1:])]


#: Bits of the map that narrowed() broadcasts: half a megabyte, whatever the input.
MAP_BITS = 22


def narrowed(rows: DataFrame, ids: DataFrame, of_ids: str, key: str, inside: bool = True) -> DataFrame:
    """The rows whose key may be among ids: those whose hash is marked in a bitmap of fixed size. Not inside: all others, null keys too.

    It goes before a join of many or large rows with few ids, so that few rows are shuffled. The bitmap has at most
    2**(MAP_BITS - 6) rows of 64 bits; where ids are too many for it, more rows pass and the join does the rest.
    """
    spot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("bigint")), F.lit(1 << MAP_BITS))
    bit = F.expr("shiftleft(1L, cast(_spot % 64 as int))")
    marks = ids.select(spot(of_ids).alias("_spot")).groupBy(F.expr("_spot div 64").alias("_cell")).agg(F.bit_or(bit).alias("_bits"))
    seen = rows.withColumn("_spot", spot(key)).withColumn("_cell", F.expr("_spot div 64")).join(F.broadcast(marks), "_cell", "inner" if inside else "left")  # bounded by the map's size
    marked = (F.col("_bits").bitwiseAND(bit) != 0) & F.col(key).isNotNull()
    return seen.where(marked if inside else ~F.coalesce(marked, F.lit(False))).select(*rows.columns)


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp): the smallest node reachable from each node of the undirected edges (a, b).

    Labels move along the edges and then jump to their label's label, so that stars end after two rounds and
    chains after about the logarithm of their length. A hot node meets its edges in joins that Spark can split;
    its labels are aggregated before they are shuffled. Edges with a null end are ignored.
    """
    both = edges.where("a is not null and b is not null and a <> b")
    both = scratch.cut(both.select("a", "b").union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), f"{name}-labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("comp").alias("m"))
        moved = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        up = labels.select(F.col("node").alias("n2"), F.col("comp").alias("c2"))
        jumped = moved.join(up, F.col("comp") == F.col("n2"), "left").select("node", "was", F.least("comp", F.coalesce("c2", "comp")).alias("comp"))
        new = scratch.cut(jumped, f"{name}-labels")
        if not new.where("comp <> was").limit(1).count():
            scratch.drop(f"{name}-edges")
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def joined_components(comps: DataFrame, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) of comps after the edges (a, b) have joined some of them: components of the components, named by the smallest node."""
    named = comps.withColumnRenamed("comp", "c")
    ends = edges.join(named.withColumnRenamed("node", "a"), "a", "left").withColumn("a", F.coalesce("c", "a")).drop("c")
    ends = ends.join(named.withColumnRenamed("node", "b"), "b", "left").withColumn("b", F.coalesce("c", "b")).select("a", "b").distinct()
    over = connected_components(ends, scratch, f"{name}-over")
    moved = comps.join(over.select(F.col("node").alias("comp"), F.col("comp").alias("c")), "comp", "left").select("node", F.coalesce("c", "comp").alias("comp"))
    return scratch.cut(moved.union(over.join(comps, "node", "left_anti").select("node", "comp")), name)


def append(docs: DataFrame, text: str, make, ddl: str, rows: int | None = None) -> DataFrame:
    """docs with columns appended by Arrow batches; make() gives, once per task, a function texts -> list of Arrow arrays in ddl's order.

    Columns of docs that ddl names again are replaced. rows: how many are worked on at a time, where a batch's would take too much memory.
    """
    from pyspark.sql import types as T

    new = T._parse_datatype_string(ddl)
    plain = docs.select(*[c for c in docs.columns if c not in new.names])
    names, where = [*plain.columns, *new.names], plain.columns.index(text)

    def run(batches):
        import pyarrow as pa

        work = make()
        for batch in batches:
            step = rows or max(1, batch.num_rows)
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)) if batch.num_rows else (batch,):
                yield pa.RecordBatch.from_arrays([*part.columns, *work(part.column(where).to_pylist())], names)

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *new.fields]))
