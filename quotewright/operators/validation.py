"""Validation of event streams: contract, order and book effects, strict or lenient."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SchemaError, coerce, violation
from .book import level_changes, with_epochs


class StreamError(ValueError):
    """The first issue of a stream that must have none."""


@dataclass
class Validation:
    """issues (symbol, event_index, code), how often each occurs, and whether there is none."""

    issues: DataFrame
    diagnostics: dict[str, int] = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return not self.diagnostics


def _found(events: DataFrame) -> DataFrame:
    """(symbol, event_index, code, counter) of an event table with event_index; counter is what a lenient book counts, if anything."""
    w = Window.partitionBy("symbol").orderBy("event_index")
    e = events.withColumn("_v", violation()).withColumn("_t", F.lag("timestamp_ns").over(w)).withColumn("_s", F.lag("sequence_number").over(w))
    codes = F.filter(F.array(F.col("_v"), F.when(F.col("timestamp_ns") < F.col("_t"), "timestamp_regression"), F.when(F.col("sequence_number") <= F.col("_s"), "sequence_not_strictly_increasing")), lambda x: x.isNotNull())
    order = e.select("symbol", "event_index", F.explode(codes).alias("code"), F.lit(None).cast("string").alias("counter"))
    good = e.where("_v is null").drop("_v", "_t", "_s").drop("sequence_number").withColumnRenamed("event_index", "sequence_number")
    counter = F.when(F.col("add_ignored"), "crossed_add_ignored").otherwise(F.concat(F.lit("clamped_"), F.lower("event_type")))
    clamps = level_changes(with_epochs(good)).where("clamped").select("symbol", F.col("sequence_number").alias("event_index"), F.lit("book_event_clamped").alias("code"), counter.alias("counter"))
    return order.unionByName(clamps)


def issues(events: DataFrame, strict: bool = False) -> DataFrame:
    """(symbol, event_index, code) of an event table with event_index, its arrival order.

    Rows that break the contract are reported alone; order is checked on arrival, the book in sequence. What a lenient book
    clamps or ignores is book_event_clamped; a strict book doesn't take it, which is invalid_book_transition.
    """
    found = _found(events).drop("counter")
    return found.replace("book_event_clamped", "invalid_book_transition", ["code"]) if strict else found


def validate(events: DataFrame, strict: bool = True) -> Validation:
    """Strict: raises the first issue. Lenient: counts them, and what the book clamped or ignored by kind. An empty stream is an issue of its own."""
    found = issues(events, strict)
    if strict:
        first = found.orderBy("event_index", "code").limit(1).collect()
        if first:
            raise StreamError(f"{first[0].code} at event {first[0].event_index} of symbol {first[0].symbol}")
        if not events.limit(1).count():
            raise StreamError("empty_stream")
        return Validation(found)
    counts: dict[str, int] = {}
    for r in _found(events).groupBy("code", "counter").count().collect():
        for name in (r.code, r.counter):
            if name:
                counts[name] = counts.get(name, 0) + r["count"]
    if not counts and not events.limit(1).count():
        counts["empty_stream"] = 1
    return Validation(found, counts)


def validate_frame(frame: DataFrame, strict: bool = True) -> Validation:
    """validate, after the canonical schema is enforced."""
    try:
        coerced = coerce(frame, keys=("symbol", "event_index"))
    except SchemaError:
        if strict:
            raise
        return Validation(frame.sparkSession.createDataFrame([], "symbol bigint, event_index bigint, code string"), {"invalid_schema": 1})
    return validate(coerced, strict)


def validate_file(spark, path: str, strict: bool = True) -> Validation:
    """validate_frame of a canonical file of one instrument, or of several with a column symbol; its events arrive in sequence order unless event_index says otherwise."""
    from ..sources.canonical import LoadError, load

    try:
        known = load(spark, path, allow_extra=True, keys=tuple(c for c in ("symbol", "event_index") if c in spark.read.option("header", True).format("csv" if path.lower().endswith(".csv") else "parquet").load(path).columns))
    except (LoadError, SchemaError):
        if strict:
            raise
        return Validation(spark.createDataFrame([], "symbol bigint, event_index bigint, code string"), {"invalid_schema": 1})
    if "symbol" not in known.columns:
        known = known.withColumn("symbol", F.lit(0).cast("bigint"))
    if "event_index" not in known.columns:
        known = known.withColumn("event_index", F.col("sequence_number"))
    return validate_frame(known, strict)


@dataclass(frozen=True)
class Certificate:
    """What a validation was of: it may be reused only for the same rows and the same mode."""

    stream_sha256: tuple[tuple[int, str, int], ...]
    strict: bool
    valid: bool


def certify(events: DataFrame, strict: bool = True) -> Certificate:
    """The certificate of a validated event table."""
    from ..sources.fingerprint import stream_sha256

    v = validate(events, strict)
    rows = stream_sha256(events, ["symbol"]).collect()  # a row for each symbol
    return Certificate(tuple(sorted((r.symbol, r.stream_sha256, r.n_events) for r in rows)), strict, v.valid)


def holds(certificate: Certificate, events: DataFrame, strict: bool = True) -> bool:
    """Whether the certificate is of these rows, in this mode, and says that they are valid."""
    from ..sources.fingerprint import stream_sha256

    rows = stream_sha256(events, ["symbol"]).collect()
    return certificate.valid and certificate.strict == strict and certificate.stream_sha256 == tuple(sorted((r.symbol, r.stream_sha256, r.n_events) for r in rows))
