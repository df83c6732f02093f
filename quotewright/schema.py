"""The canonical Level-2 event stream: fixed columns, totally ordered by sequence_number within a symbol."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BID, ASK = 1, -1
ADD, CANCEL, TRADE, RESET, SNAPSHOT = "ADD", "CANCEL", "TRADE", "RESET", "SNAPSHOT"
EVENT_TYPES = (ADD, CANCEL, TRADE, RESET, SNAPSHOT)

CANONICAL = T.StructType(
    [
        T.StructField("timestamp_ns", T.LongType()),
        T.StructField("sequence_number", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("side", T.ByteType()),
        T.StructField("price_ticks", T.LongType()),
        T.StructField("quantity", T.LongType()),
    ]
)


class SchemaError(ValueError):
    """Columns or values that the canonical schema does not allow."""


def empty_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CANONICAL)


def events_frame(spark: SparkSession, rows) -> DataFrame:
    """Rows (tuples or mappings) as a canonical frame."""
    return spark.createDataFrame([tuple(r[f] for f in CANONICAL.names) if isinstance(r, dict) else tuple(r) for r in rows], CANONICAL)


def event_of(row) -> dict:
    """A mapping or a row as a mapping of the canonical columns; missing ones raise."""
    d = row.asDict() if hasattr(row, "asDict") else dict(row)
    if missing := [n for n in CANONICAL.names if n not in d]:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return {n: d[n] for n in CANONICAL.names}


def event_rows(frame: DataFrame):
    """A canonical frame as mappings in sequence order, fetched one partition at a time."""
    return map(event_of, frame.orderBy("sequence_number").toLocalIterator())


def coerce(frame: DataFrame, allow_extra: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """Projects and casts to the canonical columns, after any partition keys; lossy or failing casts raise when run."""
    missing = [c for c in CANONICAL.names if c not in frame.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    extra = [c for c in frame.columns if c not in CANONICAL.names and c not in keys]
    if extra and not allow_extra:
        raise SchemaError(f"unexpected columns: {', '.join(extra)}")

    def exact(f: T.StructField) -> Column:
        c, have = F.col(f.name), frame.schema[f.name].dataType
        if isinstance(f.dataType, T.IntegralType) and isinstance(have, (T.FractionalType, T.StringType)):
            whole = c.cast("decimal(38,9)")
            c = F.when(whole != F.floor(whole), F.raise_error(F.concat(F.lit(f"lossy cast of {f.name}: "), c.cast("string")))).otherwise(whole)
        return c.cast(f.dataType).alias(f.name)

    return frame.select(*keys, *[exact(f) for f in CANONICAL.fields])


def violation() -> Column:
    """The first rule of the row contract that a canonical row breaks, or null."""
    is_reset = F.col("event_type") == RESET
    return (
        F.when(F.col("timestamp_ns").isNull() | (F.col("timestamp_ns") < 0), "negative_timestamp")
        .when(F.col("sequence_number").isNull() | (F.col("sequence_number") < 0), "negative_sequence")
        .when(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES), "unknown_event_type")
        .when(is_reset & ((F.col("price_ticks") != 0) | (F.col("quantity") != 0)), "reset_with_level")
        .when(~is_reset & (F.col("side").isNull() | ~F.col("side").isin(BID, ASK)), "invalid_side")
        .when(~is_reset & (F.col("price_ticks") <= 0), "nonpositive_price")
        .when(~is_reset & (F.col("quantity") <= 0), "nonpositive_quantity")
    )


def select_events(events: DataFrame, start_ns: int | None = None, end_ns: int | None = None, limit: int | None = None, key: str = "symbol") -> DataFrame:
    """Inclusive time range, then the first limit rows of each symbol in sequence order."""
    if start_ns is not None:
        events = events.where(F.col("timestamp_ns") >= start_ns)
    if end_ns is not None:
        events = events.where(F.col("timestamp_ns") <= end_ns)
    if limit is not None:
        from pyspark.sql import Window

        order = Window.partitionBy(key).orderBy("sequence_number")  # a top-k window: Spark keeps limit rows per key before it shuffles
        events = events.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")
    return events
