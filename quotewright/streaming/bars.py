"""Streaming forms: bars, bursts and the top of book over an unbounded canonical event stream.

Event time is timestamp_ns; late rows beyond the watermark are dropped by Spark, but for counted_bars, which gives them as rows.
Each function takes a streaming or a batch frame and gives the same rows for the same events.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.running import BUCKET, lagged, running_max, running_sum
from ..schema import CANONICAL
from ..simulation.kernel import Book


def event_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """Canonical Parquet files with a symbol column, as they arrive in a folder."""
    from pyspark.sql import types as T

    return spark.readStream.schema(T.StructType([T.StructField("symbol", T.LongType()), *CANONICAL.fields])).option("maxFilesPerTrigger", max_files).parquet(path)


def timed(events: DataFrame, late: str) -> DataFrame:
    """events with event_time (microseconds) and a watermark."""
    t = events.withColumn("event_time", F.timestamp_micros(F.floor(F.col("timestamp_ns") / 1000).cast("bigint")))
    return t.withWatermark("event_time", late) if t.isStreaming else t


def trade_bars(events: DataFrame, width: str = "1 minute", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Open, high, low, close and volume of trades per symbol and window; order within a window is by sequence number."""
    t = timed(events, late).where("event_type = 'TRADE'")
    w = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    p, n = F.col("price_ticks"), F.col("sequence_number")
    bars = t.groupBy("symbol", w.alias("w")).agg(F.min_by(p, n).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, n).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trades"))
    return bars.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "high", "low", "close", "volume", "trades")


def bursts(events: DataFrame, gap: str = "5 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of a symbol's events with no longer pause than gap."""
    s = timed(events, late).groupBy("symbol", F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("quantity").alias("quantity"))
    return s.select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "quantity")


def top_of_book(events: DataFrame) -> DataFrame:
    """Best bid and ask after every event, kept per symbol as state; rows of a symbol must arrive in sequence order, trigger by trigger."""

    def run(key: tuple, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        book = Book()
        if state.exists:
            sides, prices, sizes = state.get
            for s, p, q in zip(sides, prices, sizes):
                book.side[s][p] = q
            book.refresh(1)
            book.refresh(-1)
        rows = []
        for r in pd.concat(list(frames)).sort_values("sequence_number").itertuples():
            reset = r.event_type == "RESET"
            book.apply(r.event_type, None if reset else int(r.side), int(r.price_ticks), int(r.quantity))
            b, qb, a, qa, *_ = book.top()
            rows.append((key[0], r.sequence_number, b, qb, a, qa))
        held = [(s, p, q) for s in (1, -1) for p, q in book.side[s].items()]
        state.update(([h[0] for h in held], [h[1] for h in held], [h[2] for h in held]))
        out = pd.DataFrame(rows, columns=["symbol", "sequence_number", "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity"])
        yield out.astype({"best_bid_ticks": "Int64", "best_ask_ticks": "Int64"})

    out = "symbol bigint, sequence_number bigint, best_bid_ticks bigint, best_bid_quantity bigint, best_ask_ticks bigint, best_ask_quantity bigint"
    return events.groupBy("symbol").applyInPandasWithState(run, out, "sides array<int>, prices array<bigint>, sizes array<bigint>", "append", "NoTimeout")


BARS = "symbol bigint, kind string, start_ns bigint, end_ns bigint, open bigint, high bigint, low bigint, close bigint, volume bigint, trades bigint, late_rows bigint"
_ROW = "open bigint, first bigint, high bigint, low bigint, close bigint, last bigint, volume bigint, trades bigint"


def counted_bars(events: DataFrame, width_ns: int, late_ns: int) -> DataFrame:
    """Bars of trades (kind bar), once a symbol's time has passed their end by late_ns, and every late row (kind late) with how many there were by then.

    A symbol's time is the highest of the rows before, in the order of sequence_number, which is the order of arrival; a row late_ns or
    more behind it is late and in no bar. What is late depends on the rows alone, not on how they fall into triggers, so a stream and a
    batch give the same. State per symbol: its time, its count of late rows, and its open bars (as many as late_ns holds, and one).
    """
    rows = events.select("symbol", "sequence_number", "timestamp_ns", "event_type", "price_ticks", "quantity")
    return (_stream_bars if events.isStreaming else _batch_bars)(rows, width_ns, late_ns)


def _batch_bars(rows: DataFrame, width_ns: int, late_ns: int) -> DataFrame:
    """The same from whole frames: the highest time before a row and the late rows so far are running values over buckets."""
    before = lagged(running_max(rows, ["symbol"], ["sequence_number"], F.col("timestamp_ns"), "_now", "sequence_number"), ["symbol"], ["sequence_number"], F.col("_now"), "_before", "sequence_number", BUCKET)
    late = F.coalesce(F.col("_before") - F.col("timestamp_ns") >= late_ns, F.lit(False))
    counted = running_sum(before.withColumn("_late", late), ["symbol"], "sequence_number", F.col("_late").cast("bigint"), "late_rows")
    ends = rows.groupBy("symbol").agg(F.max("timestamp_ns").alias("_end"))
    p, n = F.col("price_ticks"), F.col("sequence_number")
    start = (F.col("timestamp_ns") - F.pmod("timestamp_ns", F.lit(width_ns))).alias("start_ns")
    bars = counted.where("not _late and event_type = 'TRADE'").groupBy("symbol", start).agg(F.min_by(p, n).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, n).alias("close"), F.sum("quantity").alias("volume"), F.count("*").alias("trades"))
    done = bars.join(ends, "symbol").where(F.col("_end") - (F.col("start_ns") + width_ns) >= late_ns)
    none = lambda *names: [F.lit(None).cast("bigint").alias(c) for c in names]
    done = done.select("symbol", F.lit("bar").alias("kind"), "start_ns", (F.col("start_ns") + width_ns).alias("end_ns"), "open", "high", "low", "close", "volume", "trades", *none("late_rows"))
    late_ = counted.where("_late").select("symbol", F.lit("late").alias("kind"), F.col("timestamp_ns").alias("start_ns"), F.col("sequence_number").alias("end_ns"), *none("open", "high", "low", "close", "volume", "trades"), "late_rows")
    return done.union(late_)


def _stream_bars(rows: DataFrame, width_ns: int, late_ns: int) -> DataFrame:
    return rows.groupBy("symbol").transformWithStateInPandas(_Bars(width_ns, late_ns), BARS, "append", "None")


class _Bars(StatefulProcessor):
    """A symbol's rows in order of arrival; late rows go out at once, bars when their time is over."""

    def __init__(self, width_ns: int, late_ns: int):
        self.width, self.late = width_ns, late_ns

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "time bigint, late bigint")
        self.open = handle.getMapState("open", "start bigint", _ROW)

    def handleInputRows(self, key, frames, timers):  # noqa: N802
        import pandas as pd

        now, late = self.known.get() if self.known.exists() else (None, 0)
        bars = {k[0]: list(v) for k, v in self.open.iterator()}
        held, out = set(bars), []
        every = pd.concat(list(frames)).sort_values("sequence_number")
        for n, t, kind, p, q in zip(*(every[c].tolist() for c in ("sequence_number", "timestamp_ns", "event_type", "price_ticks", "quantity"))):
            if now is not None and now - t >= self.late:
                late += 1
                out.append((key[0], "late", t, n, None, None, None, None, None, None, late))
                continue
            now = t if now is None else max(now, t)
            if kind == "TRADE":
                b = bars.setdefault(t - t % self.width, [p, n, p, p, p, n, 0, 0])
                b[2], b[3], b[4], b[5], b[6], b[7] = max(b[2], p), min(b[3], p), p, n, b[6] + q, b[7] + 1
        for start in sorted(s for s in bars if now - (s + self.width) >= self.late):
            o, _, high, low, close, _, volume, trades = bars.pop(start)
            out.append((key[0], "bar", start, start + self.width, o, high, low, close, volume, trades, None))
        for start in held - set(bars):
            self.open.removeKey((start,))
        for start, b in bars.items():
            self.open.updateValue((start,), tuple(b))
        self.known.update((now, late))
        names = [f.split()[0] for f in BARS.split(", ")]
        yield pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=object if c == "kind" else "Int64") for i, c in enumerate(names)})

    def close(self) -> None:
        pass
