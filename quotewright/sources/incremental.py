"""Incremental book updates with absolute amounts, and taker trades, as canonical events.

Book columns: exchange, symbol, timestamp and local_timestamp (microseconds), is_snapshot, side (bid or ask), price,
amount (what the level holds now). Trade columns: exchange, symbol, timestamp, local_timestamp, side (the taker's: buy,
sell or unknown), price, amount. Both need row, the arrival order.

A change from update to snapshot starts an epoch with a RESET. Within it an amount above the level's last one is an ADD,
below it a reduction. Trades take their share of reductions of the same level within a window, nearest first, under a
shared budget; what is matched becomes TRADE, the rest CANCEL.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quotes import price_to_ticks
from ..operators.running import BUCKET, lagged, numbered, running_sum
from .adapter import Adapter
from .shared import written


class AdapterError(ValueError):
    """Vendor rows that break their format's rules."""


KEY = ["exchange", "symbol"]
LEVEL = [*KEY, "side", "price_ticks"]
#: Every so many times of a level's reductions, those that no trade can reach any more are let go if they are half of them.
KEPT = 1_024


def _flag(c: Column) -> Column:
    t = F.lower(F.trim(c.cast("string")))
    return F.when(t.isin("true", "1"), True).when(t.isin("false", "0"), False).otherwise(F.raise_error(F.concat(F.lit("invalid snapshot flag: "), t)).cast("boolean"))


def _scaled(c: Column, multiplier: int) -> Column:
    whole = c.cast("decimal(30,12)") * multiplier
    return F.when(whole != F.floor(whole), F.raise_error(F.concat(F.lit("quantity cannot be represented: "), c.cast("string")))).otherwise(whole).cast("bigint")


def _problems(batches):
    """Streams rows ordered by instrument, epoch and row; holds the levels of one epoch, each side's prices in a heap."""
    import pyarrow as pa

    now = None
    for batch in batches:
        out = []
        for exchange, symbol, epoch, row, side, price, amount, snap, edge, late, closes in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (exchange, symbol, epoch):
                now = (exchange, symbol, epoch)
                books: dict[int, dict[int, int]] = {1: {}, -1: {}}
                heaps: dict[int, list[int]] = {1: [], -1: []}
                named = set()
            if late:
                out.append((exchange, symbol, row, "timestamps regress"))
            if snap:
                if (side, price) in named:
                    out.append((exchange, symbol, row, "duplicate snapshot level"))
                named.add((side, price))
            if amount:
                if price not in books[side]:
                    heapq.heappush(heaps[side], -price * side)
                books[side][price] = amount
            else:
                books[side].pop(price, None)
            if closes:
                for s in (1, -1):
                    while heaps[s] and -heaps[s][0] * s not in books[s]:
                        heapq.heappop(heaps[s])
                if heaps[1] and heaps[-1] and -heaps[1][0] >= heaps[-1][0]:
                    out.append((exchange, symbol, row, f"book crosses: bid {-heaps[1][0]}, ask {heaps[-1][0]} ticks"))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["exchange", "symbol", "row", "problem"])


class _Stretch:
    """Reductions of a level by time, and what trades leave of them. Those of one time are a group, taken from in row order; a group
    that is empty points to the one before it and the one after it, so that each is passed once."""

    def __init__(self, window: int):
        self.window = window
        self.times: list[int] = []
        self.groups: list[list[list[int]]] = []  # per time [row, quantity, left]
        self.heads: list[int] = []  # the first of a group that is not empty
        self.before, self.after = [0], [0]  # the group itself (before: plus 1) while it is not empty

    def add(self, time: int, row: int, quantity: int) -> None:
        if not self.times or self.times[-1] != time:
            self.times.append(time)
            self.groups.append([])
            self.heads.append(0)
            self.before.append(len(self.times))
            self.after.append(len(self.times))
        self.groups[-1].append([row, quantity, quantity])

    @staticmethod
    def find(to: list[int], i: int) -> int:
        end = i
        while to[end] != end:
            end = to[end]
        while to[i] != end:
            to[i], i = end, to[i]
        return end

    def trade(self, time: int, rest: int) -> None:
        """Takes from the nearest first, of equally near ones from the earlier."""
        times, n = self.times, len(self.times)
        at = bisect_right(times, time)
        i, j = self.find(self.before, at) - 1, self.find(self.after, at)
        while rest > 0:
            back = time - times[i] if i >= 0 else self.window + 1
            ahead = times[j] - time if j < n else self.window + 1
            if min(back, ahead) > self.window:
                return
            g = i if back <= ahead else j
            group, head = self.groups[g], self.heads[g]
            while rest and head < len(group):
                x = group[head]
                q = min(rest, x[2])
                x[2] -= q
                rest -= q
                head += not x[2]
            self.heads[g] = head
            if head == len(group):
                self.before[g + 1], self.after[g] = g, g + 1
                i, j = (self.find(self.before, g) - 1, j) if g == i else (i, self.find(self.after, g + 1))

    def leave(self, before: int | None = None) -> list[tuple[int, int]]:
        """(row, taken) of the reductions before a time (None: of all) that trades took from; they are forgotten."""
        cut = len(self.times) if before is None else bisect_left(self.times, before)
        out = [(row, quantity - left) for group in self.groups[:cut] for row, quantity, left in group if left < quantity]
        for part in (self.times, self.groups, self.heads):
            del part[:cut]
        full = [h < len(g) for h, g in zip(self.heads, self.groups)]
        self.before, self.after = [0, *(k + f for k, f in enumerate(full))], [*(k + (not f) for k, f in enumerate(full)), len(full)]
        return out


def _shares(batches, window: int, ordered: bool):
    """Streams reductions (kind 0) and trades (1) ordered by level, time, kind and row; yields exchange, symbol, row and what trades take."""
    import pyarrow as pa

    def done(level, found):
        exchange, symbol = ([x] * len(found) for x in level[:2])
        return pa.RecordBatch.from_arrays([pa.array(exchange, pa.string()), pa.array(symbol, pa.string()), pa.array([r for r, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], ["exchange", "symbol", "row", "matched"])

    def finish():
        for at, _, quantity in waiting if ordered else sorted(waiting, key=lambda t: t[1]):
            now.trade(at, quantity)
        return done(level, now.leave())

    level = now = last = None
    waiting: deque[tuple[int, int, int]] = deque()  # trades whose window may not be over: time, row, quantity
    for batch in batches:
        for *own, time, kind, row, quantity in zip(*(c.to_pylist() for c in batch.columns)):
            if own != level or time - last > window:
                if now:
                    yield finish()
                level, now = own, _Stretch(window)
                waiting.clear()
            last = time
            if ordered:
                while waiting and waiting[0][0] + window < time:
                    at, _, q = waiting.popleft()
                    now.trade(at, q)
            if kind:
                waiting.append((time, row, quantity))
                continue
            now.add(time, row, quantity)
            if ordered and not len(now.times) % KEPT:
                over = min(waiting[0][0] if waiting else time, time) - window
                if now.times[len(now.times) // 2] < over:
                    yield done(level, now.leave(over))
    if now:
        yield finish()


class IncrementalAdapter(Adapter):
    """tick_size and quantity_multiplier fix the integer units; timestamp_source names the column that becomes the event's time."""

    name = "incremental"

    def __init__(self, tick_size: str, quantity_multiplier: int = 1, timestamp_source: str = "local_timestamp", trade_match_window_ns: int = 1_000_000):
        if timestamp_source not in ("local_timestamp", "timestamp"):
            raise AdapterError("timestamp_source must be local_timestamp or timestamp")
        self.tick, self.multiplier, self.source, self.window = tick_size, quantity_multiplier, timestamp_source, trade_match_window_ns

    def levels(self, book: DataFrame) -> DataFrame:
        """Parsed rows from each symbol's first snapshot on, with edge, epoch and change against the level's last amount."""
        side = F.lower(F.trim("side"))
        b = book.select(
            *KEY, "row", (F.col(self.source).cast("bigint") * 1000).alias("timestamp_ns"), F.col("local_timestamp").cast("bigint").alias("local_us"), _flag(F.col("is_snapshot")).alias("snap"),
            F.when(side == "bid", 1).when(side == "ask", -1).otherwise(F.raise_error(F.concat(F.lit("invalid side: "), side)).cast("int")).alias("side"), price_to_ticks(F.col("price"), self.tick).alias("price_ticks"), _scaled(F.col("amount"), self.multiplier).alias("amount"),
        )
        b = lagged(b, KEY, ["row"], F.struct("snap", "local_us", "timestamp_ns"), "_last", "row", BUCKET)
        late = (F.col("_last.local_us") > F.col("local_us")) | (F.col("_last.timestamp_ns") > F.col("timestamp_ns"))
        b = b.withColumns({"edge": F.col("snap") & ~F.coalesce("_last.snap", F.lit(False)), "late": F.coalesce(late, F.lit(False))}).drop("_last")
        b = running_sum(b, KEY, "row", F.col("edge").cast("int"), "epoch").where("epoch > 0")
        level = Window.partitionBy(*LEVEL, "epoch").orderBy("row")
        return b.withColumn("change", F.col("amount") - F.coalesce(F.lag("amount").over(level), F.lit(0)))

    def problems(self, levels: DataFrame) -> DataFrame:
        """exchange, symbol, row and problem, of every row of levels() that breaks a rule: time that regresses, a level that a snapshot names twice, and sides that meet when a local time is over.

        One pass: a fold reads each epoch once, in order. Within one local time sides may meet, as a message may come in several rows.
        """
        rows = lagged(levels, KEY, ["row"], F.col("local_us"), "_next", "row", BUCKET, ahead=True)
        rows = rows.select(*KEY, "epoch", "row", "side", "price_ticks", "amount", "snap", "edge", "late", (~F.col("_next").eqNullSafe(F.col("local_us"))).alias("closes"))
        return rows.repartition(*KEY, "epoch").sortWithinPartitions(*KEY, "epoch", "row").mapInArrow(_problems, "exchange string, symbol string, row bigint, problem string")

    def check(self, levels: DataFrame) -> None:
        """Raises the first problem by row, and where there is no snapshot."""
        for r in self.problems(levels).orderBy("row", "symbol", "problem").limit(1).collect():
            raise AdapterError(f"{r.problem} at row {r.row} of {r.symbol}")
        if levels.isEmpty():
            raise AdapterError("no snapshot")

    def check_instruments(self, book: DataFrame, trades: DataFrame | None = None, single: bool = False) -> None:
        """Raises on more than one instrument, where one is wanted, on trades of an instrument without a book, and on trades whose times regress."""
        names = book.select(*KEY).distinct()
        if single and len(found := names.orderBy(*KEY).limit(2).collect()) > 1:
            raise AdapterError("several instruments: " + ", ".join(f"{r.exchange} {r.symbol}" for r in found))
        if trades is None:
            return
        for r in trades.select(*KEY).distinct().join(names, KEY, "left_anti").orderBy(*KEY).limit(1).collect():
            raise AdapterError(f"trades of {r.exchange} {r.symbol}, which has no book")
        times = trades.select(*KEY, "row", F.col("local_timestamp").cast("bigint").alias("local_us"), F.col(self.source).cast("bigint").alias("us"))
        times = lagged(times, KEY, ["row"], F.struct("local_us", "us"), "_last", "row", BUCKET)
        for r in times.where("_last.local_us > local_us or _last.us > us").orderBy("row").limit(1).collect():
            raise AdapterError(f"trade timestamps regress at row {r.row} of {r.symbol}")

    def trades(self, trades: DataFrame) -> DataFrame:
        """Trades with the passive side they hit; unknown sides are left out."""
        side = F.lower(F.trim("side"))
        t = trades.where(side != "unknown")
        return t.select(*KEY, "row", (F.col(self.source).cast("bigint") * 1000).alias("timestamp_ns"), F.when(side == "buy", -1).when(side == "sell", 1).otherwise(F.raise_error(F.concat(F.lit("invalid trade side: "), side)).cast("int")).alias("side"), price_to_ticks(F.col("price"), self.tick).alias("price_ticks"), _scaled(F.col("amount"), self.multiplier).alias("quantity"))

    def matched(self, reductions: DataFrame, trades: DataFrame, ordered: bool = False) -> DataFrame:
        """Per reduction row the quantity that trades take from it, where they take some.

        The budget is shared in trade order, so a level is a sequence; levels are independent, and so are stretches of one
        level that lie further apart than the window. A level is streamed by time; ordered: the times of trades are known not to regress
        by row, so that no more than about the window is held, else a stretch is. What is empty is skipped at once: the time is that
        of the sort, however many rows the window holds.
        """
        window = self.window
        both = reductions.select(*LEVEL, "timestamp_ns", F.lit(0).alias("kind"), "row", "quantity").unionByName(trades.select(*LEVEL, "timestamp_ns", F.lit(1).alias("kind"), "row", "quantity"))

        def share(batches):
            return _shares(batches, window, ordered)

        return both.repartition(*LEVEL).sortWithinPartitions(*LEVEL, "timestamp_ns", "kind", "row").mapInArrow(share, "exchange string, symbol string, row bigint, matched bigint")

    def to_canonical(self, book: DataFrame, trades: DataFrame | None = None, check: bool = True, single: bool = False) -> DataFrame:
        """exchange, symbol and the canonical columns, numbered per symbol. single: raises on more than one instrument."""
        levels = self.levels(book)
        if check:
            levels = written(levels)
            self.check_instruments(book, trades, single)
            self.check(levels)
        qty = F.when(F.col("snap"), F.col("amount")).otherwise(F.abs("change"))
        rows = levels.withColumn("qty", qty)
        if trades is None:
            rows = rows.withColumn("matched", F.lit(0).cast("bigint"))
        else:
            red = rows.where("not snap and change < 0").select(*LEVEL, "row", "timestamp_ns", F.col("qty").alias("quantity"))
            rows = rows.join(self.matched(red, self.trades(trades), ordered=check), [*KEY, "row"], "left").fillna(0, ["matched"])
        event = lambda kind, q, n, level=True: F.struct(F.lit(n).alias("n"), F.lit(kind).alias("event_type"), (F.col("side") if level else F.lit(None)).cast("tinyint").alias("side"), (F.col("price_ticks") if level else F.lit(0)).cast("bigint").alias("price_ticks"), q.cast("bigint").alias("quantity"))
        events = F.array(
            F.when(F.col("edge"), event("RESET", F.lit(0), 0, False)),
            F.when(F.col("snap") & (F.col("qty") > 0), event("SNAPSHOT", F.col("qty"), 1)),
            F.when(~F.col("snap") & (F.col("change") > 0), event("ADD", F.col("qty"), 1)),
            F.when(~F.col("snap") & (F.col("change") < 0) & (F.col("matched") > 0), event("TRADE", F.col("matched"), 1)),
            F.when(~F.col("snap") & (F.col("change") < 0) & (F.col("qty") > F.col("matched")), event("CANCEL", F.col("qty") - F.col("matched"), 2)),
        )
        e = rows.select(*KEY, "row", "timestamp_ns", F.explode(F.filter(events, lambda x: x.isNotNull())).alias("e")).select(*KEY, "row", "timestamp_ns", "e.*")
        e = numbered(e, KEY, ["row", "n"], "sequence_number", "row", BUCKET)
        return e.select(*KEY, "timestamp_ns", "sequence_number", "event_type", "side", "price_ticks", "quantity")

    def diagnostics(self, book: DataFrame, trades: DataFrame | None = None) -> dict[str, int]:
        """Counters of what was skipped, matched and left over; absent counters are 0."""
        levels = self.levels(book)
        row = levels.agg(F.count("*").alias("rows"), F.count_if(F.col("snap") & (F.col("amount") > 0)).alias("snapshot_levels"), F.count_if(F.col("snap") & (F.col("amount") == 0)).alias("zero_snapshot_levels_skipped"), F.count_if(~F.col("snap") & (F.col("change") > 0)).alias("add_events"), F.count_if(~F.col("snap") & (F.col("change") == 0)).alias("unchanged_book_rows_skipped")).first().asDict()
        row["pre_snapshot_rows_skipped"] = book.count() - row.pop("rows")
        if trades is not None:
            red = levels.where("not snap and change < 0").select(*LEVEL, "row", "timestamp_ns", F.abs("change").alias("quantity"))
            known = self.trades(trades)
            row["matched_trade_quantity"] = self.matched(red, known).agg(F.coalesce(F.sum("matched"), F.lit(0))).first()[0]
            row["unmatched_trade_quantity"] = known.agg(F.coalesce(F.sum("quantity"), F.lit(0))).first()[0] - row["matched_trade_quantity"]
            row["unknown_side_trades_skipped"] = trades.where(F.lower(F.trim("side")) == "unknown").count()
        return row
