"""Queue positions at a price as relations: segments (level, seg, own, quantity) in queue order."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def allocate(segments: DataFrame, budget: Column, order: list[Column], out: str, group: list[str] | None = None) -> DataFrame:
    """segments with out: what a shared budget takes from each, in the given order."""
    upto = Window.partitionBy(*(group or ["level"])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("quantity").over(upto) - F.col("quantity")
    return segments.withColumn(out, F.greatest(F.lit(0), F.least(F.col("quantity"), budget - before)).cast("bigint"))


def trade_budget(segments: DataFrame, budget: Column) -> DataFrame:
    """First in, first out: every segment of the level, own or external, shares one trade."""
    return allocate(segments, budget, [F.col("seg")], "consumed")


def cancel_front(segments: DataFrame, quantity: Column) -> DataFrame:
    return allocate(segments.where(~F.col("own")), quantity, [F.col("seg")], "cancelled")


def cancel_back(segments: DataFrame, quantity: Column) -> DataFrame:
    return allocate(segments.where(~F.col("own")), quantity, [F.desc("seg")], "cancelled")


def cancel_pro_rata(segments: DataFrame, quantity: Column) -> DataFrame:
    """Integer shares of the external quantity; what is left over goes by largest remainder, then by segment."""
    level = Window.partitionBy("level")
    s = segments.where(~F.col("own")).withColumn("_total", F.sum("quantity").over(level)).withColumn("_c", F.least(quantity, F.col("_total")))
    s = s.withColumn("_base", F.expr("(_c * quantity) div _total")).withColumn("_rem", F.expr("(_c * quantity) % _total"))
    extra = F.row_number().over(level.orderBy(F.desc("_rem"), "seg")) <= F.col("_c") - F.sum("_base").over(level)
    return s.withColumn("cancelled", (F.col("_base") + F.when(extra, 1).otherwise(0)).cast("bigint")).drop("_total", "_c", "_base", "_rem")


def positions(segments: DataFrame) -> DataFrame:
    """Own segments with external and own quantity ahead and external quantity behind."""
    order = Window.partitionBy("level").orderBy("seg")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    ext, own = F.when(~F.col("own"), F.col("quantity")).otherwise(0), F.when(F.col("own"), F.col("quantity")).otherwise(0)
    total = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0)).cast("bigint")
    return segments.withColumns({"external_ahead": total(ext, before), "own_ahead": total(own, before), "external_behind": total(ext, after)}).where("own").select("level", "seg", "quantity", "external_ahead", "own_ahead", "external_behind")


def price_through(orders: DataFrame, trades: DataFrame) -> DataFrame:
    """Own orders at better prices than a trade on their side, which it fills whole, best first; both by symbol and epoch."""
    o, t = orders.alias("o"), trades.alias("t")
    better = F.col("o.price_ticks") * F.col("o.side") > F.col("t.price_ticks") * F.col("t.side")
    return o.join(t, (F.col("o.symbol") == F.col("t.symbol")) & (F.col("o.epoch") == F.col("t.epoch")) & (F.col("o.side") == F.col("t.side")) & better)


def _through(batches):
    """Streams rows ordered by symbol, epoch and sequence number; a trade takes all open orders at better prices off a heap."""
    import pyarrow as pa

    names = ["symbol", "order_seq", "quantity", "trade_seq"]
    now = None
    for batch in batches:
        symbol, epoch, kind, side, price, qty, seq = (batch.column(i).to_pylist() for i in range(7))
        out = []
        for k in range(batch.num_rows):
            if now != (symbol[k], epoch[k]):
                now = (symbol[k], epoch[k])
                open_: dict[int, list[tuple[int, int, int]]] = {1: [], -1: []}
            if kind[k] == "ADD":
                heapq.heappush(open_[side[k]], (-price[k] * side[k], seq[k], qty[k]))
            elif kind[k] == "TRADE":
                heap = open_[side[k]]
                while heap and -heap[0][0] > price[k] * side[k]:
                    _, n, q = heapq.heappop(heap)
                    out.append((symbol[k], n, q, seq[k]))
        columns = list(zip(*out)) or [[]] * 4
        types = [batch.column(0).type, *[pa.int64()] * 3]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def first_through(events: DataFrame) -> DataFrame:
    """Every ADD as an order, with the first later trade of its epoch and side that goes through its price; by a fold, in linear memory."""
    ordered = events.where("event_type in ('ADD', 'TRADE')").select("symbol", "epoch", "event_type", "side", "price_ticks", F.col("quantity").cast("bigint").alias("quantity"), "sequence_number").repartition("symbol", "epoch").sortWithinPartitions("symbol", "epoch", "sequence_number")
    return ordered.mapInArrow(_through, f"symbol {ordered.schema['symbol'].dataType.simpleString()}, order_seq bigint, quantity bigint, trade_seq bigint")


def reconcile(segments: DataFrame, displayed: DataFrame) -> DataFrame:
    """Per level: external quantity of the overlay less what the book displays."""
    ours = segments.groupBy("level").agg(F.sum(F.when(~F.col("own"), F.col("quantity")).otherwise(0)).alias("external"), F.sum(F.when(F.col("own"), F.col("quantity")).otherwise(0)).alias("own"))
    return ours.join(displayed, "level", "left").withColumn("difference", F.col("external") - F.coalesce("displayed", F.lit(0)))
