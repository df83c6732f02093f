"""Order-book replay: levels, top of book and depth after every event.

A RESET clears both sides, so every epoch between two RESETs is replayed on its own. Within an epoch the quantity of a
level that is clamped at zero has a closed form over prefix sums. The best quotes after each event come either from the
relational form (an interval join of events with levels) or from a fold that streams each epoch once; both give the
same rows, the fold in linear time.

Rows that add quantity at a price that meets the other side are ignored, which couples the sides: a closed form can't tell
them. Only in epochs whose highest bid ever reaches their lowest ask can there be any, and the fold marks them there first.

A long epoch is folded in parts of SEAM sequence numbers, side by side. A part starts from the levels that the closed form
gives at its first event, as if no add before it were ignored. The folds then tell the adds that are, the closed form is taken
again without them, and the parts whose start it changes are folded again, until none is. A first part starts right, and where
nothing changes every part started from what the parts before it make of theirs, so by induction all are as a serial fold has them.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ADD, ASK, BID, RESET, SNAPSHOT
from ..sources.shared import observed, written
from .running import BUCKET, running_sum

LEVEL = ["symbol", "epoch", "side", "price_ticks"]
LAST = 9223372036854775807
#: Sequence numbers of a part, the largest piece of an epoch that one task folds.
SEAM = 1 << 18
PART = ["symbol", "epoch", "part"]
#: The event type of rows that stand for the levels at a part's start.
STANDS = "_STANDS"


class BookError(ValueError):
    """A change that a strict book does not take."""


class CrossedBookError(BookError):
    """Quantity added at a price that meets the other side."""


class InsufficientDepthError(BookError):
    """A reduction of more than stands at its level."""


def with_epochs(events: DataFrame, width: int = BUCKET) -> DataFrame:
    """events with epoch: how many RESETs of the symbol have come, this event included. Written once, as all forms of the book read it several times."""
    numbered = running_sum(events, ["symbol"], "sequence_number", F.when(F.col("event_type") == RESET, 1).otherwise(0), "epoch", width)
    return written(numbered, last=F.max("sequence_number"), first=F.min("sequence_number"), bid=F.max(_added(BID)), ask=F.min(_added(ASK)))


def _added(side: int) -> Column:
    return F.when(F.col("event_type").isin(ADD, SNAPSHOT) & (F.col("side") == side), F.col("price_ticks"))


def _spans(events: DataFrame, width: int) -> DataFrame:
    """Per epoch: its first and last part, the highest bid and the lowest ask it ever adds."""
    part = F.floor(F.col("sequence_number") / F.lit(width)).cast("bigint")
    return events.groupBy("symbol", "epoch").agg(F.min(part).alias("first"), F.max(part).alias("last"), F.max(_added(BID)).alias("bid"), F.min(_added(ASK)).alias("ask"))


def _reach(events: DataFrame, width: int) -> tuple[bool, bool]:
    """Whether any epoch may cross, and whether any has several parts. Where the bounds of the whole table rule both out, no epoch is looked at."""
    all_ = observed(events)
    if all_ and (all_["bid"] is None or all_["ask"] is None or all_["bid"] < all_["ask"]) and (all_["last"] is None or all_["first"] // width == all_["last"] // width):
        return False, False
    r = _spans(events, width).agg(F.max((F.col("bid") >= F.col("ask")).cast("int")).alias("c"), F.max((F.col("first") < F.col("last")).cast("int")).alias("n")).first()
    return bool(r.c), bool(r.n)


def _parted(events: DataFrame, spans: DataFrame, width: int) -> DataFrame:
    """events of the epochs of spans with part and last_part, the epoch's."""
    part = F.floor(F.col("sequence_number") / F.lit(width)).cast("bigint")
    return events.withColumn("part", part).join(spans.select("symbol", "epoch", F.col("last").alias("last_part")), ["symbol", "epoch"])


def seam_levels(events: DataFrame) -> DataFrame:
    """The levels that stand before the first event of each part but an epoch's first: symbol, epoch, part, side, price_ticks and quantity.

    events has part, last_part and add_ignored. In a part a level's sum t and smallest prefix sum m turn q into max(q + t, t - m'),
    m' = min(0, m); over the parts that touch a level this is again a prefix sum less its smallest value. A level stands from the
    part after one that touches it up to the next that does.
    """
    moves = events.where(F.col("event_type") != RESET)
    moved = F.when(F.col("add_ignored"), 0).when(F.col("event_type").isin(ADD, SNAPSHOT), F.col("quantity")).otherwise(-F.col("quantity"))
    inside = Window.partitionBy(*LEVEL, "part").orderBy("sequence_number").rowsBetween(Window.unboundedPreceding, 0)
    sums = moves.withColumn("_d", moved).withColumn("_s", F.sum("_d").over(inside)).groupBy(*LEVEL, "part", "last_part").agg(F.sum("_d").alias("_t"), F.min("_s").alias("_m"))
    over = Window.partitionBy(*LEVEL).orderBy("part")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_all", F.sum("_t").over(upto)).withColumn("_low", F.min(F.col("_all") - F.col("_t") + F.col("_m")).over(upto))
    sums = sums.withColumns({"quantity": F.col("_all") - F.least(F.lit(0), F.col("_low")), "_next": F.coalesce(F.lead("part").over(over), F.col("last_part"))})
    stands = sums.where("quantity > 0 and part < _next")
    return stands.select("symbol", "epoch", F.explode(F.sequence(F.col("part") + 1, "_next")).alias("part"), "side", "price_ticks", F.col("quantity").cast("bigint").alias("quantity"))


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """The parts whose starting levels differ."""
    key = [*PART, "side", "price_ticks"]
    both = before.withColumnRenamed("quantity", "_q").join(after, key, "full").where(~F.col("_q").eqNullSafe(F.col("quantity")))
    return both.select(*PART).distinct()


def _marks(events: DataFrame, several: bool) -> DataFrame:
    """The ignored adds (symbol, epoch, part, sequence_number) of events with part and last_part; several: whether any epoch has several parts."""
    found = lambda rows, levels: _replayed(rows.drop("last_part"), levels).where("add_ignored").select(*PART, "sequence_number")
    if not several:
        return written(found(events, None))
    starts = written(seam_levels(events.withColumn("add_ignored", F.lit(False))))
    marks = written(found(events, starts))
    while True:
        known = marks.select("symbol", "sequence_number", F.lit(True).alias("add_ignored"))
        now = written(seam_levels(events.join(known, ["symbol", "sequence_number"], "left").withColumn("add_ignored", F.coalesce("add_ignored", F.lit(False)))))
        again = written(_changed(starts, now))
        if again.isEmpty():
            return marks
        more = found(events.join(again, PART, "left_semi"), now.join(again, PART, "left_semi"))
        starts, marks = now, written(marks.join(again, PART, "left_anti").unionByName(more))


def crossing(events: DataFrame, width: int = SEAM, reach: tuple[bool, bool] | None = None) -> DataFrame:
    """events with add_ignored: whether the row adds quantity at a price that meets the other side, and so takes no effect.

    The fold reads only epochs whose highest bid reaches their lowest ask; elsewhere nothing can cross. Where there are none, that
    is found out at once, and events are read no further.
    """
    crosses, several = reach or _reach(events, width)
    if not crosses:
        return events.withColumn("add_ignored", F.lit(False))
    names = ["symbol", "epoch", "event_type", "side", "price_ticks", "quantity", "sequence_number"]
    marks = _marks(written(_parted(events.select(*names), _spans(events, width).where("bid >= ask"), width)), several)
    known = marks.select("symbol", "sequence_number", F.lit(True).alias("add_ignored"))
    return events.join(known, ["symbol", "sequence_number"], "left").select(*events.columns, F.coalesce("add_ignored", F.lit(False)).alias("add_ignored"))


def _starts(events: DataFrame, width: int, reach: tuple[bool, bool] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """events with part, and the levels at the starts of parts; one part an epoch and None where no epoch has several."""
    reach = reach or _reach(events, width)
    if not reach[1]:
        return events.withColumn("part", F.lit(0).cast("bigint")), None
    marked = events if "add_ignored" in events.columns else crossing(events, width, reach)
    marked = _parted(marked, _spans(events, width).where("first < last"), width)
    return events.withColumn("part", F.floor(F.col("sequence_number") / F.lit(width)).cast("bigint")), written(seam_levels(marked))


def level_changes(events: DataFrame, width: int = SEAM) -> DataFrame:
    """Every non-RESET event with qty_before, qty_after, qty_applied and clamped of its level, under the lenient rule.

    qty_after = S - min(0, smallest S so far), S being the prefix sum of signed quantities; adds that would cross count 0. In epochs
    of several parts S begins with what stands at the part's start.
    """
    reach = _reach(events, width)
    rows, starts = _starts(crossing(events, width, reach), width, reach)
    moves = rows.where(F.col("event_type") != RESET)
    zero = F.lit(0).cast("bigint")
    if starts is None:
        moves = moves.withColumn("_q", zero)
    else:
        moves = moves.join(starts.withColumnRenamed("quantity", "_q"), [*PART, "side", "price_ticks"], "left").withColumn("_q", F.coalesce("_q", zero))
    grows = F.col("event_type").isin(ADD, SNAPSHOT)
    ignored = F.col("add_ignored")
    order = Window.partitionBy(*LEVEL, "part").orderBy("sequence_number")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    moves = moves.withColumn("_s", F.col("_q") + F.sum(F.when(ignored, 0).when(grows, F.col("quantity")).otherwise(-F.col("quantity"))).over(upto))
    moves = moves.withColumn("qty_after", F.col("_s") - F.least(F.lit(0), F.min("_s").over(upto)))
    moves = moves.withColumn("qty_before", F.coalesce(F.lag("qty_after").over(order), F.col("_q")))
    applied = F.when(ignored, zero).when(grows, F.col("quantity")).otherwise(F.least("quantity", "qty_before"))
    changes = {"qty_applied": applied, "clamped": ignored | ~grows & (F.col("quantity") > F.col("qty_before"))}
    return moves.withColumns(changes).select(*events.columns, "add_ignored", "qty_after", "qty_before", "qty_applied", "clamped")


def strict(events: DataFrame) -> DataFrame:
    """events, if a strict book takes all of them; else the first that it does not take is raised, before anything is derived."""
    bad = level_changes(events).where("clamped").orderBy("timestamp_ns", "symbol", "sequence_number").limit(1).collect()
    for r in bad:
        where = f"event {r.sequence_number} of symbol {r.symbol}: {r.event_type} of {r.quantity} at side {r.side}, price {r.price_ticks}"
        raise CrossedBookError(f"{where} would cross") if r.add_ignored else InsufficientDepthError(f"{where}, where {r.qty_before} stands")
    return events


def snapshot(levels: DataFrame) -> DataFrame:
    """Rows that replace the whole book of each symbol: a RESET and a SNAPSHOT row for each level, bids first, the best first.

    levels has symbol, timestamp_ns, sequence_number (of the RESET; the levels take the next ones), side, price_ticks and
    quantity; a row without side clears the book. A price twice on a side, a quantity that isn't positive, or sides that
    meet are raised before any row is made, so that no part of a bad snapshot takes effect.
    """
    key = ["symbol", "sequence_number"]
    at = lambda side, f: f(F.when(F.col("side") == side, F.col("price_ticks")))
    known = levels.where("side is not null")
    per_price = known.groupBy(*key, "side", "price_ticks").agg(F.count("*").alias("n"), F.min("quantity").alias("q"))
    books = per_price.groupBy(*key).agg(F.max("n").alias("n"), F.min("q").alias("q"), at(BID, F.max).alias("b"), at(ASK, F.min).alias("a"))
    for r in books.where("n > 1 or q is null or q <= 0 or b >= a").orderBy(*key).limit(1).collect():
        where = f"snapshot {r.sequence_number} of symbol {r.symbol}"
        if r.n > 1:
            raise BookError(f"{where}: duplicate price")
        if r.q is None or r.q <= 0:
            raise BookError(f"{where}: quantities must be positive")
        raise CrossedBookError(f"{where}: best bid {r.b}, best ask {r.a}")
    order = Window.partitionBy(*key).orderBy(F.desc("side"), F.desc(F.col("price_ticks") * F.col("side")))
    rows = known.withColumns({"sequence_number": F.col("sequence_number") + F.row_number().over(order), "event_type": F.lit(SNAPSHOT)})
    zero = F.lit(0).cast("bigint")
    resets = levels.groupBy(*key).agg(F.min("timestamp_ns").alias("timestamp_ns")).withColumns({"event_type": F.lit(RESET), "side": F.lit(None).cast("tinyint"), "price_ticks": zero, "quantity": zero})
    names = ["symbol", "timestamp_ns", "sequence_number", "event_type", "side", "price_ticks", "quantity"]
    return resets.select(*names).unionByName(rows.withColumn("side", F.col("side").cast("tinyint")).select(*names))


def level_intervals(events: DataFrame) -> DataFrame:
    """Levels with the sequence numbers [sequence_number, seq_to) during which they hold qty_after > 0."""
    order = Window.partitionBy(*LEVEL).orderBy("sequence_number")
    lv = level_changes(events).select(*LEVEL, "sequence_number", "qty_after")
    return lv.withColumn("seq_to", F.lead("sequence_number", 1, LAST).over(order)).where(F.col("qty_after") > 0)


def book_deltas(events: DataFrame) -> DataFrame:
    """Every event with before, applied, after, clamped; a RESET's before and applied are all that it clears."""
    lv = level_changes(events)
    ends = lv.groupBy(*LEVEL).agg(F.max_by("qty_after", "sequence_number").alias("q")).groupBy("symbol", (F.col("epoch") + 1).alias("epoch")).agg(F.sum("q").alias("total"))
    resets = events.where(F.col("event_type") == RESET).join(ends, ["symbol", "epoch"], "left")
    total = F.coalesce("total", F.lit(0)).cast("bigint")
    names = ["symbol", "sequence_number", "event_type"]
    return lv.select(*names, F.col("qty_before").alias("before"), F.col("qty_applied").alias("applied"), F.col("qty_after").alias("after"), "clamped").unionByName(
        resets.select(*names, total.alias("before"), total.alias("applied"), F.lit(0).cast("bigint").alias("after"), F.lit(False).alias("clamped"))
    )


def standing_levels(events: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Every event (or those of at) with each level that stands after it: side, level_price, level_qty."""
    e = (at if at is not None else events).select("symbol", "epoch", F.col("sequence_number").alias("seq"))
    lv = level_intervals(events).withColumnsRenamed({"price_ticks": "level_price", "qty_after": "level_qty"})
    inside = (lv["sequence_number"] <= e["seq"]) & (e["seq"] < lv["seq_to"])
    return e.join(lv, (e["symbol"] == lv["symbol"]) & (e["epoch"] == lv["epoch"]) & inside).select(e["symbol"], e["epoch"], "seq", "side", "level_price", "level_qty")


BBO = "best_bid_ticks bigint, best_bid_quantity bigint, best_ask_ticks bigint, best_ask_quantity bigint"


def bbo_relational(events: DataFrame) -> DataFrame:
    """Best bid and ask with their quantities after every event, by an interval join; quantities are 0 where a side is empty."""
    st = standing_levels(events)
    bid, ask = F.when(F.col("side") == BID, F.col("level_price")), F.when(F.col("side") == ASK, F.col("level_price"))
    best = st.groupBy("symbol", F.col("seq").alias("sequence_number")).agg(F.max(bid).alias("best_bid_ticks"), F.max_by("level_qty", bid).alias("best_bid_quantity"), F.min(ask).alias("best_ask_ticks"), F.min_by("level_qty", ask).alias("best_ask_quantity"))
    out = events.join(best, ["symbol", "sequence_number"], "left")
    return out.withColumns({c: F.coalesce(F.when(F.col(p).isNull(), 0).otherwise(F.col(c)), F.lit(0)).cast("bigint") for c, p in (("best_bid_quantity", "best_bid_ticks"), ("best_ask_quantity", "best_ask_ticks"))})


def _fold(batches: Iterator) -> Iterator:
    """Streams rows ordered by symbol, epoch, part and sequence number, a part's starting levels first; holds one batch and one book."""
    import pyarrow as pa

    now = None
    for batch in batches:
        symbol, epoch, part, kind, side, price, qty = (batch.column(i).to_pylist() for i in range(7))
        out = [[] for _ in range(4)]
        bb, bq, ba, aq = out
        ignored, events = [], []
        for k in range(batch.num_rows):
            if now != (symbol[k], epoch[k], part[k]):
                now = (symbol[k], epoch[k], part[k])
                books = {BID: {}, ASK: {}}
                heaps: dict[int, list[int]] = {BID: [], ASK: []}
            t = kind[k]
            if t == STANDS:
                books[side[k]][price[k]] = qty[k]
                heapq.heappush(heaps[side[k]], -price[k] * side[k])
                continue
            events.append(k)
            crosses = False
            if t != RESET:
                s, p = side[k], price[k]
                book = books[s]
                have = book.get(p, 0)
                grows = t in (ADD, SNAPSHOT)
                crosses = grows and bool(heaps[-s]) and p * s >= heaps[-s][0]  # the other side's best, as its heap was cleaned below
                left = have if crosses else have + qty[k] if grows else have - qty[k]
                if left > 0:
                    if not have:
                        heapq.heappush(heaps[s], -p * s)
                    book[p] = left
                elif have:
                    del book[p]
            ignored.append(crosses)
            for s, prices, sizes in ((BID, bb, bq), (ASK, ba, aq)):
                heap, book = heaps[s], books[s]
                while heap and -heap[0] * s not in book:
                    heapq.heappop(heap)
                if heap:
                    p = -heap[0] * s
                    prices.append(p)
                    sizes.append(book[p])
                else:
                    prices.append(None)
                    sizes.append(0)
        names = [*batch.schema.names, "best_bid_ticks", "best_bid_quantity", "best_ask_ticks", "best_ask_quantity", "add_ignored"]
        columns = batch.columns if len(events) == batch.num_rows else [c.take(pa.array(events, pa.int64())) for c in batch.columns]
        yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, pa.int64()) for x in out], pa.array(ignored, pa.bool_())], names)


_LEAD = [*PART, "event_type", "side", "price_ticks", "quantity", "sequence_number"]


def _dealt(events: DataFrame, starts: DataFrame | None) -> DataFrame:
    """Rows for a fold: each part in one task, in order, after the levels it starts with."""
    rows = events.select(*_LEAD, *[c for c in events.columns if c not in _LEAD])
    if starts is not None:
        kinds = {f.name: f.dataType for f in rows.schema.fields}
        levels = starts.withColumns({"event_type": F.lit(STANDS), "sequence_number": F.lit(-1)})
        rows = rows.unionByName(levels.select(*[F.col(c).cast(kinds[c]).alias(c) for c in _LEAD]), allowMissingColumns=True)
    return rows.repartition(*PART).sortWithinPartitions(*PART, "sequence_number")


def _replayed(events: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """events (with part) with the top of book after each and add_ignored, by a fold over each part."""
    ordered = _dealt(events, starts)
    schema = T.StructType([*ordered.schema.fields, *T._parse_datatype_string(BBO + ", add_ignored boolean").fields])
    return ordered.mapInArrow(_fold, schema)


def bbo(events: DataFrame, width: int = SEAM) -> DataFrame:
    """Best bid and ask with their quantities after every event, by a fold over each part of each epoch."""
    return _replayed(*_starts(events, width)).select(*events.columns, *[f.split()[0] for f in BBO.split(", ")])


def top_features() -> dict[str, Column]:
    """Spread, midpoint, microprice and imbalance of the top of book; null where a side is empty."""
    b, a, qb, qa = (F.col(c) for c in ("best_bid_ticks", "best_ask_ticks", "best_bid_quantity", "best_ask_quantity"))
    both = b.isNotNull() & a.isNotNull()
    total = F.nullif((qb + qa).cast("double"), F.lit(0.0))
    return {
        "spread_ticks": a - b,
        "midpoint_ticks": (b + a) / F.lit(2.0),
        "microprice_ticks": F.when(both, (a * qb + b * qa).cast("double") / total),
        "imbalance": F.when(both, (qb - qa).cast("double") / total),
        "is_crossed": F.coalesce(b >= a, F.lit(False)),
    }


def market(events: DataFrame, width: int = SEAM) -> DataFrame:
    """The market table: every event with its epoch, top of book and features."""
    return bbo(with_epochs(events), width).withColumns(top_features())


def _ladder(n: int | None, covers: int | None):
    """A fold like _fold that gives each event's best levels of both sides: the first n, or as many as cover a quantity."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        now = None
        names = ["symbol", "sequence_number", "side", "rank", "price_ticks", "quantity"]
        for batch in batches:
            symbol, epoch, part, kind, side, price, qty = (batch.column(i).to_pylist() for i in range(7))
            row, sides, ranks, prices, sizes = ([] for _ in range(5))
            for k in range(batch.num_rows):
                if now != (symbol[k], epoch[k], part[k]):
                    now = (symbol[k], epoch[k], part[k])
                    books: dict[int, dict[int, int]] = {BID: {}, ASK: {}}
                    ladders: dict[int, list[int]] = {BID: [], ASK: []}  # -price * side, ascending: the best first
                if kind[k] == STANDS:
                    books[side[k]][price[k]] = qty[k]
                    insort(ladders[side[k]], -price[k] * side[k])
                    continue
                if kind[k] != RESET:
                    s, p = side[k], price[k]
                    book, ladder = books[s], ladders[s]
                    have = book.get(p, 0)
                    grows = kind[k] in (ADD, SNAPSHOT)
                    crosses = grows and bool(ladders[-s]) and p * s >= ladders[-s][0]
                    left = have if crosses else have + qty[k] if grows else have - qty[k]
                    if left > 0:
                        if not have:
                            insort(ladder, -p * s)
                        book[p] = left
                    elif have:
                        del book[p], ladder[bisect_left(ladder, -p * s)]
                for s in (BID, ASK):
                    before = 0
                    for r, x in enumerate(ladders[s]):
                        if n is not None and r >= n or covers is not None and before >= covers:
                            break
                        q = books[s][-x * s]
                        row.append(k)
                        sides.append(s)
                        ranks.append(r + 1)
                        prices.append(-x * s)
                        sizes.append(q)
                        before += q
            at = pa.array(row, pa.int64())
            rest = [pa.array(ranks, pa.int64()), pa.array(prices, pa.int64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(7).take(at), pa.array(sides, batch.column(4).type), *rest], names)

    return run


def ladder(events: DataFrame, n: int | None = None, covers: int | None = None, width: int = SEAM) -> DataFrame:
    """The best levels of each side after every event, rank from 1, by a fold over each part of each epoch: the first n, or as many as cover a quantity."""
    rows, starts = _starts(events, width)
    ordered = _dealt(rows.select(*_LEAD), starts)
    f = {x.name: x for x in ordered.schema.fields}
    schema = T.StructType([f["symbol"], f["sequence_number"], f["side"], *T._parse_datatype_string("rank bigint, price_ticks bigint, quantity bigint").fields])
    return ordered.mapInArrow(_ladder(n, covers), schema)


def top_n(events: DataFrame, n: int, at: DataFrame | None = None) -> DataFrame:
    """The n best levels of each side after every event (or, by an interval join, those of at), rank from 1."""
    if at is None:
        return ladder(events, n)
    best = Window.partitionBy("symbol", "seq", "side").orderBy(F.desc(F.col("level_price") * F.col("side")))
    return standing_levels(events, at).withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= n).select("symbol", F.col("seq").alias("sequence_number"), "side", "rank", F.col("level_price").alias("price_ticks"), F.col("level_qty").alias("quantity"))


def weighted_imbalance(events: DataFrame, depth: int = 5, at: DataFrame | None = None) -> DataFrame:
    """Imbalance of both sides' quantities weighted by 1/rank; null if a side is empty."""
    w = F.col("quantity").cast("double") / F.col("rank")
    sums = top_n(events, depth, at).groupBy("symbol", "sequence_number").agg(F.sum(F.when(F.col("side") == BID, w)).alias("b"), F.sum(F.when(F.col("side") == ASK, w)).alias("a"))
    return sums.select("symbol", "sequence_number", ((F.col("b") - F.col("a")) / (F.col("b") + F.col("a"))).alias("weighted_imbalance"))


def views(events: DataFrame, depth: int = 5) -> DataFrame:
    """The market after every event with bids and asks: arrays of (price_ticks, quantity), the best first, at most depth."""
    best = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "price_ticks", "quantity")))), lambda x: F.struct(x["price_ticks"].alias("price_ticks"), x["quantity"].alias("quantity")))
    sides = top_n(events, depth).groupBy("symbol", "sequence_number").agg(best(BID).alias("bids"), best(ASK).alias("asks"))
    out = bbo(events).withColumns(top_features()).join(sides, ["symbol", "sequence_number"], "left")
    none = F.lit([]).cast("array<struct<price_ticks:bigint,quantity:bigint>>")
    return out.withColumns({"bids": F.coalesce("bids", none), "asks": F.coalesce("asks", none)})


def level_maps(events: DataFrame) -> DataFrame:
    """The book of each symbol after its last event: bids and asks as maps from price to quantity, and n_levels, how many there are.

    Maps are made of entries sorted by price: books are equal if their entries are.
    """
    last = events.groupBy("symbol").agg(F.max("epoch").alias("epoch"))
    now = level_intervals(events.join(last, ["symbol", "epoch"], "left_semi").select(*events.columns)).where(F.col("seq_to") == LAST)
    levels = lambda side: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("price_ticks", "qty_after")))))
    maps = now.groupBy("symbol").agg(levels(BID).alias("bids"), levels(ASK).alias("asks"), F.count("*").alias("n_levels"))
    none = F.create_map().cast("map<bigint,bigint>")
    out = last.select("symbol").join(maps, "symbol", "left")
    return out.select("symbol", F.coalesce("bids", none).alias("bids"), F.coalesce("asks", none).alias("asks"), F.coalesce("n_levels", F.lit(0)).alias("n_levels"))


def same_books(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every symbol of two frames of level_maps with same: whether both have it, with equal sides."""
    a, b = (x.select("symbol", *[F.array_sort(F.map_entries(c)).alias(c) for c in ("bids", "asks")]) for x in (left, right))
    a, b = a.withColumnsRenamed({"bids": "b1", "asks": "a1"}), b.withColumnsRenamed({"bids": "b2", "asks": "a2"})
    return a.join(b, "symbol", "full").select("symbol", F.coalesce((F.col("b1") == F.col("b2")) & (F.col("a1") == F.col("a2")), F.lit(False)).alias("same"))


def quantity_at(events: DataFrame, points: DataFrame) -> DataFrame:
    """points (symbol, seq, side, price_ticks) with the quantity that stands there after event seq; 0 if none."""
    lv = level_intervals(events)
    p = points.join(events.select("symbol", F.col("sequence_number").alias("seq"), "epoch"), ["symbol", "seq"])
    hit = p.join(lv.withColumnsRenamed({"symbol": "s2", "epoch": "e2", "side": "d2", "price_ticks": "p2"}), (F.col("symbol") == F.col("s2")) & (F.col("epoch") == F.col("e2")) & (F.col("side") == F.col("d2")) & (F.col("price_ticks") == F.col("p2")) & (F.col("sequence_number") <= F.col("seq")) & (F.col("seq") < F.col("seq_to")), "left")
    return hit.select("symbol", "seq", "side", "price_ticks", F.coalesce("qty_after", F.lit(0)).cast("bigint").alias("quantity"))


def sweep(levels: DataFrame, group: list[str], quantity: Column, best_first: list[Column]) -> DataFrame:
    """levels (with quantity) with taken: what an order of the given quantity takes from each level, best first."""
    upto = Window.partitionBy(*group).orderBy(*best_first).rowsBetween(Window.unboundedPreceding, 0)
    before = F.sum("quantity").over(upto) - F.col("quantity")
    return levels.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("quantity"), quantity - before)).cast("bigint"))
