"""Message and order-book files paired row by row, as canonical events.

Messages (no header): seconds after midnight, type 1 to 7, order id, size, price in ten-thousandths (type 7: halt code),
direction (1 or -1). Book rows: ask price, ask size, bid price, bid size per level; size 0 marks a level that is not
there. Row i of the book is the state after message i.

Outside halts the state before a message is the last processed row's book, so nothing is recursive: levels of
consecutive processed rows meet in a full outer join; what the message explains becomes its event, the rest is
reconciled, cancels first. Both files' cells compress to almost nothing, so their size says little about their rows: joins of
rows with rows are sort-merge joins, never broadcasts.
"""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quotes import price_to_ticks
from ..operators.running import BUCKET, carried, lagged, numbered
from .adapter import Adapter
from .incremental import AdapterError, _scaled
from .shared import written


class PairedAdapter(Adapter):
    name = "paired"

    def __init__(self, tick_size: str, trading_date: str | dt.date, levels: int | None = None, timezone: str = "America/New_York", price_scale: int = 10_000, quantity_multiplier: int = 1):
        day = trading_date if isinstance(trading_date, dt.date) else dt.date.fromisoformat(trading_date)
        zone = ZoneInfo(timezone) if isinstance(timezone, str) else timezone
        self.midnight_ns = int(dt.datetime(day.year, day.month, day.day, tzinfo=zone).timestamp()) * 10**9
        self.tick, self.levels, self.scale, self.multiplier = tick_size, levels, price_scale, quantity_multiplier

    def _ticks(self, c):
        return price_to_ticks(c.cast("decimal(24,6)") / F.lit(self.scale).cast("decimal(8,0)"), self.tick)

    def messages(self, messages: DataFrame) -> DataFrame:
        """row, timestamp_ns, code, raw price cell, quantity and direction, in file order."""
        names = [c for c in messages.columns if c != "row"]
        if len(names) != 6:
            raise AdapterError("messages need six columns")
        t, code, _, size, price, direction = (F.col(c) for c in names)
        seconds = t.cast("decimal(20,9)")
        ns = F.when((seconds < 0) | (seconds >= 86_400), F.raise_error(F.concat(F.lit("time outside the day: "), t.cast("string"))).cast("bigint")).otherwise((seconds * 1_000_000_000).cast("bigint"))
        return messages.select("row", (ns + self.midnight_ns).alias("timestamp_ns"), code.cast("int").alias("code"), size.alias("size"), price.alias("price"), direction.cast("int").alias("direction"))

    def book_levels(self, book: DataFrame) -> DataFrame:
        """row, side, price_ticks, quantity of every level that is there."""
        names = [c for c in book.columns if c != "row"]
        n = self.levels or len(names) // 4
        if len(names) < 4 * n or len(names) % 4:
            raise AdapterError(f"the book needs 4 columns for each of {n} levels")
        cells = [F.struct(F.lit(s).alias("side"), F.col(names[4 * i + k]).alias("price"), F.col(names[4 * i + k + 1]).alias("size")) for i in range(n) for s, k in ((-1, 0), (1, 2))]
        long = book.select("row", F.explode(F.array(*cells)).alias("c")).select("row", "c.*").where(F.col("size").cast("decimal(30,12)") > 0)
        return long.select("row", "side", self._ticks(F.col("price")).alias("price_ticks"), _scaled(F.col("size"), self.multiplier).alias("quantity"))

    def book_problems(self, book: DataFrame) -> DataFrame:
        """row and problem of book rows that name a level twice, whose levels aren't in order of price, or whose sides meet; a row is looked at by itself."""
        names = [c for c in book.columns if c != "row"]
        n = self.levels or len(names) // 4
        there = lambda k: F.filter(F.array(*[F.struct(F.col(names[4 * i + k]).alias("price"), F.col(names[4 * i + k + 1]).cast("decimal(30,12)").alias("size")) for i in range(n)]), lambda x: x["size"] > 0)
        rows = book.select("row", *[F.transform(there(k), lambda x: self._ticks(x["price"])).alias(side) for side, k in (("asks", 0), ("bids", 2))])
        twice = lambda side: F.size(F.array_distinct(side)) < F.size(side)
        problem = F.when(twice("asks") | twice("bids"), "a book row names a level twice").when((F.col("asks") != F.sort_array("asks")) | (F.col("bids") != F.sort_array("bids", False)), "levels of a book row are out of order")
        return rows.select("row", problem.when(F.get("bids", F.lit(0)) >= F.get("asks", F.lit(0)), "a book row is crossed").alias("problem")).where("problem is not null")

    def states(self, messages: DataFrame) -> DataFrame:
        """messages() with file (one value), halt, halted_before, first and late: what the rows before a message say, in buckets of rows."""
        m = self.messages(messages).withColumns({"file": F.expr("row div 1099511627776"), "halt": F.when(F.col("code") == 7, F.col("price").cast("int"))})  # rows of a file lie below 2**40
        m = lagged(m, ["file"], ["row"], F.struct(F.when(F.col("halt").isNotNull(), F.col("halt") == -1).alias("stop"), "timestamp_ns"), "_p", "row", BUCKET)
        m = carried(m, ["file"], ["row"], F.col("_p.stop"), "_stop", "row", BUCKET)
        return m.withColumns({"halted_before": F.coalesce("_stop", F.lit(False)), "first": F.col("_p").isNull(), "late": F.coalesce(F.col("_p.timestamp_ns") > F.col("timestamp_ns"), F.lit(False))}).drop("_p", "_stop")

    def to_canonical(self, messages: DataFrame, book: DataFrame) -> DataFrame:
        heights = [d.agg(F.count("*"), F.count_distinct("row"), F.min("row"), F.max("row")).first() for d in (messages, book)]
        if heights[0] != heights[1] or heights[0][0] != heights[0][1]:
            raise AdapterError(f"messages and book must have the same rows, each once: {heights[0][0]} and {heights[1][0]} rows")
        for r in self.book_problems(book).orderBy("row").limit(1).collect():
            raise AdapterError(f"{r.problem} (row {r.row})")
        m, lv = written(self.states(messages)), self.book_levels(book)
        if not m.where("late or code not between 1 and 7 or (code = 7 and halt not in (-1, 0, 1))").isEmpty():
            raise AdapterError("messages regress in time or have an unknown type or halt code")
        stops = m.where("halt = -1 and not halted_before")
        starts = m.where("(first and code <> 7) or (halt in (0, 1) and halted_before)")
        steps = m.where("code <> 7 and not first and not halted_before")
        live = lagged(starts.select("file", "row").union(steps.select("file", "row")), ["file"], ["row"], F.col("row"), "before", "row", BUCKET).select("row", "before")
        steps = steps.join(live.hint("merge"), "row")
        after = steps.select("row", "before").join(lv.hint("merge"), "row").select("row", "side", "price_ticks", F.col("quantity").alias("qa"))
        prior = steps.select(F.col("row").alias("now"), F.col("before").alias("row")).join(lv.hint("merge"), "row").select(F.col("now").alias("row"), "side", "price_ticks", F.col("quantity").alias("qb"))
        d = prior.join(after.hint("merge"), ["row", "side", "price_ticks"], "full").fillna(0, ["qa", "qb"])
        visible = steps.where("code between 1 and 4").select("row", "code", F.col("direction").alias("side"), self._ticks(F.col("price")).alias("price_ticks"), _scaled(F.col("size"), self.multiplier).alias("q"))
        d = d.join(visible.hint("merge"), ["row", "side", "price_ticks"], "left").withColumn("change", F.col("qa") - F.col("qb"))
        cause = F.when(F.col("code").isNull(), 0).when(F.col("code") == 1, F.least("q", F.greatest("change", F.lit(0)))).otherwise(-F.least("q", F.greatest(-F.col("change"), F.lit(0))))  # least() skips nulls
        d = d.withColumn("cause", cause).withColumn("rest", F.col("change") - F.col("cause"))
        kind = F.when(F.col("cause") > 0, "ADD").when(F.col("code") == 4, "TRADE").otherwise("CANCEL")
        e = lambda stage, k, q: F.struct(F.lit(stage).alias("stage"), k.alias("event_type"), F.abs(q).cast("bigint").alias("quantity"))
        parts = F.array(F.when(F.col("cause") != 0, e(1, kind, F.col("cause"))), F.when(F.col("rest") < 0, e(2, F.lit("CANCEL"), F.col("rest"))), F.when(F.col("rest") > 0, e(3, F.lit("ADD"), F.col("rest"))))
        moves = d.select("row", "side", "price_ticks", F.explode(F.filter(parts, lambda x: x.isNotNull())).alias("e")).select("row", "side", "price_ticks", "e.*")
        full = starts.select("row").join(lv.hint("merge"), "row").select("row", "side", "price_ticks", F.lit(1).alias("stage"), F.lit("SNAPSHOT").alias("event_type"), "quantity")
        resets = stops.select("row").union(starts.select("row")).select("row", F.lit(None).cast("int").alias("side"), F.lit(0).cast("bigint").alias("price_ticks"), F.lit(0).alias("stage"), F.lit("RESET").alias("event_type"), F.lit(0).cast("bigint").alias("quantity"))
        out = moves.unionByName(full).unionByName(resets).join(m.select("row", "timestamp_ns").hint("merge"), "row")
        out = numbered(out.withColumn("file", F.expr("row div 1099511627776")), ["file"], ["row", "stage", F.desc(F.coalesce("side", F.lit(2))), -F.col("price_ticks") * F.coalesce("side", F.lit(1))], "sequence_number", "row", BUCKET)
        return out.select("timestamp_ns", "sequence_number", "event_type", F.col("side").cast("tinyint").alias("side"), "price_ticks", "quantity")

    def diagnostics(self, messages: DataFrame, book: DataFrame) -> dict[str, int]:
        """Counters of what messages lead to no event of their own; absent counters are 0. One pass over the messages, and a join of the visible ones with their levels."""
        m = written(self.states(messages))
        n = lambda cond: F.count_if(F.expr(cond))
        open_ = "not first and not halted_before"
        found = m.agg(
            F.count("*").alias("source_rows"), n("first and code <> 7").alias("first_message_represented_by_snapshot"), n("code <> 7 and halted_before").alias("messages_while_halted_skipped"), n("halt = -1 and not halted_before").alias("halt_resets"),
            n("halt in (0, 1) and halted_before").alias("halt_resumes"), n("halt in (0, 1) and not halted_before").alias("redundant_halt_resume_indicators"), n(f"code = 5 and {open_}").alias("hidden_executions_not_emitted"), n(f"code = 6 and {open_}").alias("cross_trades_not_emitted"),
        ).first().asDict()
        lv = self.book_levels(book)
        live = lagged(m.where(f"(first and code <> 7) or (halt in (0, 1) and halted_before) or (code <> 7 and {open_})"), ["file"], ["row"], F.col("row"), "before", "row", BUCKET)
        seen = live.where(f"code between 1 and 4 and {open_}").select("row", "before", "code", F.col("direction").alias("side"), self._ticks(F.col("price")).alias("price_ticks"), _scaled(F.col("size"), self.multiplier).alias("q"))
        seen = seen.join(lv.withColumnRenamed("quantity", "qa").hint("merge"), ["row", "side", "price_ticks"], "left").join(lv.select(F.col("row").alias("before"), "side", "price_ticks", F.col("quantity").alias("qb")).hint("merge"), ["before", "side", "price_ticks"], "left").fillna(0, ["qa", "qb"])
        moved = F.greatest(F.lit(0), F.least("q", F.when(F.col("code") == 1, F.col("qa") - F.col("qb")).otherwise(F.col("qb") - F.col("qa"))))
        more = seen.select(moved.alias("moved"), "q").agg(F.count_if(F.col("moved") == 0).alias("messages_outside_visible_depth"), F.coalesce(F.sum(F.when((F.col("moved") > 0) & (F.col("moved") < F.col("q")), F.col("q") - F.col("moved"))), F.lit(0)).alias("partially_visible_message_quantity"))
        return found | more.first().asDict()
