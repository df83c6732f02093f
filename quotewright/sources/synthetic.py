"""Deterministic synthetic event streams, one per (symbol, seed), made in parallel.

A stream is a chain: each draw depends on the book that the draws before it left, so one stream is one task and streams
are what runs side by side. The order of the random draws is part of the result; equal seeds give equal streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ADD, ASK, BID, CANCEL, RESET, SNAPSHOT, TRADE

#: Fixed values of the three regimes, in turn: how far prices move, the spread, the chance that a trade hits the ask, and
#: the pressure (0 none, -1 sellers, 1 buyers).
REGIMES = ((1, 1, 0.50, 0), (2, 2, 0.25, -1), (4, 4, 0.75, 1))
#: Chances of an ADD, and of an ADD or CANCEL; of an existing price; of a better price; of a full removal.
P_ADD, P_CANCEL, P_EXISTING, P_BETTER, P_WHOLE = 0.43, 0.72, 0.62, 0.35, 0.22
BATCH = 50_000


@dataclass(frozen=True)
class Settings:
    event_count: int = 6_000
    start_timestamp_ns: int = 0
    interval_ns: int = 1_000_000
    start_price_ticks: int = 10_000
    levels: int = 5
    base_quantity: int = 100
    regime_length: int = 500
    reset_interval: int = 1_000

    def __post_init__(self):
        if self.event_count < 1 + 2 * self.levels:
            raise ValueError(f"event_count must hold a snapshot of {self.levels} levels a side")
        if self.start_price_ticks <= self.levels + 5:
            raise ValueError("start_price_ticks leaves no room for the levels")


class _Stream:
    """The chain: a book of two price maps, a random source, and a queue of events not yet handed out."""

    def __init__(self, settings: Settings, seed: int):
        if seed < 0:
            raise ValueError("seed must not be negative")
        self.s, self.draw = settings, np.random.default_rng(seed)
        self.book: dict[int, dict[int, int]] = {BID: {}, ASK: {}}
        self.n, self.time, self.center, self.since, self.regime_then = 0, settings.start_timestamp_ns, settings.start_price_ticks, 0, -1

    def chance(self, p: float) -> bool:
        return float(self.draw.random()) < p

    def whole(self, low: int, high: int) -> int:
        """Uniform in [low, high]."""
        return int(self.draw.integers(low, high + 1))

    def best(self, side: int) -> int:
        return max(self.book[BID]) if side == BID else min(self.book[ASK])

    def event(self, kind: str, side: int | None = None, price: int = 0, quantity: int = 0) -> tuple:
        if kind == RESET:
            self.book = {BID: {}, ASK: {}}
        else:
            held = self.book[side]
            left = held.get(price, 0) + (quantity if kind in (ADD, SNAPSHOT) else -quantity)
            if left:
                held[price] = left
            else:
                del held[price]
        row = (self.time, self.n, kind, side, price, quantity)
        self.n += 1
        self.since += 1
        return row

    def size(self, level: int, side: int, pressure: int) -> int:
        """A displayed quantity: more with depth, more on the side under pressure, with jitter."""
        base = self.s.base_quantity
        lean = 1.0 if not pressure else 1.20 if pressure == side else 0.80
        jitter = max(2, base // 5)
        j = self.whole(-jitter, jitter)
        return max(1, round((base + level * max(1, base // 10)) * lean) + j)

    def snapshot(self, regime: tuple, first: bool) -> Iterator[tuple]:
        reach, spread, _, pressure = regime
        at = self.n // self.s.regime_length
        if not first:
            self.center = max(self.s.levels + 5, self.center + self.whole(-reach, reach) + (pressure * reach or 1))
        yield self.event(RESET)
        top = {BID: self.center - spread // 2}
        top[ASK] = top[BID] + spread
        for level in range(self.s.levels):
            sizes = {side: self.size(level, side, pressure) for side in (BID, ASK)}
            for side in (BID, ASK):
                yield self.event(SNAPSHOT, side, top[side] - side * level, sizes[side])
        self.since, self.regime_then = 0, at

    def repaired(self, regime: tuple) -> tuple | None:
        """An ADD that narrows a wide spread, or else refills a thin side."""
        reach, spread, _, pressure = regime
        bid, ask = self.best(BID), self.best(ASK)
        if ask - bid > spread + reach:
            side = pressure or (BID if self.chance(0.5) else ASK)
            price = ask - spread if side == BID else bid + spread
            return self.event(ADD, side, price, self.size(0, side, pressure))
        lack = {side: self.s.levels - len(self.book[side]) for side in (BID, ASK)}
        if max(lack.values()) <= 0:
            return None
        if lack[BID] == lack[ASK]:
            side = BID if self.chance(0.5) else ASK
        else:
            side = max(lack, key=lack.get)
        price = min(self.book[BID]) - 1 if side == BID else max(self.book[ASK]) + 1
        if price <= 0:
            return None
        return self.event(ADD, side, price, self.size(self.s.levels - 1, side, pressure))

    def added(self, pressure: int) -> tuple:
        side = BID if self.chance({1: 0.65, -1: 0.35, 0: 0.50}[pressure]) else ASK
        prices = list(self.book[side])  # in the order they came
        if prices and self.chance(P_EXISTING):
            price = prices[self.whole(0, len(prices) - 1)]
        else:
            bid, ask = self.best(BID), self.best(ASK)
            if ask - bid > 1 and self.chance(P_BETTER):
                price = bid + 1 if side == BID else ask - 1
            else:
                away = self.whole(0, self.s.levels + 1)
                price = max(1, bid - away) if side == BID else ask + away
        return self.event(ADD, side, price, self.whole(1, max(3, self.s.base_quantity // 2)))

    def reduced(self, kind: str, regime: tuple) -> tuple:
        """A TRADE at the best price or a CANCEL anywhere; a side's last lot is never taken."""
        _, _, hits_ask, pressure = regime
        if kind == TRADE:
            side = ASK if self.chance(hits_ask) else BID
        else:
            side = BID if self.chance({1: 0.65, -1: 0.35, 0: 0.50}[pressure]) else ASK
        held = self.book[side]
        price = self.best(side) if kind == TRADE else list(held)[self.whole(0, len(held) - 1)]
        most = held[price] - (len(held) == 1)
        if most <= 0:
            return self.added(pressure)
        return self.event(kind, side, price, most if len(held) > 1 and self.chance(P_WHOLE) else self.whole(1, most))

    def __iter__(self) -> Iterator[tuple]:
        s = self.s
        yield from self.snapshot(REGIMES[0], True)
        while self.n < s.event_count:
            self.time += s.interval_ns
            at = self.n // s.regime_length
            regime = REGIMES[at % len(REGIMES)]
            if s.event_count - self.n >= 1 + 2 * s.levels and (at != self.regime_then or self.since >= s.reset_interval):
                yield from self.snapshot(regime, False)
                continue
            row = self.repaired(regime)
            if row is None:
                u = float(self.draw.random())
                row = self.added(regime[3]) if u < P_ADD else self.reduced(CANCEL if u < P_CANCEL else TRADE, regime)
            yield row


def stream(settings: Settings, seed: int) -> Iterator[tuple]:
    """Canonical rows of one stream."""
    return iter(_Stream(settings, seed))


def synthetic_events(spark: SparkSession, settings: Settings, seeds: list[int]) -> DataFrame:
    """symbol (0, 1, ...) and the canonical columns of one stream per seed; a task makes a stream and hands it on in batches."""
    many = spark.createDataFrame(list(enumerate(seeds)), "symbol bigint, seed bigint").repartition(max(1, len(seeds)), "symbol")
    names = ["symbol", "timestamp_ns", "sequence_number", "event_type", "side", "price_ticks", "quantity"]

    def run(batches: Iterator) -> Iterator:
        from itertools import islice

        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int8(), pa.int64(), pa.int64()]
        for batch in batches:
            for symbol, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = stream(settings, seed)
                while part := list(islice(rows, BATCH)):
                    cols = [[symbol] * len(part), *map(list, zip(*part))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return many.mapInArrow(run, "symbol bigint, timestamp_ns bigint, sequence_number bigint, event_type string, side tinyint, price_ticks bigint, quantity bigint").select(*[F.col(c) for c in names])
