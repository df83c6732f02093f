"""Prices, ticks, quotes and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_to_ticks(price: Column, tick: str, strict: bool = True) -> Column:
    """A decimal price in ticks: exact, or half-even where strict is off."""
    p, t = price.cast("decimal(30,12)"), F.lit(tick).cast("decimal(18,12)")
    if strict:
        return F.when(p % t != 0, F.raise_error(F.concat(F.lit("price off tick: "), price.cast("string")))).otherwise(F.round(p / t)).cast("bigint")
    return F.bround(p / t, 0).cast("bigint")


def floor_price_to_ticks(price: Column, tick: str) -> Column:
    return F.floor(price.cast("decimal(30,12)") / F.lit(tick).cast("decimal(18,12)")).cast("bigint")


def ticks_to_price(ticks: Column, tick: str) -> Column:
    return ticks.cast("decimal(20,0)") * F.lit(tick).cast("decimal(18,12)")


def rounded_quotes(center: Column, half: Column) -> tuple[Column, Column]:
    """Bid rounded down and ask up; an ask that would not stand above the bid goes one tick above it."""
    bid, ask = F.floor(center - half).cast("bigint"), F.ceil(center + half).cast("bigint")
    return bid, F.when(bid >= ask, bid + 1).otherwise(ask)


def tapered_quantity(base: int, inventory: Column, limit: int) -> Column:
    """Order size that shrinks to a quarter as inventory nears its limit."""
    if limit <= 0:
        return F.lit(base).cast("bigint")
    used = F.least(F.lit(1.0), F.abs(inventory).cast("double") / F.lit(float(limit)))
    return F.greatest(F.lit(1), F.floor(F.lit(float(base)) * (1.0 - 0.75 * used)).cast("bigint"))


def microprice_quotes(microprice: Column, imbalance: Column, inventory: Column, volatility: Column, limit: int, base_half: float, minimum_half: float, imbalance_ticks: float, penalty_ticks: float, volatility_multiplier: float, size: int) -> dict[str, Column]:
    """bid_ticks, ask_ticks and quantity of a quote around the microprice: moved by imbalance and against inventory, as wide as volatility asks but never below the
    minimum half spread, smaller as inventory nears its limit, and on one side alone where the limit is reached."""
    used = inventory.cast("double") / F.lit(float(limit)) if limit else F.lit(0.0)
    center = microprice + F.lit(imbalance_ticks) * F.coalesce(imbalance, F.lit(0.0)) - F.lit(penalty_ticks) * used
    half = F.greatest(F.lit(minimum_half), F.lit(base_half) + F.lit(volatility_multiplier) * volatility)
    bid, ask = rounded_quotes(center, half)
    return {"bid_ticks": F.when(inventory < limit, bid), "ask_ticks": F.when(inventory > -limit, ask), "quantity": tapered_quantity(size, inventory, limit)}


def costs(quantity: Column, price_ticks: Column, role: Column, tick: str, maker_fee: str, maker_rebate: str, taker_fee: str, proportional: str) -> tuple[Column, Column]:
    """(fee, rebate): per unit by liquidity role, plus a proportional fee on the notional."""
    d = lambda x: F.lit(x).cast("decimal(12,6)")
    q = quantity.cast("decimal(14,0)")
    notional = q * price_ticks.cast("decimal(14,0)") * d(tick)
    maker = role == "maker"
    fee = (F.when(maker, d(maker_fee)).otherwise(d(taker_fee)) * q).cast("decimal(32,12)") + (notional * d(proportional)).cast("decimal(32,12)")
    return fee, F.when(maker, d(maker_rebate) * q).otherwise(d("0") * q).cast("decimal(32,12)")


def horizon_label(ns: Column) -> Column:
    """1s, 250ms or 5ns."""
    return F.when(ns % 1_000_000_000 == 0, F.concat((ns / 1_000_000_000).cast("bigint").cast("string"), F.lit("s"))).when(ns % 1_000_000 == 0, F.concat((ns / 1_000_000).cast("bigint").cast("string"), F.lit("ms"))).otherwise(F.concat(ns.cast("string"), F.lit("ns")))
