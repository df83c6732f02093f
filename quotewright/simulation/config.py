"""Settings of a simulated run, with the defaults of the data model."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass, replace

ALLOCATIONS = ("back_of_queue", "front_of_queue", "pro_rata")
STRATEGIES = ("fixed_spread", "inventory_aware", "microprice")


class ConfigError(ValueError):
    """Settings that are unknown or contradict each other."""


@dataclass(frozen=True)
class Latency:
    market_data_ns: int = 0
    market_data_jitter_ns: int = 0
    order_entry_ns: int = 0
    order_entry_jitter_ns: int = 0
    cancellation_ns: int = 0
    cancellation_jitter_ns: int = 0
    fill_report_ns: int = 0
    fill_report_jitter_ns: int = 0


@dataclass(frozen=True)
class Venue:
    tick_size: str = "0.01"
    lot_size: int = 1
    rest_unfilled_marketable_quantity: bool = True
    cancel_orders_on_reset: bool = True
    cancellation_allocation: str = "back_of_queue"
    price_through_fills: bool = True


@dataclass(frozen=True)
class Fees:
    maker_fee_per_unit: str = "0"
    maker_rebate_per_unit: str = "0"
    taker_fee_per_unit: str = "0"
    proportional_fee_rate: str = "0"


@dataclass(frozen=True)
class Quoting:
    name: str = "fixed_spread"
    strategy_id: str = "market-maker"
    order_size: int = 10
    base_half_spread_ticks: float = 1.0
    minimum_half_spread_ticks: float = 1.0
    inventory_penalty_ticks: float = 2.0
    imbalance_coefficient_ticks: float = 1.0
    volatility_multiplier: float = 1.0
    volatility_window: int = 50
    refresh_interval_ns: int = 50_000_000
    minimum_quote_lifetime_ns: int = 5_000_000
    stale_after_ns: int = 250_000_000
    price_change_threshold_ticks: int = 1
    quantity_change_threshold: int = 1
    rejection_cooldown_ns: int = 50_000_000
    rejection_backoff_multiplier: float = 2.0
    rejection_max_cooldown_ns: int = 1_000_000_000
    message_rate_cooldown_ns: int = 1_000_000_000
    post_only: bool = True


@dataclass(frozen=True)
class Limits:
    max_abs_inventory: int = 100
    max_order_size: int = 25
    max_total_open_quantity: int = 100
    max_open_orders: int = 4
    max_loss: str = "1000"
    max_drawdown: str = "1000"
    max_quote_age_ns: int = 500_000_000
    minimum_spread_ticks: int = 1
    max_volatility_ticks: float | None = None
    max_messages_per_second: int | None = None
    prohibit_new_quotes_last_ns: int = 0


@dataclass(frozen=True)
class Run:
    warmup_events: int = 50
    timer_interval_ns: int = 50_000_000
    mark_price: str = "midpoint"
    session_end_policy: str = "mark"


@dataclass(frozen=True)
class Config:
    latency: Latency = field(default_factory=Latency)
    venue: Venue = field(default_factory=Venue)
    fees: Fees = field(default_factory=Fees)
    quoting: Quoting = field(default_factory=Quoting)
    limits: Limits = field(default_factory=Limits)
    run: Run = field(default_factory=Run)
    random_seed: int = 7

    def __post_init__(self):
        checks = (
            (self.venue.cancellation_allocation in ALLOCATIONS, "unknown cancellation_allocation"),
            (self.quoting.name in STRATEGIES, "unknown strategy"),
            (self.run.mark_price in ("midpoint", "microprice", "conservative"), "unknown mark_price"),
            (self.run.session_end_policy in ("mark", "liquidate"), "unknown session_end_policy"),
            (self.run.timer_interval_ns > 0, "timer_interval_ns must be positive"),
            (self.quoting.rejection_max_cooldown_ns >= self.quoting.rejection_cooldown_ns, "the cooldown's cap lies below it"),
            (float(self.limits.max_loss) > 0 and float(self.limits.max_drawdown) > 0, "loss limits must be positive"),
            (all(float(v) >= 0 for v in asdict(self.fees).values()), "fees must not be negative"),
            (all(v >= 0 for v in asdict(self.latency).values()), "latencies must not be negative"),
        )
        for ok, what in checks:
            if not ok:
                raise ConfigError(what)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def with_(self, **sections: dict) -> Config:
        """A copy with some fields of some sections changed."""
        return replace(self, **{k: replace(getattr(self, k), **v) if isinstance(v, dict) else v for k, v in sections.items()})


def from_dict(d: dict) -> Config:
    """Settings from nested mappings; unknown names raise."""
    known = {f.name: f for f in fields(Config)}
    if extra := set(d) - set(known):
        raise ConfigError(f"unknown sections: {sorted(extra)}")
    made = {}
    for name, value in d.items():
        default = getattr(Config(), name)
        if is_dataclass(default):
            if extra := set(value) - {f.name for f in fields(default)}:
                raise ConfigError(f"unknown fields in {name}: {sorted(extra)}")
            value = type(default)(**value)
        made[name] = value
    return Config(**made)


def from_json(text: str) -> Config:
    return from_dict(json.loads(text))
