"""Where a data set comes from, and what such a statement must hold."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import asdict, dataclass


class ProvenanceError(ValueError):
    """A statement of origin that contradicts itself or leaves out what it must say."""


@dataclass(frozen=True)
class Provenance:
    """source_type is synthetic or historical; the form in which data are stored says nothing about it."""

    source_type: str
    provider: str
    venue: str
    symbol: str
    dataset_id: str
    license_notes: str
    session_start: dt.date | None = None
    session_end: dt.date | None = None
    checksum_sha256: str | None = None

    def __post_init__(self):
        for name in ("provider", "venue", "symbol", "dataset_id", "license_notes"):
            object.__setattr__(self, name, getattr(self, name).strip())
        if self.checksum_sha256 is not None:
            object.__setattr__(self, "checksum_sha256", self.checksum_sha256.strip().lower())
        dates = (self.session_start, self.session_end)
        recorded = self.source_type == "historical"
        rules = (
            (self.source_type in ("synthetic", "historical"), "source_type must be synthetic or historical"),
            (all((self.provider, self.venue, self.symbol, self.dataset_id, self.license_notes)), "text fields can't be blank"),
            (self.checksum_sha256 is None or re.fullmatch("[0-9a-f]{64}", self.checksum_sha256), "checksum_sha256 must have 64 hexadecimal digits"),
            (None in dates or dates[0] <= dates[1], "the session ends before it starts"),
            (not recorded or None not in dates, "historical data need the dates of their session"),
            (not recorded or self.checksum_sha256, "historical data need a checksum"),
            (not recorded or self.venue.upper() != "SIMULATED", "historical data have no simulated venue"),
            (not recorded or "synthetic" not in self.provider.casefold(), "historical data have no synthetic provider"),
        )
        for holds, what in rules:
            if not holds:
                raise ProvenanceError(what)

    @property
    def synthetic_demonstration(self) -> bool:
        return self.source_type == "synthetic"

    def record(self) -> dict:
        """The statement as manifests and runs carry it: text, numbers and nulls alone."""
        plain = {k: v.isoformat() if isinstance(v, dt.date) else v for k, v in asdict(self).items()}
        return plain | {"synthetic_demonstration": self.synthetic_demonstration}
