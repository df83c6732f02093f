"""What an adapter of a vendor's files is."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame

from ..schema import coerce


class Adapter(ABC):
    """Turns a vendor's frames into canonical events. Subclasses name themselves and say how; checked() enforces the schema."""

    name: str = ""

    @abstractmethod
    def to_canonical(self, *frames: DataFrame, **options) -> DataFrame: ...

    def checked(self, *frames: DataFrame, keys: tuple[str, ...] = (), **options) -> DataFrame:
        return coerce(self.to_canonical(*frames, **options), keys=keys)
