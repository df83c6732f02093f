"""Checks of tables, declared as values and compiled to one aggregation a table; what they find are counts of breaches, as rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ArtifactError(ValueError):
    """Artifacts that do not belong together."""


@dataclass(frozen=True)
class Check:
    """One of: each (SQL that every row must fulfil; null is a breach), unique (columns that name a row), rows (how many there are), present (columns that must exist)."""

    name: str
    each: str | None = None
    unique: tuple[str, ...] = ()
    rows: int | None = None
    present: tuple[str, ...] = ()
    needs: tuple[str, ...] = ()

    def breaches(self, df: DataFrame) -> Column:
        missing = [c for c in (*self.present, *self.unique, *self.needs) if c not in df.columns]
        if missing:
            return F.lit(len(missing) if self.present else 1).cast("bigint") + F.lit(0) * F.count("*")
        if self.present:
            return F.lit(0).cast("bigint") * F.count("*")
        if self.unique:
            every = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.unique], *[F.col(c).isNull() for c in self.unique])  # null is a name like others
            return F.count("*") - F.count_distinct(every)
        if self.rows is not None:
            return F.abs(F.count("*") - F.lit(self.rows))
        return F.count_if(~F.coalesce(F.expr(self.each), F.lit(False)))


def breaches(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """table, check and breaches, a row for each check, from one pass over df. Columns that a check needs are looked up before anything is planned."""
    one = df.agg(*[c.breaches(df).alias(f"b{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(table).alias("table"), F.lit(c.name).alias("check"), F.col(f"b{i}").cast("bigint").alias("breaches")) for i, c in enumerate(checks)])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def require(found: DataFrame) -> None:
    """Raises with the first breaches, by table and check."""
    bad = found.where("breaches > 0").orderBy("table", "check").limit(5).collect()
    if bad:
        raise ArtifactError("; ".join(f"{r.table}: {r.check} ({r.breaches})" for r in bad))


def experiment_checks(event_count: int, case_count: int, synthetic: bool) -> list[Check]:
    """What the table of an experiment must be, given its manifest and the runs that it stands beside."""
    return [
        Check("required columns", present=("run_name", "events_processed", "synthetic_demonstration", "strategy", "queue_allocation")),
        Check("run_name is a name", each="typeof(run_name) = 'string' and run_name <> ''", needs=("run_name",)),
        Check("run_name is unique", unique=("run_name",)),
        Check("events_processed is the runs'", each=f"events_processed = {event_count}", needs=("events_processed",)),
        Check("classification is the runs'", each=f"synthetic_demonstration = {str(synthetic).lower()}", needs=("synthetic_demonstration",)),
        Check("case_count is the number of rows", rows=case_count),
    ]


def manifest_errors(manifest: dict, event_sha256: str, event_count: int, synthetic: bool) -> list[str]:
    """What an experiment's manifest says otherwise than the runs beside it."""
    whole = lambda x: type(x) is int  # noqa: E731  a bool is none
    found = []
    if manifest.get("event_stream_sha256") != event_sha256:
        found.append("experiment and runs use different event streams")
    if not whole(manifest.get("event_count")) or manifest["event_count"] != event_count:
        found.append("event_count does not match the runs")
    if manifest.get("synthetic_demonstration") is not synthetic:
        found.append("classification does not match the runs")
    if not whole(manifest.get("case_count")) or manifest["case_count"] <= 0:
        found.append("case_count must be a positive whole number")
    return found
