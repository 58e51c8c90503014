"""Timestamp parsing and printing; everything is UTC."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import text as tx

_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"T\d{2}:\d{2}:\d{2}(\.\d+)?"
_ZONE = r"(Z|[+-]\d{2}:\d{2})"


def parse_time(raw: Column) -> Column:
    """Zoned ISO text, naive ISO text or a plain day; null for anything else."""
    value = tx.trim(raw)
    zoned = (
        F.when(F.rlike(value, F.lit(f"^{_DAY}{_CLOCK}{_ZONE}$")), value)
        .when(F.rlike(value, F.lit(f"^{_DAY}{_CLOCK}$")), F.concat(value, F.lit("Z")))
        .when(F.rlike(value, F.lit(f"^{_DAY}$")), F.concat(value, F.lit("T00:00:00Z")))
    )
    return zoned.try_cast("timestamp")


def parse_vote_time(raw: Column) -> Column:
    """Like ``parse_time`` but naive date-times are refused."""
    value = tx.trim(raw)
    zoned = F.when(F.rlike(value, F.lit(f"^{_DAY}{_CLOCK}{_ZONE}$")), value).when(
        F.rlike(value, F.lit(f"^{_DAY}$")), F.concat(value, F.lit("T00:00:00Z"))
    )
    return zoned.try_cast("timestamp")


def utc_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def moment(as_of: datetime | str | None) -> Column:
    """The query's notion of now; always pass one where results must repeat."""
    if as_of is None:
        as_of = datetime.now(timezone.utc)
    if isinstance(as_of, datetime):
        as_of = as_of.astimezone(timezone.utc).isoformat() if as_of.tzinfo else as_of.isoformat() + "Z"
    return F.lit(as_of).cast("timestamp")


def vote_status(vote_date: Column, as_of: Column) -> Column:
    return F.when(vote_date > as_of, "upcoming").otherwise("past")
