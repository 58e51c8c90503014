"""Pages far into an ordered table without sorting the table.

``ORDER BY ... OFFSET n`` keeps ``n`` rows per task and sorts them all in one.
Here the range of sort keys that holds the page is narrowed first: a few sort
keys of a small sample serve as cuts, one pass counts the rows before each cut,
and the two cuts around the page bound the next round. Only the rows between
the last cuts are sorted. Cuts come from a sample, but counts are of all rows,
so the page is exact whatever was drawn.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Cuts of a round, sampled rows per cut, and the rows that may be sorted at once.
CUTS, PER_CUT, SORTABLE = 24, 8, 200_000

#: A sort key: a column and whether it descends. Nulls are smallest, as in Spark.
Key = tuple[str, bool]


@dataclass(frozen=True)
class Narrowed:
    """The rows between two cuts, how many they are and how many come before."""

    rows: DataFrame
    size: int
    skipped: int
    rounds: int


def sort_columns(keys: Sequence[Key]) -> list[Column]:
    return [F.desc(name) if descending else F.asc(name) for name, descending in keys]


def _ahead(name: str, descending: bool, value: Any) -> Column:
    """The row's value sorts strictly before ``value``."""
    column = F.col(name)
    if descending:
        return column.isNotNull() if value is None else F.coalesce(column > F.lit(value), F.lit(False))
    return F.lit(False) if value is None else F.coalesce(column < F.lit(value), F.lit(True))


def before(keys: Sequence[Key], cut: Row) -> Column:
    """The row sorts strictly before the cut, key by key."""
    terms, equal = [], F.lit(True)
    for (name, descending), value in zip(keys, cut):
        terms.append(equal & _ahead(name, descending, value))
        equal = equal & F.col(name).eqNullSafe(F.lit(value))
    return reduce(Column.__or__, terms)


def _bound(rows: DataFrame, key: Key, cut: Row, after: bool) -> Column:
    """What a cut says about the first key alone, in a form that scans take.

    Not for floating numbers: statistics of a file do not cover its NaN.
    """
    (name, descending), value = key, cut[0]
    if value is None or rows.schema[name].dataType.typeName() in ("float", "double"):
        return F.lit(True)
    column = F.col(name)
    if after != descending:
        return column >= F.lit(value)
    return (column <= F.lit(value)) | column.isNull()


def _cuts(rows: DataFrame, keys: Sequence[Key]) -> list[Row]:
    """Evenly spaced sort keys of at most ``CUTS * PER_CUT`` sampled rows."""
    drawn = rows.select(*[name for name, _ in keys]).orderBy(F.rand(11)).limit(CUTS * PER_CUT)
    found = drawn.orderBy(*sort_columns(keys)).collect()
    return list(dict.fromkeys(found[PER_CUT // 2 :: PER_CUT] or found[:1]))


def narrow(df: DataFrame, keys: Sequence[Key], first: int, last: int, sortable: int = SORTABLE) -> Narrowed:
    """The smallest range found that holds the places ``first`` up to ``last``
    (exclusive) of the order.

    Each round reads the key columns only and sends one row of counts to the
    driver. Rounds end at ``sortable`` rows, or when no cut divides what is
    left: the page itself is longer, or a run of equal keys is.
    """
    found = Narrowed(df, df.count(), 0, 0)
    while found.size > sortable and first < found.skipped + found.size:
        cuts = _cuts(found.rows, keys)
        sums = [F.sum(before(keys, cut).cast("long")) for cut in cuts]
        places = [(found.skipped + place, cut) for place, cut in zip(found.rows.agg(*sums).first(), cuts)]
        low = max((p for p in places if p[0] <= first), key=lambda p: p[0], default=None)
        high = min((p for p in places if p[0] >= last), key=lambda p: p[0], default=None)
        start = low[0] if low else found.skipped
        end = high[0] if high else found.skipped + found.size
        if end - start >= found.size:
            break
        rows = found.rows
        if low and start > found.skipped:
            rows = rows.filter(_bound(rows, keys[0], low[1], True)).filter(~before(keys, low[1]))
        if high:
            rows = rows.filter(_bound(rows, keys[0], high[1], False)).filter(before(keys, high[1]))
        found = Narrowed(rows, end - start, start, found.rounds + 1)
    return found


def deep_page(df: DataFrame, keys: Sequence[Key], limit: int, offset: int, sortable: int = SORTABLE) -> DataFrame:
    """Rows ``offset`` up to ``offset + limit`` of the order, as ``select.page``
    gives them; ties of all keys are in no order, as there.

    ``df`` is read once per round and once for the page: hand in a plan that is
    cheap to repeat, or a written table.
    """
    found = narrow(df, keys, offset, offset + limit, sortable)
    return found.rows.orderBy(*sort_columns(keys)).offset(max(offset - found.skipped, 0)).limit(limit)
