"""Row selection shared by many operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key.

    Written as ``row_number() <= k`` on purpose: Spark plans a
    WindowGroupLimit before the shuffle, so every map task sends at most ``k``
    rows per key and a key that holds a third of the table stays cheap.
    """
    name = rank or _RANK
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return ranked if rank else ranked.drop(_RANK)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """ORDER BY / LIMIT / OFFSET; Spark keeps only limit+offset rows per task."""
    ordered = df.orderBy(*order)
    return (ordered.offset(offset) if offset else ordered).limit(limit)
