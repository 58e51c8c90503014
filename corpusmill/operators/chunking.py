"""Sliding-window chunking as expressions.

A document's windows have a closed form, so one ``explode`` over window
numbers is enough: no Python, no shuffle, and the work of a long document is
spread over its own output rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv
from corpusmill.functions import ids
from corpusmill.functions import text as tx


@dataclass(frozen=True)
class ChunkPlan:
    size: int = fv.CHUNK_SIZE
    overlap: float = fv.CHUNK_OVERLAP

    def __post_init__(self) -> None:
        low, high = fv.CHUNK_SIZE_RANGE
        if not low <= self.size <= high:
            raise ValueError(f"chunk size must be between {low} and {high} tokens")
        low, high = fv.CHUNK_OVERLAP_RANGE
        if not low <= self.overlap <= high:
            raise ValueError(f"chunk overlap must be between {low} and {high}")

    @property
    def step(self) -> int:
        return self.size - int(self.size * self.overlap)


def expected_chunks(token_count: Column, plan: ChunkPlan = ChunkPlan()) -> Column:
    """Number of windows for a token count, without touching the text."""
    beyond_first = F.greatest(F.lit(0), F.ceil((token_count - plan.size) / plan.step))
    return F.when(token_count <= 0, 0).otherwise(1 + beyond_first).cast("int")


def chunk_documents(docs: DataFrame, plan: ChunkPlan = ChunkPlan()) -> DataFrame:
    """One row per window.

    Needs ``document_id, translation_id, content``; every other column is
    carried along. Adds ``chunk_id, part, content`` (the window's text) and
    ``token_count``. Blank documents give no row.
    """
    carried = [c for c in docs.columns if c != "content"]
    tokenised = docs.select(*carried, tx.words(F.col("content")).alias("__words"))
    last = expected_chunks(F.size("__words"), plan) - 1
    windows = F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda part: F.slice("__words", part * plan.step + 1, plan.size)),
    )
    # The outer form keeps Spark from deriving a filter that would tokenise
    # the text a second time below this projection.
    cut = tokenised.select(*carried, F.posexplode_outer(windows).alias("part", "__cut")).filter("__cut is not null")
    return cut.select(
        ids.chunk_id(F.col("translation_id"), F.col("part")).alias("chunk_id"),
        *carried,
        "part",
        F.array_join("__cut", " ").alias("content"),
        F.size("__cut").alias("token_count"),
    )
