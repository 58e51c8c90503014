"""Chunk statistics and run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as tx


def _named(value: Column) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit("unknown"))


def chunk_token_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """count, min, rounded mean, nearest-rank 95th percentile, max.

    ``percentile_disc`` keeps one counter per distinct value; a chunk has at
    most 1024 tokens, so its buffer is bounded and merges map-side.
    """
    return chunks.groupBy(*(by or [])).agg(
        F.count("*").alias("chunk_count"),
        F.min("token_count").cast("long").alias("tokens_min"),
        F.round(F.avg("token_count")).cast("long").alias("tokens_avg"),
        F.expr("percentile_disc(0.95) within group (order by token_count)").cast("long").alias("tokens_p95"),
        F.max("token_count").cast("long").alias("tokens_max"),
    )


def chunk_counts(chunks: DataFrame, column: str) -> DataFrame:
    """``key, chunk_count``; blank keys count as unknown; biggest first."""
    counted = chunks.groupBy(_named(F.col(column)).alias("key")).agg(F.count("*").alias("chunk_count"))
    return counted.orderBy(F.desc("chunk_count"), F.asc("key"))


def top_documents(chunks: DataFrame, limit: int) -> DataFrame:
    """Documents with the most chunks, first title and path kept."""
    if limit <= 0:
        raise ValueError("top document count must be > 0")
    per_document = chunks.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"),
        F.min_by("title", "chunk_id").alias("title"),
        F.min_by("source_path", "chunk_id").alias("source_path"),
    )
    return per_document.orderBy(F.desc("chunk_count"), F.asc("document_id")).limit(limit)


def sample_chunks(chunks: DataFrame, n: int) -> DataFrame:
    """The first ``n`` chunks by id with a short snippet."""
    if n < 0:
        raise ValueError("sample must be >= 0")
    first = chunks.orderBy("chunk_id").limit(n)
    return first.select("chunk_id", "lang", "token_count", "title", tx.sample_snippet(F.col("content")).alias("snippet"))


def token_sum(column: str = "token_count") -> Column:
    return F.sum(F.greatest(F.col(column), F.lit(0))).cast("long")


def run_totals(document_metrics: DataFrame, seconds: Column) -> DataFrame:
    """One row of totals and rates over the documents of an index run, from
    ``chunks_count, chunks_tokens_sum, embed_ms, upsert_ms``; ``seconds`` is the
    run's own time."""

    def per(value: Column, base: Column) -> Column:
        return F.round(F.when(base > 0, value / base).otherwise(F.lit(0.0)), 2)

    totals = document_metrics.agg(
        F.count("*").alias("documents"),
        *[
            F.coalesce(F.sum(source), F.lit(0)).cast("long").alias(name)
            for source, name in (("chunks_count", "chunks"), ("chunks_tokens_sum", "tokens"), ("embed_ms", "embed_ms"), ("upsert_ms", "upsert_ms"))
        ],
    )
    return totals.select(
        "documents",
        "chunks",
        "tokens",
        "embed_ms",
        "upsert_ms",
        per(F.col("chunks"), F.col("documents")).alias("chunks_per_document"),
        per(F.col("documents") * 60.0, seconds).alias("documents_per_minute"),
        per(F.col("chunks") * 1.0, seconds).alias("chunks_per_second"),
        per(F.col("upsert_ms") / 10.0, seconds).alias("upsert_share_percent"),
    )
