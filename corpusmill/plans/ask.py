"""One question against the store, and the chunk report of a corpus."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv
from corpusmill.operators import qa, stats
from corpusmill.operators.chunking import ChunkPlan, chunk_documents
from corpusmill.operators.embedding import Embedder


def ask(question: str, chunks: DataFrame, embedder: Embedder, language: str = fv.DEFAULT_LANGUAGE, top_k: int = fv.TOP_K) -> tuple[DataFrame, DataFrame]:
    """``(hits, answer)`` for one question; hits are ordered by rank."""
    if not question.strip():
        raise ValueError("question is required")
    settings = qa.QASettings(top_k=top_k)
    asked = chunks.sparkSession.createDataFrame([(1, question, language)], "question_id long, question string, language string")
    work = qa.distinct_work(qa.prepare_questions(asked, embedder, settings))
    hits = qa.retrieve(work, chunks, embedder, settings)
    return hits.orderBy("rank"), qa.answer(work, hits).drop("exact_key")


@dataclass(frozen=True)
class ChunkReport:
    totals: DataFrame
    by_language: DataFrame
    by_source: DataFrame
    top_documents: DataFrame
    sample: DataFrame


def chunk_report(docs: DataFrame, plan: ChunkPlan = ChunkPlan(), sample: int = 3, top_docs: int = 5) -> ChunkReport:
    """Chunk statistics of a corpus without a store."""
    chunks = chunk_documents(docs, plan)
    documents = docs.agg(F.count("*").alias("document_count"))
    return ChunkReport(
        documents.join(stats.chunk_token_stats(chunks)),
        stats.chunk_counts(chunks, "lang"),
        stats.chunk_counts(chunks, "source_system"),
        stats.top_documents(chunks, top_docs),
        stats.sample_chunks(chunks, sample),
    )
