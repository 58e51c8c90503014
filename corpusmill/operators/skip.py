"""Incremental indexing: which documents can be left alone.

``docs`` has one row per document and language: ``document_id, lang, title,
content, source_path, source_system, external_id, source_uri, issued_at,
modified_at``. State comes as two frames, one per stored table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv
from corpusmill.functions import ids
from corpusmill.functions import lang as lg
from corpusmill.functions import text as tx
from corpusmill.operators.chunking import ChunkPlan, expected_chunks


def with_index_metadata(docs: DataFrame) -> DataFrame:
    """Adds the content hash, source fingerprint and its confidence."""
    return docs.withColumns(
        {
            "content_hash": ids.content_hash(F.col("lang"), F.col("title"), F.col("content")),
            "source_fingerprint": ids.source_fingerprint(
                F.col("source_system"), F.col("external_id"), F.col("source_uri"), F.col("issued_at"), F.col("modified_at")
            ),
            "fingerprint_confidence": ids.fingerprint_confidence(F.col("issued_at"), F.col("modified_at")),
        }
    )


def index_state(documents: DataFrame, translations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two state frames read from the stored tables' metadata."""

    def meta(column: str, key: str) -> Column:
        return F.coalesce(F.get_json_object(column, f"$.{key}"), F.lit(""))

    state = documents.select(
        F.col("id").alias("document_id"),
        meta("source_metadata", "index_source_fingerprint").alias("source_fingerprint"),
        meta("source_metadata", "index_source_fingerprint_confidence").alias("fingerprint_confidence"),
        F.coalesce("index_complete", F.lit(False)).alias("index_complete"),
        F.coalesce("indexed_chunk_count", F.lit(0)).alias("indexed_chunk_count"),
    )
    per_language = translations.select(
        "document_id",
        "lang",
        "title",
        F.col("content_normalized").alias("content"),
        meta("metadata", "translation_status").alias("status"),
        meta("metadata", "translation_provider").alias("provider"),
        meta("metadata", "translation_source_hash").alias("source_hash"),
        meta("metadata", "index_content_hash").alias("content_hash"),
        F.get_json_object("metadata", "$.index_chunk_count").cast("int").alias("chunk_count"),
    )
    return state, per_language


def skip_decisions(
    docs: DataFrame,
    state: DataFrame,
    translations: DataFrame,
    plan: ChunkPlan = ChunkPlan(),
    mode: str = "local",
    supported: Sequence[str] = fv.SUPPORTED_LANGUAGES,
) -> DataFrame:
    """``document_id, expected_chunks, skip, reason`` for every document.

    Everything per language is a flag reduced with min/max, so the grouping
    is a plain partial aggregate. The text itself is never shuffled: tokens
    are counted and hashes taken before the join.
    """
    facts = with_index_metadata(docs).select(
        "document_id",
        tx.trim(F.col("lang")).alias("lang"),
        expected_chunks(tx.word_count(F.col("content")), plan).alias("expected"),
        F.col("content_hash").alias("new_hash"),
        F.struct("source_fingerprint", "fingerprint_confidence").alias("source"),
        # The picked source is the best-placed language; for one language the
        # last path in walking order counts.
        F.struct(-lg.rank_in(tx.trim(F.col("lang")), fv.SOURCE_PREFERENCE), F.col("source_path")).alias("preference"),
    )
    counted = F.col("chunk_count") if "chunk_count" in translations.columns else F.lit(None).cast("int")
    stored = translations.select(
        "document_id",
        "lang",
        F.trim("status").alias("status"),
        F.col("content_hash").alias("old_hash"),
        counted.alias("old_count"),
    )
    rows = facts.join(stored, ["document_id", "lang"], "left")
    same = (F.col("new_hash") == F.col("old_hash")) & (F.col("new_hash") != "")
    per_document = rows.groupBy("document_id").agg(
        F.sum("expected").cast("int").alias("expected_chunks"),
        # Chunks stored for the languages at hand; the total also counts
        # translations made at indexing time.
        F.when(F.count("old_count") == F.count("*"), F.sum("old_count")).alias("stored_chunks"),
        F.max_by("source", "preference").alias("source"),
        F.min(F.coalesce(same, F.lit(False))).alias("hashes_match"),
        F.min(F.coalesce(F.col("status") == "ready", F.lit(False)) | (F.col("lang") == "")).alias("ready"),
    )
    if mode == "llm":
        ready = stored.filter((F.col("status") == "ready") & F.col("lang").isin(*supported))
        counts = ready.groupBy("document_id").agg(F.count_distinct("lang").alias("__ready"))
        per_document = per_document.drop("ready").join(counts, "document_id", "left")
        per_document = per_document.withColumn("ready", F.coalesce("__ready", F.lit(0)) == len(supported))
    known = state.select(
        "document_id",
        F.col("source_fingerprint").alias("old_fingerprint"),
        F.col("fingerprint_confidence").alias("old_confidence"),
        "index_complete",
        "indexed_chunk_count",
    )
    decided = per_document.join(known, "document_id", "left")
    fingerprint_match = (
        (F.trim("old_fingerprint") != "")
        & (F.trim("old_confidence") == "high")
        & (F.col("source.fingerprint_confidence") == "high")
        & (F.col("source.source_fingerprint") == F.col("old_fingerprint"))
    )
    held = F.coalesce("stored_chunks", "indexed_chunk_count")
    reason = (
        F.when(F.col("index_complete").isNull(), "new")
        .when(~F.col("index_complete"), "incomplete")
        .when((F.col("expected_chunks") <= 0) | (F.col("expected_chunks") != held), "chunk_count")
        .when(~F.col("ready"), "translation")
        .when(F.coalesce(fingerprint_match, F.lit(False)), "same_source")
        .when(F.col("hashes_match"), "same_content")
        .otherwise("changed")
    )
    return decided.select(
        "document_id", "expected_chunks", reason.isin("same_source", "same_content").alias("skip"), reason.alias("reason")
    )


def to_process(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents that are not skipped. The id list is short beside the texts;
    where it is small enough Spark broadcasts it and the texts stay in place."""
    return docs.join(decisions.filter("skip").select("document_id"), "document_id", "left_anti")


def drop_repeated(docs: DataFrame) -> DataFrame:
    """The last path wins where two files give the same document and language.

    The losing rows, normally none, are found on keys alone; the texts are not
    shuffled for it.
    """
    keys = ["document_id", "lang"]
    paths = docs.select(*keys, "source_path")
    last = paths.groupBy(*keys).agg(F.max("source_path").alias("__last"))
    losing = paths.join(last, keys).filter(F.col("source_path") < F.col("__last")).select(*keys, "source_path")
    return docs.join(losing, [*keys, "source_path"], "left_anti")
