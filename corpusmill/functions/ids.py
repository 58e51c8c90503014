"""Identifier and hash formulas; other systems rely on these exact strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv
from corpusmill.functions import text as tx


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _safe_part(value: Column, default: str) -> Column:
    part = F.translate(F.lower(tx.trim(value)), " ", "_")
    return F.when(part == "", default).otherwise(part)


def document_id(system: Column, external: Column) -> Column:
    return F.concat_ws(":", _safe_part(system, "source"), _safe_part(external, "document"))


def translation_id(document: Column, language: Column) -> Column:
    """``language`` must already be a supported code or empty."""
    return F.concat_ws(":", document, F.when(language == "", fv.DEFAULT_LANGUAGE).otherwise(language))


def path_id(path: Column) -> Column:
    return F.translate(path, "/.", "__")


def chunk_id(translation: Column, part: Column) -> Column:
    return F.concat(F.translate(translation, ": ", "__"), F.lit("_chunk_"), F.format_string("%04d", part))


def person_id(first: Column, last: Column, role: Column) -> Column:
    joined = F.lower(tx.trim(F.concat_ws("_", first, last, role)))
    return F.concat(F.lit("intv:"), F.translate(joined, " /\\:", "____"))


def link_id(document: Column, person: Column, position: Column) -> Column:
    return F.concat_ws(":", document, person, position.cast("string"))


def content_hash(language: Column, title: Column, content: Column) -> Column:
    """Hash of language, title and squeezed content; empty when both texts are."""
    heading, body = tx.trim(title), tx.squeeze(content)
    return F.when((heading == "") & (body == "") , "").otherwise(
        sha256(F.concat_ws("|", tx.trim(language), heading, body))
    )


def _utc_text(moment: Column) -> Column:
    return F.coalesce(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(""))


def source_fingerprint(system: Column, external: Column, uri: Column, issued: Column, modified: Column) -> Column:
    parts = [tx.trim(system), tx.trim(external), tx.trim(uri), _utc_text(issued), _utc_text(modified)]
    base = F.concat_ws("|", *parts)
    return F.when(F.trim(base, F.lit("|")) == "", "").otherwise(sha256(base))


def fingerprint_confidence(issued: Column, modified: Column) -> Column:
    return F.when(issued.isNotNull() | modified.isNotNull(), "high").otherwise("low")


def translation_source_hash(language: Column, title: Column, content: Column) -> Column:
    return sha256(F.concat_ws("|", tx.trim(language), tx.trim(title), tx.trim(content)))


def context_signature(
    language: Column,
    votation: Column,
    object_: Column,
    canton: Column,
    mode: str,
    embedder: str,
    summarizer: str,
    top_k: int,
) -> Column:
    return F.concat_ws(
        "|",
        F.concat(F.lit("lang="), F.lower(tx.trim(language))),
        F.concat(F.lit("votation="), tx.trim(votation)),
        F.concat(F.lit("object="), tx.trim(object_)),
        F.concat(F.lit("canton="), F.upper(tx.trim(canton))),
        F.lit(f"ragMode={mode.strip()}"),
        F.lit(f"embedder={embedder.strip()}"),
        F.lit(f"summarizer={summarizer.strip()}"),
        F.lit(f"topK={top_k}"),
    )


def exact_cache_key(question: Column, signature: Column) -> Column:
    return sha256(F.concat_ws("|", tx.trim(question), signature, F.lit("exact-v1")))


def semantic_cache_key(question: Column, signature: Column) -> Column:
    return sha256(F.concat_ws("|", sha256(tx.trim(question)), sha256(signature), F.lit("semantic-v1")))


def usage_event_id() -> Column:
    return F.concat(F.lit("evt_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))


def index_run_id(unix_seconds: int, token: str) -> str:
    return f"rag-index-{unix_seconds}-{token}"
