"""The indexing job: corpus to stored tables, only what changed.

ingest -> skip -> translate -> chunk -> embed -> write -> metrics. The parsed
corpus, the changed documents and their chunks are each written once to a
staging folder: several tables are made from them, files should be parsed once
and a model must not be called twice for the same text.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import dates, ids
from corpusmill.functions import fixed_values as fv
from corpusmill.functions import lang as lg
from corpusmill.functions import text as tx
from corpusmill.operators import skip, snapshot, stats, translation
from corpusmill.operators.chunking import ChunkPlan, chunk_documents, expected_chunks
from corpusmill.operators.embedding import Embedder, HashEmbedder
from corpusmill.operators.select import first_per_key

TABLES = {
    "documents": "id",
    "document_translations": "document_id",
    "intervenants": "id",
    "document_intervenants": "document_id",
    "rag_chunks": "doc_id",
    "index_document_metrics": "document_id",
}
_SCHEMAS = {
    "documents": schemas.DOCUMENTS,
    "document_translations": schemas.TRANSLATIONS,
    "intervenants": schemas.PERSONS,
    "document_intervenants": schemas.DOCUMENT_PERSONS,
    "rag_chunks": schemas.CHUNKS,
    "index_document_metrics": schemas.DOCUMENT_METRICS,
}


class Store:
    """The six stored tables below one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {
            name: snapshot.BucketedTable(spark, f"{self.path}/{name}", key, buckets) for name, key in TABLES.items()
        }

    def drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, name: str) -> DataFrame:
        """The current version; an empty frame before the first write."""
        held = self.tables[name].read()
        wanted = _SCHEMAS[name]
        if held is None:
            return self.spark.createDataFrame([], wanted)
        return held.select(*[F.col(f.name) for f in wanted if f.name in held.columns])


@dataclass(frozen=True)
class IndexSettings:
    mode: str = "local"
    plan: ChunkPlan = field(default_factory=ChunkPlan)
    supported: Sequence[str] = tuple(fv.SUPPORTED_LANGUAGES)
    default_language: str = fv.DEFAULT_LANGUAGE
    run_id: str = ""


@dataclass(frozen=True)
class IndexReport:
    run_id: str
    documents: int
    skipped: int
    processed: int
    chunks: int


def filter_columns(metadata: Column, external_id: Column, as_of: Column) -> dict[str, Column]:
    """Votation, object and place filters taken from a document's metadata."""

    def at(key: str) -> Column:
        return tx.trim(F.coalesce(F.get_json_object(metadata, f"$.{key}"), F.lit("")))

    vote_date = dates.parse_time(at("vote_date"))
    status = F.lower(at("status"))
    return {
        "votation_id": tx.non_empty(at("votation_id"), external_id),
        "object_id": at("object_id"),
        "level": tx.non_empty(F.lower(at("level")), F.lit("cantonal")),
        "canton": F.upper(at("canton")),
        "commune_code": at("commune_code"),
        "commune_name": at("commune_name"),
        "status": F.when(status != "", status).otherwise(dates.vote_status(vote_date, as_of)),
        "object_type": at("object_type"),
        "object_theme": at("object_theme"),
        "source_type": F.lower(tx.non_empty(at("source_type"), F.lit("official"))),
        "vote_date": vote_date,
    }


def _merge_json(base: Column, extra: dict[str, Column]) -> Column:
    """The keys of ``extra`` added to a flat JSON object, nulls left out."""
    added = F.to_json(F.struct(*[value.alias(key) for key, value in extra.items()]))
    inner = F.substring(added, 2, F.length(added) - 2)
    body = F.substring(base, 2, F.length(base) - 2)
    glue = F.when((F.trim(body) != "") & (inner != ""), ",").otherwise("")
    return F.concat(F.lit("{"), body, glue, inner, F.lit("}"))


_MADE = {"status": "tr_status", "provider": "tr_provider", "source_lang": "tr_source_lang", "source_hash": "tr_source_hash"}


def with_languages(docs: DataFrame, stored: DataFrame, settings: IndexSettings, translator: translation.Translator | None) -> DataFrame:
    """Corpus rows, in model mode completed to every supported language.

    Rows of the corpus itself are marked ready, so an unchanged document can
    be skipped next time in either mode. How a text came about is in the
    ``tr_`` columns.
    """
    own = docs.withColumns(
        {
            "tr_status": F.lit("ready"),
            "tr_provider": F.lit("source"),
            "tr_source_lang": F.col("lang"),
            "tr_source_hash": ids.translation_source_hash(F.col("lang"), F.col("title"), F.col("content")),
        }
    )
    if settings.mode != "llm":
        return own
    if translator is None:
        raise ValueError("llm mode needs a translator")
    done = translation.ensure_translations(docs, stored, translator, settings.supported, settings.default_language)
    texts = done.select(
        "document_id", "lang", "title", "content", *[F.col(name).alias(made) for name, made in _MADE.items()]
    )
    carried = [c for c in docs.columns if c not in {"document_id", "lang", "title", "content", "translation_id"}]
    order = list(dict.fromkeys([*fv.SOURCE_PREFERENCE, *settings.supported]))
    base = first_per_key(docs, ["document_id"], [lg.rank_in(F.col("lang"), order), F.desc("source_path")])
    joined = texts.join(base.select("document_id", *carried), "document_id")
    return joined.withColumn("translation_id", ids.translation_id(F.col("document_id"), F.col("lang")))


def run_index(
    docs: DataFrame,
    store: Store,
    as_of: Column,
    settings: IndexSettings = IndexSettings(),
    embedder: Embedder | None = None,
    translator: translation.Translator | None = None,
) -> IndexReport:
    """Index ``docs`` (the columns of ``sources.files``) into the store."""
    spark = store.spark
    embedder = embedder or HashEmbedder()
    run_id = settings.run_id or f"rag-index-{uuid.uuid4().hex[:16]}"
    staging = f"{store.path}/_staging/{run_id}"
    # Parsed once; what follows reads only the columns it needs.
    docs.write.parquet(f"{staging}/corpus")
    docs = skip.drop_repeated(spark.read.parquet(f"{staging}/corpus"))
    state, stored = skip.index_state(store.read("documents"), store.read("document_translations"))
    decisions = skip.skip_decisions(docs, state, stored, settings.plan, settings.mode, settings.supported)
    decisions.write.parquet(f"{staging}/decisions")
    decided = spark.read.parquet(f"{staging}/decisions")
    counts = decided.agg(F.count("*"), F.count(F.when(F.col("skip"), 1))).first()
    if counts[0] == 0:
        raise ValueError("no supported files found in corpus path")
    if counts[0] == counts[1]:
        store.drop(staging)
        return IndexReport(run_id, counts[0], counts[1], 0, 0)
    changed = skip.to_process(docs, decided)
    todo = with_languages(changed, stored, settings, translator)
    prepared = skip.with_index_metadata(todo).withColumns(
        filter_columns(F.col("metadata"), F.col("external_id"), as_of)
    )
    prepared.write.parquet(f"{staging}/documents")
    current = spark.read.parquet(f"{staging}/documents")
    chunks = _chunk_rows(current, settings.plan, embedder)
    chunks.write.parquet(f"{staging}/chunks")
    chunk_rows = spark.read.parquet(f"{staging}/chunks")
    if chunk_rows.isEmpty():
        raise ValueError("no chunks produced")

    def replace(name: str, batch: DataFrame) -> None:
        key = TABLES[name]
        store.tables[name].merge(batch, lambda old, new: snapshot.replace_groups(old, new, key))

    replace("rag_chunks", chunk_rows)
    replace("document_translations", _translation_rows(current, settings.plan))
    links = _person_links(current)
    replace("document_intervenants", links.select(*schemas.DOCUMENT_PERSONS.names))
    people = links.groupBy(F.col("intervenant_id").alias("id")).agg(
        F.min("first_name").alias("first_name"), F.min("last_name").alias("last_name"), F.min("role").alias("role"), F.lit("{}").alias("metadata")
    )
    store.tables["intervenants"].merge(people, lambda old, new: snapshot.upsert(old, new, ["id"], [F.asc("id")]))
    metrics = _metrics_rows(current, chunk_rows, settings, run_id, as_of)
    store.tables["index_document_metrics"].merge(
        metrics, lambda old, new: snapshot.upsert(old, new, ["run_id", "document_id"], [F.desc("indexed_at")])
    )
    # The documents table says "complete": it is written last.
    per_document = chunk_rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("indexed_chunk_count"))
    replace("documents", _document_rows(current, per_document, settings, as_of))
    report = IndexReport(run_id, counts[0], counts[1], counts[0] - counts[1], chunk_rows.count())
    store.drop(staging)
    return report


def _document_rows(current: DataFrame, chunk_counts: DataFrame, settings: IndexSettings, as_of: Column) -> DataFrame:
    order = list(dict.fromkeys([*fv.SOURCE_PREFERENCE, *settings.supported]))
    one = first_per_key(current, ["document_id"], [lg.rank_in(F.col("lang"), order), F.desc("source_path")])
    extra = {
        "index_source_fingerprint": F.nullif(F.col("source_fingerprint"), F.lit("")),
        "index_source_fingerprint_confidence": F.when(F.col("source_fingerprint") != "", F.col("fingerprint_confidence")),
    }
    joined = one.join(chunk_counts, F.col("document_id") == F.col("doc_id"), "left")
    values = {
        "id": F.col("document_id"),
        "source_system": tx.non_empty(F.col("source_system"), F.lit("local_fixture")),
        "source_uri": tx.non_empty(F.col("source_uri"), F.col("source_path")),
        "external_id": tx.non_empty(F.col("external_id"), F.col("document_id")),
        "content_type": tx.non_empty(F.col("source_content_type"), F.lit("text/plain")),
        "fetched_at_utc": F.coalesce("fetched_at", as_of),
        "index_complete": F.col("indexed_chunk_count").isNotNull(),
        "indexed_chunk_count": F.coalesce("indexed_chunk_count", F.lit(0)),
        "index_completed_at": F.when(F.col("indexed_chunk_count").isNotNull(), as_of),
        "source_metadata": _merge_json(F.col("source_extra"), extra),
    }
    return joined.select(*[values.get(name, F.col(name)).alias(name) for name in schemas.DOCUMENTS.names])


def _translation_rows(current: DataFrame, plan: ChunkPlan) -> DataFrame:
    shown = F.get_json_object("metadata", "$.display_title")
    meta = F.struct(
        F.col("available_languages"),
        F.col("tr_status").alias("translation_status"),
        F.col("tr_provider").alias("translation_provider"),
        F.col("tr_source_lang").alias("translation_source_lang"),
        F.col("tr_source_hash").alias("translation_source_hash"),
        F.nullif(F.col("content_hash"), F.lit("")).alias("index_content_hash"),
        F.nullif(F.col("source_fingerprint"), F.lit("")).alias("index_source_fingerprint"),
        expected_chunks(tx.word_count(F.col("content")), plan).alias("index_chunk_count"),
        F.when(F.col("tr_provider") == "source", shown).otherwise(F.col("title")).alias("display_title"),
    )
    return current.select(
        F.col("translation_id").alias("id"),
        "document_id",
        tx.non_empty(F.col("lang"), F.lit(fv.DEFAULT_LANGUAGE)).alias("lang"),
        tx.non_empty(F.col("title"), F.lit("Sans titre")).alias("title"),
        F.lit("").alias("summary"),
        F.col("content").alias("content_normalized"),
        F.to_json(meta).alias("metadata"),
    )


def _chunk_rows(current: DataFrame, plan: ChunkPlan, embedder: Embedder) -> DataFrame:
    filters = ["votation_id", "object_id", "level", "canton", "commune_code", "commune_name", "status", "source_type", "vote_date"]
    sources = ["source_system", "source_uri", "external_id", "source_org", "available_languages"]
    keep = ["document_id", "translation_id", "lang", "source_path", "title", "persons", "metadata", *filters, *sources]
    cut = chunk_documents(current.select(*keep, "content"), plan)
    meta = F.to_json(F.struct(*sources, F.col("persons").alias("intervenants")))
    values = {
        "id": F.col("chunk_id"),
        "doc_id": F.col("document_id"),
        "lang": tx.non_empty(F.col("lang"), F.lit(fv.DEFAULT_LANGUAGE)),
        "chunk_metadata": _merge_json(meta, {"display_title": F.get_json_object("metadata", "$.display_title")}),
        "embedding": embedder.embed(F.col("content")),
    }
    return cut.select(*[values.get(name, F.col(name)).alias(name) for name in schemas.CHUNKS.names])


def _person_links(current: DataFrame) -> DataFrame:
    rows = current.select("document_id", F.posexplode("persons").alias("order_index", "p")).select("document_id", "order_index", "p.*")
    named = rows.filter((tx.trim(F.col("first_name")) != "") & (tx.trim(F.col("last_name")) != ""))
    keyed = named.withColumn("intervenant_id", ids.person_id(F.col("first_name"), F.col("last_name"), F.col("role")))
    one = first_per_key(keyed, ["document_id", "intervenant_id"], [F.asc("order_index")])
    return one.withColumns(
        {
            "id": ids.link_id(F.col("document_id"), F.col("intervenant_id"), F.col("order_index")),
            "relation_type": F.lit("mentioned"),
        }
    )


def _metrics_rows(current: DataFrame, chunks: DataFrame, settings: IndexSettings, run_id: str, as_of: Column) -> DataFrame:
    source = translation.pick_metrics_source(current, settings.default_language).select(
        "document_id",
        F.col("lang").alias("source_lang"),
        tx.byte_len(F.col("content")).alias("source_content_chars"),
        tx.byte_len(F.col("title")).alias("title_chars"),
    )
    sums = chunks.groupBy(F.col("doc_id").alias("document_id")).agg(
        F.count("*").alias("chunks_count"), stats.token_sum().alias("chunks_tokens_sum")
    )
    made = current.groupBy("document_id").agg(F.sum((F.col("tr_provider") != "source").cast("long")).alias("made"))
    joined = source.join(sums, "document_id").join(made, "document_id")
    zero = F.lit(0).cast("long")
    values = {
        "run_id": F.lit(run_id),
        "translations_attempted": F.col("made"),
        "translations_succeeded": F.col("made"),
        "status": F.lit("success"),
        "indexed_at": as_of,
    }
    known = {*joined.columns, *values}
    return joined.select(
        *[(values.get(n, F.col(n) if n in known else zero)).alias(n) for n in schemas.DOCUMENT_METRICS.names]
    )


def search_chunks(store: Store) -> DataFrame:
    """Stored chunks in the shape retrieval expects."""
    meta = "chunk_metadata"
    persons = F.from_json(F.get_json_object(meta, "$.intervenants"), f"array<{schemas.PERSON}>")
    named = F.filter(persons, lambda p: (F.trim(p["first_name"]) != "") & (F.trim(p["last_name"]) != ""))
    return store.read("rag_chunks").select(
        F.col("id").alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        "source_path",
        "title",
        "content",
        "lang",
        F.coalesce(F.get_json_object(meta, "$.source_system"), F.lit("")).alias("source_system"),
        F.coalesce(F.get_json_object(meta, "$.source_uri"), F.lit("")).alias("source_uri"),
        F.coalesce(named, F.array().cast(f"array<{schemas.PERSON}>")).alias("persons"),
        "embedding",
        "votation_id",
        "object_id",
        "canton",
    )
