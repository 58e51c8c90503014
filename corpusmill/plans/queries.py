"""The query catalogue: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import dates, ids, urls, vectors
from corpusmill.functions import fixed_values as fv
from corpusmill.functions import json_values as js
from corpusmill.functions import lang as lg
from corpusmill.functions import text as tx
from corpusmill.operators import qa, qa_cache, search, skip, snapshot, stats, summary, translation, usage, vector_cells, votes
from corpusmill.operators.chunking import ChunkPlan, expected_chunks
from corpusmill.operators.embedding import HashEmbedder
from corpusmill.plans import catalog
from corpusmill.plans import corpus_views as views
from corpusmill.session import cut_lineage
from corpusmill.sources.html import visible_text
from corpusmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _sha(column: str) -> F.Column:
    return ids.sha256(F.col(column))


def _json_map(column: str, alias: str):
    """Language maps leave as ordered ``lang=title`` text."""
    pairs = F.array_sort(F.transform(F.map_entries(F.col(column)), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return F.array_join(pairs, "|").alias(alias)


# --- chunks ------------------------------------------------------------------


@query
def chunk_documents(spark, sf):
    chunks = views.corpus_chunks(spark, sf)
    return chunks.select("chunk_id", "document_id", "lang", "part", "token_count", _sha("content").alias("content_sha"))


@query
def chunk_documents_512(spark, sf):
    chunks = views.corpus_chunks(spark, sf, ChunkPlan(512, 0.10))
    return chunks.select("chunk_id", "token_count", _sha("content").alias("content_sha"))


@query
def expected_chunk_count(spark, sf):
    docs = views.corpus_documents(spark, sf)
    count = tx.word_count(F.col("content"))
    return docs.select("document_id", count.alias("tokens")).select(
        "document_id",
        "tokens",
        expected_chunks(F.col("tokens")).alias("chunks_768"),
        expected_chunks(F.col("tokens"), ChunkPlan(1024, 0.2)).alias("chunks_1024"),
    )


@query
def chunk_token_stats(spark, sf):
    return stats.chunk_token_stats(views.corpus_chunks(spark, sf))


@query
def chunk_token_stats_by_lang(spark, sf):
    return stats.chunk_token_stats(views.corpus_chunks(spark, sf), ["lang"])


@query
def chunk_counts_by_lang(spark, sf):
    return stats.chunk_counts(views.corpus_chunks(spark, sf), "lang")


@query
def chunk_counts_by_source(spark, sf):
    return stats.chunk_counts(views.corpus_chunks(spark, sf), "source_system")


@query
def top_documents(spark, sf):
    return stats.top_documents(views.corpus_chunks(spark, sf), 25)


@query
def sample_chunks(spark, sf):
    return stats.sample_chunks(views.corpus_chunks(spark, sf), 40)


@query
def run_totals(spark, sf):
    """Milliseconds derived from the chunks stand in for measured times."""
    chunks = views.corpus_chunks(spark, sf).groupBy("document_id").agg(
        F.count("*").alias("chunks_count"),
        stats.token_sum().alias("chunks_tokens_sum"),
        (F.count("*") * 3).alias("embed_ms"),
        (F.count("*") + F.max("token_count")).alias("upsert_ms"),
    )
    return stats.run_totals(chunks, F.col("embed_ms") / 100.0)


# --- fetching ----------------------------------------------------------------


def _cached_pages(spark, sf):
    """Pages as fetch-cache rows, aged by the hour; some bodies are not intact."""
    whole = F.upper(F.sha2("html", 256))
    return table(spark, sf, "pages").select(
        "page_id",
        "url",
        F.col("html").alias("body"),
        F.when(F.col("page_id") % 5 == 0, F.lit("00")).otherwise(F.concat(F.lit(" "), whole)).alias("sha256"),
        F.timestamp_add("HOUR", -F.col("page_id").cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("fetched_at"),
    )


@query
def fetch_cache_fresh(spark, sf):
    from corpusmill.sources import fetch

    return fetch.fresh(_cached_pages(spark, sf), F.lit("2024-01-01").cast("timestamp")).select("page_id", "url")


@query
def fetch_cache_retained(spark, sf):
    from corpusmill.sources import fetch

    return fetch.retained(_cached_pages(spark, sf), F.lit("2024-01-01").cast("timestamp")).select("page_id", "url")


def _votings(spark, sf):
    """Orders as votings with links, some of them blank or absent."""
    key = F.col("o_orderkey")

    def link(kind: str, when):
        return F.when(when, F.concat(F.lit(f" https://x/{kind}/"), key.cast("string"))).alias(kind)

    links = F.struct(
        link("affairs", key % 3 != 0),
        F.when(key % 2 == 0, F.lit("  ")).otherwise(F.concat(F.lit("https://x/votes/"), key.cast("string"))).alias("votes"),
        link("meeting", F.col("o_orderstatus") == "F"),
        link("bodies", F.col("o_orderstatus") != "P"),
    )
    return table(spark, sf, "orders").select(key.alias("id"), F.concat(F.lit("https://x/v/"), key.cast("string")).alias("url_api"), links.alias("links"))


@query
def seed_urls(spark, sf):
    return votes.seed_urls(_votings(spark, sf))


@query
def missing_bodies(spark, sf):
    """Payloads that the votes need and that no crawled seed has brought."""
    orders = table(spark, sf, "orders")
    key = F.col("o_custkey")
    given = F.when(key % 4 == 0, F.concat(F.lit("https://x/c/"), key.cast("string")))
    links = F.struct(given.alias("contributors"), F.lit("").alias("docs"), F.lit(None).cast("string").alias("texts"))
    affairs = orders.select(F.col("o_orderkey").alias("voting_id"), key.alias("id"), links.alias("links"))
    crawled = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(
        F.concat(F.lit("https://api.openparldata.ch/v1/affairs/"), F.col("c_custkey").cast("string"), F.lit("/docs")).alias("url")
    )
    return votes.missing_bodies(votes.required_urls(affairs), crawled)


@query
def front_matter_rows(spark, sf):
    """Documents as text files with a head: title, entries, then the body."""
    from corpusmill.sources.files import front_matter

    head = F.concat(F.lit("\n#  "), F.col("source"), F.lit(" \n\n- Lang : "), F.col("lang"), F.lit("\n-  Chars: 1:2\n- id: "), F.col("doc_id").cast("string"), F.lit("\n"))
    parsed = table(spark, sf, "documents").select("doc_id", front_matter(F.concat(head, F.lit("Body: "), F.col("text"))).alias("f"))
    pairs = F.array_join(F.transform("f.entries", lambda e: F.concat_ws("=", e["key"], e["value"])), "|")
    return parsed.select("doc_id", F.col("f.title").alias("title"), pairs.alias("entries"), F.sha2("f.body", 256).alias("body_sha"))


# --- ids, hashes, scalars ----------------------------------------------------


@query
def document_ids(spark, sf):
    docs = views.corpus_documents(spark, sf)
    return docs.select("document_id", "translation_id", ids.path_id(F.col("source_path")).alias("path_id"))


@query
def content_hash(spark, sf):
    docs = views.corpus_documents(spark, sf)
    return docs.select("document_id", ids.content_hash(F.col("lang"), F.col("title"), F.col("content")).alias("content_hash"))


@query
def source_fingerprint(spark, sf):
    facts = skip.with_index_metadata(views.corpus_documents(spark, sf))
    return facts.select("document_id", "source_fingerprint", "fingerprint_confidence")


@query
def translation_source_hash(spark, sf):
    docs = views.corpus_documents(spark, sf)
    return docs.select(
        "document_id",
        ids.translation_source_hash(F.col("lang"), F.col("title"), F.col("content")).alias("source_hash"),
    )


@query
def person_ids(spark, sf):
    parts = table(spark, sf, "part")
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    person = ids.person_id(first, last, F.col("p_type"))
    return parts.select(
        "p_partkey", person.alias("person_id"), ids.link_id(F.col("p_brand"), person, F.col("p_size")).alias("link_id")
    )


@query
def slugs(spark, sf):
    docs = views.catalog_documents(spark, sf)
    return docs.select("id", tx.slug(F.col("object_id")).alias("slug"))


@query
def pii_redact(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        ids.sha256(tx.redact(F.col("text"))).alias("redacted_sha"),
        tx.has_email(F.col("text")).alias("has_email"),
        tx.has_phone(F.col("text")).alias("has_phone"),
    )


@query
def markdown_strip(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", ids.sha256(tx.squeeze(tx.strip_markdown(F.col("text")))).alias("plain_sha"))


@query
def compact_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.compact(F.col("text"), 300).alias("compact"))


@query
def highlight_snippets(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.highlight(F.col("text")).alias("snippet"))


@query
def argument_side(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.argument_side(F.col("text")).alias("side"))


@query
def token_estimates(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", tx.token_estimate(tx.byte_len(tx.trim(F.col("text")))).alias("tokens"))


@query
def language_codes(spark, sf):
    docs = views.corpus_documents(spark, sf)
    raw = F.concat(F.lit(" "), F.upper("lang"), F.when(F.col("title").like("%3"), "-CH").otherwise(""), F.lit(" "))
    return docs.select(
        "document_id",
        lg.normalize(raw).alias("plain"),
        lg.supported_or_empty(raw).alias("supported"),
        lg.request_language(raw).alias("request"),
        lg.summary_language(raw).alias("summary"),
        lg.from_location(F.col("source_uri"), F.col("source_path")).alias("by_path"),
    )


@query
def page_urls(spark, sf):
    pages = table(spark, sf, "pages")
    url = F.col("url")
    return pages.select(
        "page_id",
        urls.canonical(url).alias("canonical"),
        ids.sha256(urls.canonical(url)).alias("cache_key"),
        lg.from_location(url, F.lit("")).alias("lang"),
        urls.source_system(url, F.lit("page.html")).alias("system"),
        urls.is_allowed_api(url, "m.ththth.example.net").alias("allowed"),
    )


@query
def json_props(spark, sf):
    events = table(spark, sf, "events").withColumn("doc", F.parse_json("props"))
    return events.select("event_id", js.scalar(F.col("doc"), "$.k").alias("k_text"), js.scalar(F.col("doc"), "$.missing").alias("missing"))


@query
def usage_tokens(spark, sf):
    events = table(spark, sf, "events")
    body = F.concat(
        F.lit('{"usage":{"prompt_tokens":'), F.get_json_object("props", "$.k"), F.lit(',"output_tokens":"7"}}')
    )
    return events.select("event_id", js.usage_tokens(body).alias("u")).select("event_id", "u.*")


@query
def vote_dates(spark, sf):
    orders = table(spark, sf, "orders")
    naive = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    raw = (
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", naive)
        .otherwise(F.concat(naive, F.lit("+02:00")))
    )
    parsed = dates.parse_time(raw)
    return orders.select(
        "o_orderkey", dates.utc_text(parsed).alias("parsed"), dates.vote_status(parsed, views.as_of()).alias("status")
    )


@query
def html_text(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select("page_id", tx.squeeze(visible_text(F.col("html"))).alias("text"))


# --- vectors and retrieval ---------------------------------------------------


@query
def hash_embedding(spark, sf):
    asked = views.questions(spark, sf)
    embedded = asked.select("question_id", HashEmbedder().embed(F.col("question")).alias("v"))
    return embedded.select("question_id", F.posexplode("v").alias("dim", "value")).select(
        "question_id", "dim", F.round(F.col("value").cast("double"), 7).alias("value")
    )


@query
def vector_topk(spark, sf):
    """One question vector (the first stored one) against all vectors."""
    items = views.stored_vectors(spark, sf)
    asked = items.orderBy("item_id").limit(1).select(F.col("item_id").alias("query_id"), "embedding")
    found = search.nearest(items, asked, 64, 5)
    return found.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


@query
def vector_topk_batch(spark, sf):
    items = views.stored_vectors(spark, sf)
    asked = items.withColumnRenamed("item_id", "query_id")
    found = search.nearest(items, asked, 64, 5, skip_self=True)
    return found.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


@query
def vector_topk_cells(spark, sf):
    """The same for any number of questions: each visits the cells that can
    still reach its best rows."""
    items = views.stored_vectors(spark, sf)
    index = vector_cells.build(items, 64)
    found = vector_cells.nearest(index, items.withColumnRenamed("item_id", "query_id"), 5, skip_self=True)
    return found.select("query_id", "item_id", "rank", F.round("score", 6).alias("score"))


@query
def cosine_pairs(spark, sf):
    """Cosine of each vector with the next one, pair by pair."""
    items = views.stored_vectors(spark, sf)
    nxt = items.select((F.col("item_id") - 1).alias("item_id"), F.col("embedding").alias("other"))
    return items.join(nxt, "item_id").select(
        "item_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("score")
    )


@query
def semantic_cache_probe(spark, sf):
    """Closest other entry of the same context, for every vector."""
    items = views.stored_vectors(spark, sf)
    entries = items.select(F.col("item_id").alias("cache_key"), "embedding", F.col("label").alias("context_hash"))
    asked = entries.withColumnRenamed("cache_key", "query_id")
    found = qa_cache.probe_semantic(asked, entries, 64, 0.4, skip_self=True)
    return found.select("query_id", "cache_key", F.round("score", 6).alias("score"))


def _hits(spark, sf, chunks):
    embedder = HashEmbedder()
    work = qa.distinct_work(qa.prepare_questions(views.questions(spark, sf), embedder))
    return work, qa.retrieve(work, chunks, embedder)


@query
def retrieval(spark, sf):
    _, hits = _hits(spark, sf, views.embedded_chunks(spark, sf))
    return hits.select(F.col("query_id").alias("exact_key"), "rank", "chunk_id", F.round("score", 6).alias("score"))


@query
def qa_answers(spark, sf):
    found = qa.answer_questions(views.questions(spark, sf), views.embedded_chunks(spark, sf), HashEmbedder())
    return found.select(
        "question_id",
        "question",
        "language",
        "answer",
        "confidence",
        F.array_join(F.transform("citations", lambda c: F.concat_ws("~", c["source_type"], c["url"], c["title"])), "|").alias("citations"),
        F.array_join("used_documents", "|").alias("used_documents"),
    )


@query
def qa_cached_answers(spark, sf):
    """Every user question asked four times within some days, through the cache."""
    nth = views.questions(spark, sf).withColumn("n", F.explode(F.sequence(F.lit(0), F.lit(3))))
    second = (F.col("question_id") * 7919 + F.col("n") * F.col("n") * 180 + F.col("n") * F.pmod(F.col("question_id"), F.lit(5)) * 20000) % 300000
    asks = nth.select((F.col("question_id") * 10 + F.col("n")).alias("question_id"), "question", "language", F.timestamp_seconds(second).alias("asked_at"))
    found = qa.answer_in_order(asks, views.embedded_chunks(spark, sf), HashEmbedder())
    return found.select("question_id", "outcome", F.unix_seconds("entry_at").alias("entry_second"), F.col("score").alias("score"), "answer", "confidence")


@query
def prompt_budget(spark, sf):
    # sizes of texts go with the hits, not the texts
    sized = views.embedded_chunks(spark, sf).withColumn("text_bytes", tx.byte_len(F.col("content"))).drop("content")
    work, hits = _hits(spark, sf, sized)
    asked = hits.join(work.select(F.col("exact_key").alias("query_id"), "question", "language"), "query_id")
    parts = summary.prompt_parts(asked, F.col("question"), F.col("language"), fv.MAX_PROMPT_BYTES, fv.PROMPT_MAX_HITS)
    return parts.select(
        F.col("query_id").alias("exact_key"),
        "rank",
        F.col("used_before").cast("long").alias("used_before"),
        F.col("budget").cast("long").alias("budget"),
        F.col("room").cast("long").alias("room"),
        "header",
    )


@query
def sanitized_questions(spark, sf):
    turns = table(spark, sf, "conversations")
    clean = tx.sanitize_question(F.col("text"))
    return turns.select("conv_id", "turn", clean.alias("question"), tx.is_cacheable(clean).alias("cacheable"))


@query
def cache_keys(spark, sf):
    prepared = qa.prepare_questions(views.questions(spark, sf), HashEmbedder())
    return prepared.select("question_id", "signature", "context_hash", "exact_key", "semantic_key")


@query
def cache_eviction(spark, sf):
    """Entries still alive at a moment, the newest 500 of them kept."""
    events = table(spark, sf, "events").select(
        F.col("event_id").alias("cache_key"), F.col("ts").cast("timestamp").alias("created_at")
    )
    entries = events.withColumn("expires_at", F.timestamp_add("HOUR", F.lit(24 * 20), F.col("created_at")))
    alive = qa_cache.live(entries, dates.moment("2024-01-25T00:00:00Z"))
    return qa_cache.evict_oldest(alive, 500).select("cache_key")


@query
def cache_metrics(spark, sf):
    """Lookup log: one row per usage event, its kind as the outcome."""
    events = table(spark, sf, "events")
    kind = F.col("event_type")
    outcome = (
        F.when(kind == "view", "exact_hit")
        .when(kind == "click", "semantic_hit")
        .when(kind == "error", "bypass_sensitive")
        .otherwise("miss")
    )
    k = F.get_json_object("props", "$.k").cast("long")
    log = events.select(
        outcome.alias("outcome"),
        F.when(kind == "signup", "too_short").when(kind == "purchase", "disabled").otherwise("").alias("bypass_semantic"),
        (F.lit(0.9) + k / 1000).alias("score"),
        tx.token_estimate(k).alias("saved_input_tokens"),
        tx.token_estimate(k * 3).alias("saved_output_tokens"),
    )
    return qa_cache.metrics(log)


# --- catalogue ---------------------------------------------------------------

_PAGE = catalog.VotationFilter(
    date_from=datetime(1996, 1, 1, tzinfo=timezone.utc), level="cantonal", lang="rm", limit=50, offset=20
)
_EVERY = catalog.VotationFilter(lang="it", limit=100)


def _catalog(spark, sf):
    return views.catalog_documents(spark, sf), views.catalog_translations(spark, sf)


def _flat_items(items):
    return items.select(
        "votation_id",
        "date_iso",
        "level",
        "canton",
        "commune_code",
        "status",
        "language",
        _json_map("titles", "titles"),
        _json_map("display_titles", "display_titles"),
        "translation_state",
        "fallback_language",
    )


@query
def votation_total(spark, sf):
    return catalog.total_votations(views.catalog_documents(spark, sf), _PAGE)


@query
def votation_page(spark, sf):
    return _flat_items(catalog.list_votations(*_catalog(spark, sf), _PAGE, views.as_of()).items)


@query
def votation_page_undated(spark, sf):
    return _flat_items(catalog.list_votations(*_catalog(spark, sf), _EVERY, views.as_of()).items)


@query
def votation_row_page(spark, sf):
    found = catalog.list_votations(*_catalog(spark, sf), _PAGE, views.as_of(), compat_row_paging=True)
    return _flat_items(found.items)


@query
def votation_page_objects(spark, sf):
    return catalog.list_votations(*_catalog(spark, sf), _PAGE, views.as_of()).objects


@query
def votation_page_sources(spark, sf):
    return catalog.list_votations(*_catalog(spark, sf), _PAGE, views.as_of()).sources


@query
def votation_pending_jobs(spark, sf):
    return catalog.list_votations(*_catalog(spark, sf), _EVERY, views.as_of()).pending


@query
def votation_detail(spark, sf):
    """Detail of every votation, German preferred."""
    return _flat_items(catalog.get_votation(*_catalog(spark, sf), None, "de", views.as_of()).items)


@query
def object_list(spark, sf):
    return catalog.list_objects(*_catalog(spark, sf), lang="de")


@query
def object_detail(spark, sf):
    found = catalog.get_object(*_catalog(spark, sf), lang="it")
    return found.withColumns({"tags": F.array_join("tags", ","), "source_systems": F.array_join("source_systems", ",")})


@query
def object_sources(spark, sf):
    return catalog.list_object_sources(views.catalog_documents(spark, sf))


@query
def taxonomies(spark, sf):
    return catalog.taxonomies(*_catalog(spark, sf))


@query
def translation_left_join(spark, sf):
    """Titles in one language beside every document."""
    docs, translations = _catalog(spark, sf)
    one = translations.filter("lang = 'fr'").select(F.col("document_id").alias("id"), "title")
    return docs.select("id", "votation_id").join(one, "id", "left").select(
        "id", "votation_id", F.coalesce("title", F.lit("")).alias("title")
    )


# --- mutations, state, translations ------------------------------------------


@query
def upsert_latest(spark, sf):
    """Open writes upserted into the finished ones; the batch wins per key."""
    writes = views.translation_writes(spark, sf)
    keys = ["document_id", "lang"]
    current = snapshot.latest(writes.filter("line = 'F'"), keys, views.write_order())
    merged = snapshot.upsert(current, writes.filter("line = 'O'"), keys, views.write_order())
    return merged.select("document_id", "lang", "title", "content_normalized", "line")


@query
def replace_documents(spark, sf):
    """Documents with any open write are replaced as a whole."""
    writes = views.translation_writes(spark, sf)
    replaced = snapshot.replace_groups(writes.filter("line = 'F'"), writes.filter("line = 'O'"), "document_id")
    return replaced.groupBy("document_id").agg(
        F.count("*").alias("rows"), F.max("written_at").cast("timestamp_ntz").alias("newest"), F.min("line").alias("line")
    )


@query
def index_skip_decisions(spark, sf):
    docs = views.corpus_documents(spark, sf)
    state, translations = views.index_state(spark, sf)
    return skip.skip_decisions(docs, state, translations)


@query
def index_to_process(spark, sf):
    docs = views.corpus_documents(spark, sf)
    state, translations = views.index_state(spark, sf)
    left = skip.to_process(docs, skip.skip_decisions(docs, state, translations))
    return left.select("document_id", "lang")


@query
def index_state_merge(spark, sf):
    """Stored document state beside its translations' states."""
    docs, translations = _catalog(spark, sf)
    status = F.get_json_object("metadata", "$.translation_status")
    langs = translations.groupBy("document_id").agg(
        F.count("*").alias("translations"), F.sum((status == "ready").cast("long")).alias("ready")
    )
    joined = docs.select("id", "status").join(langs, F.col("id") == F.col("document_id"), "full_outer")
    return joined.select(
        F.coalesce("id", "document_id").alias("document_id"),
        "status",
        F.coalesce("translations", F.lit(0)).alias("translations"),
        F.coalesce("ready", F.lit(0)).alias("ready"),
    )


@query
def missing_translations(spark, sf):
    return translation.missing_pairs(views.corpus_documents(spark, sf))


@query
def translation_plan(spark, sf):
    docs = views.corpus_documents(spark, sf)
    _, stored = views.index_state(spark, sf)
    # Stored German texts made from the same source are reusable.
    german = stored.withColumn("lang", F.lit("de"))
    planned = translation.plan_translations(docs, german)
    return planned.select(
        "document_id", "lang", "title", "origin", "provider", "source_lang", "source_hash", _sha("content").alias("content_sha")
    )


@query
def best_source_translation(spark, sf):
    translations = views.catalog_translations(spark, sf)
    targets = views.catalog_documents(spark, sf).select(F.col("id").alias("document_id"), F.lit("en").alias("target_lang"))
    return translation.best_source_translation(translations, targets).select("document_id", "target_lang", "lang", "title")


@query
def pending_translations(spark, sf):
    """Requests that call a provider, from a log of requests and ends of jobs; a
    job that never ends blocks its pair for two days here."""
    kind, lang = F.col("event_type"), F.col("lang")
    target = F.when(kind == "view", "en").when(kind == "signup", "fr").when(kind == "error", "it").otherwise("de")
    events = table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("orders:"), F.col("user_id").cast("string")).alias("document_id"),
        target.alias("target_lang"),
        F.col("ts").cast("timestamp").alias("asked_at"),
        (kind == "purchase").alias("is_end"),
    )
    stored = views.catalog_translations(spark, sf).select(
        "document_id", "lang", "title", F.col("content_normalized").alias("content"), F.get_json_object("metadata", "$.translation_status").alias("status")
    )
    own = ids.translation_source_hash(lang, F.col("title"), F.col("content"))
    english = F.max(F.when(lang == "en", own)).over(Window.partitionBy("document_id"))  # one row a language
    return translation.jobs_to_start(events, stored.withColumn("source_hash", english), 2 * 86400)


@query
def metrics_source_pick(spark, sf):
    docs = views.catalog_translations(spark, sf).withColumn("source_path", F.lit(""))
    return translation.pick_metrics_source(docs, "it").select("document_id", "lang", tx.byte_len(F.col("title")).alias("title_bytes"))


@query
def first_seen_sources(spark, sf):
    """First document of each source uri, newest vote first."""
    from corpusmill.operators.select import first_per_key

    docs = views.catalog_documents(spark, sf).select("source_uri", "id", "vote_date")
    first = first_per_key(docs, ["source_uri"], [F.desc_nulls_last("vote_date"), F.asc("id")])
    return first.select("source_uri", "id")


# --- usage -------------------------------------------------------------------

_USAGE = usage.UsageFilter(
    start=datetime(2024, 1, 5, 6, tzinfo=timezone.utc),
    end=datetime(2024, 1, 20, 12, tzinfo=timezone.utc),
    flow="rag_index",
    limit=200,
    offset=10,
)


@query
def usage_events(spark, sf):
    return views.usage_events(spark, sf).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query
def usage_daily(spark, sf):
    return usage.daily_usage(views.usage_events(spark, sf))


@query
def usage_events_page(spark, sf):
    found = usage.events_page(views.usage_events(spark, sf), _USAGE)
    return found.select("event_id", dates.utc_text(F.col("created_at")).alias("created_at"), "flow", "operation", "mode", "total_tokens")


@query
def usage_events_middle(spark, sf):
    """The 500 events after the newer half, whose offset grows with the table."""
    events = views.usage_events(spark, sf)
    found = usage.events_deep_page(events, usage.UsageFilter(limit=500, offset=events.count() // 2))
    return found.select("event_id", dates.utc_text(F.col("created_at")).alias("created_at"), "flow", "total_tokens")


@query
def usage_daily_page(spark, sf):
    return usage.daily_page(usage.daily_usage(views.usage_events(spark, sf)), _USAGE)


@query
def usage_per_document(spark, sf):
    return usage.per_document(views.usage_events(spark, sf))


@query
def usage_daily_stream(spark, sf):
    """The daily aggregate kept by a stream over the events table."""
    from corpusmill.session import work_folder
    from corpusmill.streaming import usage as stream

    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    scoped = usage.apply_scope(views.usage_from(raw), flow="rag_index")
    events = usage.normalize_events(scoped, views.as_of()).filter("valid").drop("valid")
    folder = work_folder(spark)
    stream.write_updates(stream.daily_stream(events), f"{folder}/daily", f"{folder}/checkpoint").awaitTermination()
    return stream.read_daily(spark, f"{folder}/daily")


@query
def usage_daily_once(spark, sf):
    """The daily aggregate of a log that delivers each event one to three times,
    read by a stream that stops half-way and goes on."""
    from corpusmill.session import work_folder
    from corpusmill.streaming import usage as stream

    folder, log = work_folder(spark), views.usage_events(spark, sf)
    times = F.sequence(F.lit(0), F.pmod(F.xxhash64("event_id"), F.lit(3)).cast("int"))
    repeated = log.withColumn("delivery", F.explode(times))
    for number in range(3):
        repeated.filter(F.col("delivery") == number).drop("delivery").write.mode("append").parquet(f"{folder}/log")
        if number == 1:
            continue  # two deliveries wait when the stream goes on
        source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/log")
        daily = stream.daily_stream(source, once_within="366 days")
        stream.write_updates(daily, f"{folder}/daily", f"{folder}/checkpoint").awaitTermination()
    return stream.read_daily(spark, f"{folder}/daily")


@query
def cache_replay(spark, sf):
    """Hits and misses of a question log; few keys, so every key is hot."""
    from corpusmill.operators.cache_replay import replay_exact

    log = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("key"), F.col("ts").cast("timestamp").alias("asked_at")
    )
    return replay_exact(log, 6 * 3600).outcomes


# --- votes from payloads -----------------------------------------------------


@query
def selected_votings(spark, sf):
    found = votes.select_votings(views.votings(spark, sf), dates.moment("2001-07-25T00:00:00Z"), 30)
    return found.select("voting_id", "selection_strategy")


@query
def vote_display_titles(spark, sf):
    joined = views.votings(spark, sf).join(views.affairs(spark, sf).withColumnRenamed("title", "affair"), "voting_id")
    shown = votes.display_titles(F.col("affair_title"), F.col("affair"), F.col("title"))
    return joined.select("voting_id", shown.alias("m")).select("voting_id", _json_map("m", "titles"))


@query
def vote_languages(spark, sf):
    docs = views.vote_docs(spark, sf).select(F.col("position").alias("voting_id"), "language")
    texts = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("voting_id"), F.create_map(F.lit("EN"), F.col("text")).alias("text")
    )
    found = votes.available_languages(views.votings(spark, sf), views.affairs(spark, sf), docs, texts)
    return found.select("voting_id", F.array_join("available_languages", ",").alias("languages"))


@query
def vote_initiants(spark, sf):
    return votes.initiants(views.contributors(spark, sf))


@query
def vote_arguments(spark, sf):
    return votes.argument_pieces(views.vote_docs(spark, sf), views.vote_texts(spark, sf))


@query
def vote_locations(spark, sf):
    return votes.locations(*views.body_pages(spark, sf))


@query
def crawl_levels(spark, sf):
    from corpusmill.sources.crawl import crawl, from_table

    seeds, pages = views.link_pages(spark, sf)
    # joined and nested from tables, and looked into on every level
    return crawl(seeds, from_table(cut_lineage(pages))).select("voting_id", "depth", "url", "label")


@query
def stored_filters(spark, sf):
    """Filter columns read back from documents' metadata."""
    from corpusmill.plans.index_job import filter_columns

    orders = table(spark, sf, "orders")
    place = F.when(F.col("o_orderstatus") == "F", "Federal").otherwise("")
    day = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("")
    meta = F.to_json(F.struct(place.alias("level"), F.lit(" ge ").alias("canton"), day.alias("vote_date")))
    staged = orders.select("o_orderkey", F.col("o_orderkey").cast("string").alias("external"), meta.alias("meta"))
    found = staged.withColumns(filter_columns(F.col("meta"), F.col("external"), views.as_of()))
    return found.select(
        "o_orderkey", "votation_id", "object_id", "level", "canton", "status", "source_type", dates.utc_text(F.col("vote_date")).alias("vote_date")
    )


@query
def people_from_names(spark, sf):
    """Names split, short ones dropped, repeats removed ignoring case."""
    from corpusmill.sources.files import persons_from_list

    docs = views.corpus_documents(spark, sf)
    named = docs.select("document_id", F.posexplode(persons_from_list(F.col("content"), "[.]")).alias("at", "p"))
    return named.select("document_id", "at", F.concat_ws("~", "p.first_name", "p.last_name").alias("name"))


@query
def language_view(spark, sf):
    """A JSON document reduced to one language, empty branches pruned."""
    docs = table(spark, sf, "documents")
    body = F.struct(
        F.create_map(F.lit("fr"), F.col("source"), F.lit("de"), F.lit(" ")).alias("title"),
        F.struct("doc_id", F.lit(" ").alias("blank")).alias("doc"),
        F.create_map(F.lit("text"), F.create_map(F.lit("fr"), F.col("text"))).alias("body"),
    )
    built = docs.select("doc_id", F.to_json(body.alias("b")).alias("body"))
    fr, de = js.project_language(F.col("body"), F.lit("fr")), js.project_language(F.col("body"), F.lit("de"))
    return built.select("doc_id", ids.sha256(fr).alias("fr_sha"), de.alias("de_view"))


@query
def metadata_sanitized(spark, sf):
    """Contact keys and nulls removed at any depth."""
    people = table(spark, sf, "customer")
    body = F.to_json(
        F.struct(
            F.col("c_name").alias("name"),
            F.struct(F.lit("a@b.ch").alias("Contact_Email"), F.col("c_mktsegment").alias("segment")).alias("more"),
            F.lit("x").alias("email"),
        )
    )
    return people.select("c_custkey", js.remove_sensitive(body).alias("clean"))


def _persons(column: str):
    people = F.transform(F.col(column), lambda p: F.concat_ws("~", p["first_name"], p["last_name"], p["role"]))
    return F.array_join(people, "|").alias("people")


@query
def vote_json_rows(spark, sf):
    """Normalised votes: one row per language, its text, filters and people."""
    from corpusmill.sources.json_docs import json_documents

    rows = json_documents(views.vote_files(spark, sf), views.as_of())
    filters = ["votation_id", "object_id", "object_type", "level", "canton", "commune_code", "status", "vote_date"]
    return rows.select(
        "document_id",
        "lang",
        "title",
        F.array_join("available_languages", ",").alias("languages"),
        _persons("persons"),
        *[F.get_json_object("metadata", f"$.{name}").alias(name) for name in filters],
        _sha("content").alias("content_sha"),
    )


@query
def generic_json_rows(spark, sf):
    """Dataset listings and other objects, contact data removed."""
    from corpusmill.sources.json_docs import json_documents

    rows = json_documents(views.dataset_files(spark, sf), views.as_of())
    return rows.select(
        "document_id",
        "translation_id",
        "lang",
        "title",
        "source_org",
        "source_uri",
        "license_uri",
        dates.utc_text(F.col("issued_at")).alias("issued"),
        F.array_join("available_languages", ",").alias("languages"),
        _persons("persons"),
        _sha("content").alias("content_sha"),
    )
