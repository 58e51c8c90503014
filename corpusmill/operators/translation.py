"""Translations: which are missing, which can be reused, which to make."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv
from corpusmill.functions import ids
from corpusmill.functions import lang as lg
from corpusmill.functions import text as tx
from corpusmill.operators.cache_replay import replay_exact
from corpusmill.operators.select import first_per_key
from corpusmill.session import cut_lineage

Translate = Callable[[str, str, str, str], str]  # text, source language, target language, what the text is


class Translator(Protocol):
    name: str

    def translate(self, text: str, source: str, target: str, label: str) -> str: ...


class DisabledTranslator:
    """The translator of the local mode."""

    name = "disabled"

    def translate(self, text: str, source: str, target: str, label: str) -> str:
        raise RuntimeError("translation is disabled in local mode")


class EmptyAnswer(Exception):
    """A model answered without usable text; worth another attempt."""


class ModelTranslator:
    """A chat model behind ``prompt -> answer`` with the request rules applied."""

    def __init__(
        self,
        name: str,
        ask: Callable[[str], str],
        max_bytes: int | None = None,
        retries: int = 2,
    ):
        self.name, self._ask, self._max_bytes, self._retries = name, ask, max_bytes, retries

    def translate(self, text: str, source: str, target: str, label: str) -> str:
        body = text.strip()
        if not body:
            raise ValueError("translation text is required")
        if not target:
            raise ValueError("target language is required")
        if source == target:
            return body
        if self._max_bytes is not None and len(body.encode()) > self._max_bytes:
            raise ValueError("translation input exceeds the configured limit")
        prompt = fv.TRANSLATION_PROMPT.format(label=label or "content", source=source, target=target, text=body)
        for attempt in range(self._retries + 1):
            try:
                answer = self._ask(prompt).strip()
                if answer:
                    return answer
                raise EmptyAnswer("model returned no text")
            except EmptyAnswer:
                if attempt == self._retries:
                    raise
        raise AssertionError("unreachable")


def make_translator(mode: str, model: Translator | None = None) -> Translator:
    if mode == "local":
        return DisabledTranslator()
    if mode == "llm":
        if model is None:
            raise ValueError("llm mode needs a model translator")
        return model
    raise ValueError(f"unknown mode: {mode}")


def pick_source(docs: DataFrame, supported: Sequence[str] = fv.SUPPORTED_LANGUAGES) -> DataFrame:
    """One row per document: its best source language."""
    order = list(dict.fromkeys([*fv.SOURCE_PREFERENCE, *supported]))
    return first_per_key(docs, ["document_id"], [lg.rank_in(F.col("lang"), order), F.asc("lang")])


def pick_metrics_source(docs: DataFrame, default: str = fv.DEFAULT_LANGUAGE) -> DataFrame:
    """The row whose sizes stand for the document: default language, French, first."""
    order = list(dict.fromkeys([default.strip().lower(), "fr"]))
    return first_per_key(docs, ["document_id"], [lg.rank_in(F.lower(tx.trim(F.col("lang"))), order), F.asc("source_path"), F.asc("lang")])


def best_source_translation(translations: DataFrame, targets: DataFrame) -> DataFrame:
    """For (document, target) pairs: English, French, then alphabetical, never the target."""
    pairs = targets.select("document_id", "target_lang")
    candidates = pairs.join(translations, "document_id").filter(F.col("lang") != F.col("target_lang"))
    return first_per_key(candidates, ["document_id", "target_lang"], [lg.rank_in(F.col("lang"), ["en", "fr"]), F.asc("lang")])


def missing_pairs(docs: DataFrame, supported: Sequence[str] = fv.SUPPORTED_LANGUAGES) -> DataFrame:
    """(document, language) pairs with no text. The language list is a literal,
    so the product is an explode, and present pairs go by anti join."""
    every = docs.select("document_id").distinct().withColumn("lang", F.explode(F.array(*[F.lit(c) for c in supported])))
    return every.join(docs.select("document_id", "lang"), ["document_id", "lang"], "left_anti")


def plan_translations(
    docs: DataFrame,
    stored: DataFrame,
    supported: Sequence[str] = fv.SUPPORTED_LANGUAGES,
    default: str = fv.DEFAULT_LANGUAGE,
) -> DataFrame:
    """Every (document, supported language) with how it is obtained.

    ``origin`` is ``source`` (in the corpus), ``reused`` (stored, ready, made
    from the same source text) or ``translate`` (still to be made; title and
    content are the source's).
    """
    fallback = lg.normalize_code(default)
    fallback = fallback if fallback in supported else fv.DEFAULT_LANGUAGE
    coded = docs.withColumn("lang", lg.normalize_or(F.col("lang"), fallback, supported))
    own = first_per_key(coded, ["document_id", "lang"], [F.desc("source_path")]).select(
        "document_id", "lang", "title", "content"
    )
    source = pick_source(own, supported).select(
        "document_id",
        F.col("lang").alias("source_lang"),
        F.col("title").alias("source_title"),
        F.col("content").alias("source_content"),
    )
    source = source.withColumn(
        "source_hash", ids.translation_source_hash(F.col("source_lang"), F.col("source_title"), F.col("source_content"))
    )
    wanted = missing_pairs(own, supported).join(source, "document_id")
    usable = stored.filter((F.col("status") == "ready") & (tx.trim(F.col("content")) != "") & (tx.trim(F.col("source_hash")) != ""))
    usable = usable.select(
        "document_id",
        "lang",
        "source_hash",
        F.col("title").alias("stored_title"),
        F.col("content").alias("stored_content"),
        F.col("provider").alias("stored_provider"),
    )
    filled = wanted.join(usable, ["document_id", "lang", "source_hash"], "left")
    reused = F.col("stored_content").isNotNull()
    made = filled.select(
        "document_id",
        "lang",
        F.when(reused, tx.non_empty(F.col("stored_title"), F.col("source_title"))).otherwise(F.col("source_title")).alias("title"),
        F.when(reused, tx.squeeze(F.col("stored_content"))).otherwise(F.col("source_content")).alias("content"),
        F.when(reused, "reused").otherwise("translate").alias("origin"),
        F.when(reused, tx.non_empty(F.col("stored_provider"), F.lit("existing_db"))).otherwise("").alias("provider"),
        "source_lang",
        "source_hash",
    )
    kept = own.filter(F.col("lang").isin(*supported)).select(
        "document_id",
        "lang",
        "title",
        "content",
        F.lit("source").alias("origin"),
        F.lit("source").alias("provider"),
        F.col("lang").alias("source_lang"),
        ids.translation_source_hash(F.col("lang"), F.col("title"), F.col("content")).alias("source_hash"),
    )
    return kept.unionByName(made)


def run_translations(jobs: DataFrame, translator: Translator, on_error: str = "raise") -> DataFrame:
    """Translate title and content of each row from ``source_lang`` to ``lang``.

    Adds ``status``: ``ready``, or ``failed`` with the source text kept when
    ``on_error`` is ``mark``. Providers run inside tasks, a batch at a time.
    """
    if on_error not in ("raise", "mark"):
        raise ValueError("on_error must be raise or mark")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = []
            for row in rows.itertuples(index=False):
                title, content, status = row.title, row.content, "ready"
                try:
                    title = translator.translate(row.title, row.source_lang, row.lang, "title")
                    content = translator.translate(row.content, row.source_lang, row.lang, "document content")
                except Exception:
                    if on_error == "raise":
                        raise
                    title, content, status = row.title, row.content, "failed"
                done.append((title, content, status))
            texts = pd.DataFrame(done, columns=["title", "content", "status"], index=rows.index)
            yield rows.assign(title=texts["title"], content=texts["content"], status=texts["status"], provider=translator.name)

    schema = jobs.withColumn("status", F.lit("")).schema
    translated = jobs.withColumn("status", F.lit("")).mapInPandas(work, schema)
    return translated.withColumn("content", tx.squeeze(F.col("content")))


def ensure_translations(docs: DataFrame, stored: DataFrame, translator: Translator, supported: Sequence[str] = fv.SUPPORTED_LANGUAGES, default: str = fv.DEFAULT_LANGUAGE) -> DataFrame:
    """All supported languages of every document; only missing ones are made."""
    planned = plan_translations(docs, stored, supported, default)
    ready = planned.filter("origin <> 'translate'").withColumn("status", F.lit("ready"))
    made = run_translations(planned.filter("origin = 'translate'"), translator)
    return ready.unionByName(made)


def already_ready(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Jobs whose stored translation is ready and made from the same source."""
    done = stored.filter("status = 'ready'").select("document_id", F.col("lang").alias("target_lang"), "source_hash")
    return jobs.join(done, ["document_id", "target_lang", "source_hash"], "left_semi")


def in_flight(events: DataFrame, seconds: int = fv.TRANSLATION_JOB_SECONDS) -> DataFrame:
    """``event_id, document_id, target_lang, outcome`` of every request: ``started``,
    or ``joined`` where a job for the same document and language was under way.

    ``events``: ``event_id, document_id, target_lang, asked_at, is_end``. A job is
    under way until an end is reported for it, or until its deadline, so that one
    that never finished blocks nobody for longer. Of one moment ends come first,
    then requests by id; ends without a job do nothing.

    Ends cut a pair's requests into parts that do not know of each other; within a
    part the starts are a chain, found by joins and not by walking it.
    """
    pair = ["document_id", "target_lang"]
    order = Window.partitionBy(*pair).orderBy("asked_at", F.desc("is_end"), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    parts = events.withColumn("part", F.sum(F.col("is_end").cast("long")).over(order)).filter("not is_end")
    keyed = parts.select("event_id", *pair, "asked_at", F.to_json(F.struct(*pair, "part")).alias("key"))
    outcomes = replay_exact(keyed, seconds).outcomes.select("key", "event_id", F.when(F.col("outcome") == "miss", "started").otherwise("joined").alias("outcome"))
    return outcomes.select("event_id", "outcome", F.from_json("key", "document_id string, target_lang string").alias("k")).select("event_id", "k.document_id", "k.target_lang", "outcome")


def jobs_to_start(events: DataFrame, translations: DataFrame, seconds: int = fv.TRANSLATION_JOB_SECONDS) -> DataFrame:
    """``event_id, document_id, target_lang, source_lang, source_hash`` of the requests
    that call a provider: none of the pair is under way, a source exists and no ready
    translation was made from it. ``translations``: ``document_id, lang, title,
    content, status, source_hash``. Those of requested documents are read once, as
    hashes of their texts."""
    own = ids.translation_source_hash(F.col("lang"), F.col("title"), F.col("content"))
    started = cut_lineage(in_flight(events, seconds).filter("outcome = 'started'").select("event_id", "document_id", "target_lang"))
    requested = translations.join(started.select("document_id").distinct(), "document_id", "left_semi")
    hashes = cut_lineage(requested.select("document_id", "lang", "status", "source_hash", own.alias("own_hash")))
    sources = best_source_translation(hashes, started.select("document_id", "target_lang").distinct())
    jobs = sources.select("document_id", "target_lang", F.col("lang").alias("source_lang"), F.col("own_hash").alias("source_hash"))
    ready = already_ready(jobs, hashes).select("document_id", "target_lang")
    return started.join(jobs.join(ready, ["document_id", "target_lang"], "left_anti"), ["document_id", "target_lang"])


def translate_pending(pending: DataFrame, translations: DataFrame, translator: Translator, as_of: Column) -> DataFrame:
    """The background job: pending (document, target) pairs to translation rows.

    Duplicate requests collapse, ready ones drop out, a failed one keeps the
    source text. The result is upserted on (document_id, lang).
    """
    requests = pending.select("document_id", "target_lang").distinct()
    sources = best_source_translation(translations, requests)
    jobs = sources.select(
        "document_id",
        "target_lang",
        F.col("lang").alias("source_lang"),
        "title",
        "content",
        ids.translation_source_hash(F.col("lang"), F.col("title"), F.col("content")).alias("source_hash"),
    )
    ready = already_ready(jobs, translations).select("document_id", "target_lang")
    todo = jobs.join(ready, ["document_id", "target_lang"], "left_anti").withColumnRenamed("target_lang", "lang")
    done = run_translations(todo.withColumn("provider", F.lit("")), translator, on_error="mark")
    return done.withColumns(
        {
            "title": tx.non_empty(F.col("title"), F.lit("Untitled")),
            "content": tx.non_empty(F.col("content"), F.col("title")),
            "updated_at": as_of,
        }
    )
