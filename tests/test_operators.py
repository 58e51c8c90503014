"""Dataflow operators on small fixtures, against brute force."""

import math
import random
import sys
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusmill.functions import dates
from corpusmill.functions import fixed_values as fv
from corpusmill.operators import cache_replay, models, qa, qa_cache, search, skip, snapshot, stats, summary, translation, usage, votes
from corpusmill.operators.chunking import ChunkPlan, chunk_documents, expected_chunks
from corpusmill.operators.embedding import HashEmbedder, ModelEmbedder, make_embedder

UTC = timezone.utc

# Test doubles run inside tasks; send them by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


# --- chunks ------------------------------------------------------------------


def windows(n, size, step):
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        out.append((start, end))
        if end == n:
            break
        start += step
    return out


@pytest.mark.parametrize("size, overlap", [(512, 0.10), (768, 0.15), (1024, 0.20)])
def test_C2_closed_form_equals_the_loop(spark, size, overlap):
    plan = ChunkPlan(size, overlap)
    rows = spark.range(0, 4000).select("id", expected_chunks(F.col("id"), plan).alias("n")).collect()
    assert all(row.n == len(windows(row.id, size, plan.step)) for row in rows)


def test_C1_chunks(spark):
    texts = {"a:1": 1200, "b:2": 600, "c:3": 0, "d:4": 20000}
    docs = spark.createDataFrame(
        [(k, f"{k}:fr", " ".join(f"w{i}" for i in range(n)) + " ") for k, n in texts.items()],
        "document_id string, translation_id string, content string",
    )
    rows = chunk_documents(docs, ChunkPlan(512, 0.10)).orderBy("document_id", "part").collect()
    for key, n in texts.items():
        own = [r for r in rows if r.document_id == key]
        assert [(r.content.split()[0], r.token_count) for r in own] == [
            (f"w{s}", e - s) for s, e in windows(n, 512, 461)
        ]
    assert rows[0].token_count == 512 and rows[0].chunk_id == "a_1_fr_chunk_0000"


def test_chunk_bounds():
    with pytest.raises(ValueError):
        ChunkPlan(256, 0.15)
    with pytest.raises(ValueError):
        ChunkPlan(768, 0.30)


def test_A7_A8_A9_statistics(spark):
    chunks = spark.createDataFrame(
        [("c1", "doc-a", "T", "p", "fr", "s1", 100), ("c2", "doc-a", "T2", "p2", "fr", "", 200), ("c3", "doc-b", "U", "q", "", "s1", 300)],
        "chunk_id string, document_id string, title string, source_path string, lang string, source_system string, token_count int",
    )
    assert tuple(stats.chunk_token_stats(chunks).first()) == (3, 100, 200, 300, 300)
    assert [tuple(r) for r in stats.chunk_counts(chunks, "lang").collect()] == [("fr", 2), ("unknown", 1)]
    assert [tuple(r) for r in stats.top_documents(chunks, 1).collect()] == [("doc-a", 2, "T", "p")]


def test_A7_nearest_rank(spark):
    for n in (1, 3, 19, 20, 21, 40, 100):
        chunks = spark.range(1, n + 1).select(F.col("id").cast("int").alias("token_count"))
        assert stats.chunk_token_stats(chunks).first().tokens_p95 == math.ceil(0.95 * n)


# --- vectors -----------------------------------------------------------------


def vector_frames(spark, n=300, q=40, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim)).astype(np.float32)
    base[50] = base[7]  # a copy: ties must go by id
    base[60] = 0
    ask = rng.normal(size=(q, dim)).astype(np.float32)
    ask[5] = base[7]
    items = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)], "item_id long, embedding array<float>, ctx int")
    queries = spark.createDataFrame([(i, v.tolist(), int(i % 3)) for i, v in enumerate(ask)], "query_id long, embedding array<float>, ctx int")
    return base.astype(float), ask.astype(float), items, queries


def brute(base, ask, k, allowed=lambda q, i: True):
    out = set()
    for q, vec in enumerate(ask):
        scored = []
        for i, other in enumerate(base):
            norm = np.linalg.norm(vec) * np.linalg.norm(other)
            score = -1.0 if norm == 0 else round(float(vec @ other / norm), 10)
            if allowed(q, i):
                scored.append((-score, i))
        for rank, (score, i) in enumerate(sorted(scored)[:k], 1):
            out.add((q, i, rank, round(-score, 6)))
    return out


def as_set(df):
    return {(r.query_id, r.item_id, r["rank"], round(r.score, 6)) for r in df.collect()}


@pytest.mark.parametrize("budget", [1 << 25, 200])
def test_T4_nearest_is_exact_on_both_paths(spark, budget):
    base, ask, items, queries = vector_frames(spark)
    found = search.nearest(items.repartition(5), queries, 8, 4, broadcast_budget=budget, queries_per_block=15, vectors_per_slice=70)
    assert as_set(found) == brute(base, ask, 4)


@pytest.mark.parametrize("budget", [1 << 25, 200])
def test_J6_best_entry_of_the_same_context(spark, budget):
    base, ask, items, queries = vector_frames(spark)
    found = search.nearest_in_small(queries, items, 8, within="ctx", broadcast_budget=budget)
    expected = {(q, i, s) for q, i, _, s in brute(base, ask, 1, lambda q, i: q % 3 == i % 3)}
    assert {(r.query_id, r.item_id, round(r.score, 6)) for r in found.collect()} == expected


def test_D26_dimension_mismatch_raises():
    with pytest.raises(ValueError):
        search.check_dimensions([1.0], 2)
    with pytest.raises(ValueError):
        search.check_dimensions([], 2)


def test_C8_C22_embedders(spark):
    assert make_embedder("local").name == "deterministic"
    for bad in ("other", "llm"):
        with pytest.raises(ValueError):
            make_embedder(bad)
    model = ModelEmbedder("m", 2, lambda texts: [[len(t), 1.0] for t in texts], max_bytes=5)
    df = spark.createDataFrame([(" abc ",)], "x string")
    assert df.select(model.embed(F.col("x"))).first()[0] == [3.0, 1.0]
    for text, embedder in ((" ", HashEmbedder(4)), ("too long", model)):
        with pytest.raises(Exception, match="embedding input"):
            spark.createDataFrame([(text,)], "x string").select(embedder.embed(F.col("x"))).collect()


# --- answers -----------------------------------------------------------------


def hits_frame(spark, rows):
    full = [(1, i + 1, *row) for i, row in enumerate(rows)]
    return spark.createDataFrame(
        full,
        "query_id int, rank int, score double, document_id string, source_path string, title string, content string, "
        "source_system string, source_uri string, lang string",
    ).withColumn("persons", F.array().cast("array<struct<first_name:string,last_name:string,role:string>>"))


def test_C10_one_highlight_per_source(spark):
    hits = hits_frame(
        spark,
        [
            (0.9, "a", "p", "A", "First text", "openparl", "u", "fr"),
            (0.8, "a", "p", "A", "Second text", "openparl", "u", "fr"),
            (0.4, "b", "q", "Title b", " ", "x", "v", "fr"),
            (0.3, "c", "r", "C", "Third", "x", "v", "fr"),
        ],
    )
    h = F.col("hits")
    row = summary.gather_hits(hits).select(
        summary.extractive_summary(h, F.lit("en-GB")).alias("answer"),
        summary.confidence(h).alias("confidence"),
        summary.used_documents(h).alias("used"),
        summary.citations(h).alias("cited"),
    ).first()
    assert row.answer == fv.SUMMARY_PREFIX["en"] + " First text. Title b."
    assert row.confidence == 0.6 and row.used == ["a", "b", "c"]
    assert [tuple(c) for c in row.cited] == [("official", "u", "A"), ("other", "v", "Title b"), ("other", "v", "C")]


def test_C11_prompt_spends_its_budget_in_rank_order(spark):
    hits = hits_frame(spark, [(0.5, f"d{i}", f"p{i}", "T", "é" * 250, "s", "u", "") for i in range(9)])
    prompt = summary.prompts(hits, F.lit("Q?"), F.lit("de"), 1200).first().prompt
    used, expected = 0, fv.PROMPT_QUESTION_HEAD + "Q?" + fv.PROMPT_EXCERPTS_HEAD
    budget = max(800, 1200 - len(expected.encode()) - 220)
    for i in range(8):
        header = f"\n[{i + 1}] source=p{i} title=T lang=fr score=0.5000 source_uri=u intervenants=none\n"
        if used >= budget:
            break
        expected, used = expected + header, used + len(header.encode())
        if used >= budget:
            break
        text = ("é" * 250).encode()[: budget - used].decode(errors="ignore")
        expected, used = expected + text + "\n", used + 500
    assert prompt == expected + "\n" + fv.PROMPT_INSTRUCTION.format(lang="de")


def qa_chunks(spark):
    texts = ["Eine Vorlage zur Energie", "Un projet sur la sante", "Altra cosa"]
    rows = [(f"c{i}", f"d{i}", f"p{i}", f"T{i}", t, "de", "openparldata", f"u{i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(
        rows, "chunk_id string, document_id string, source_path string, title string, content string, lang string, source_system string, source_uri string"
    )
    persons = F.array().cast("array<struct<first_name:string,last_name:string,role:string>>")
    return df.withColumns({"embedding": HashEmbedder(16).embed(F.col("content")), "persons": persons})


def test_C13_identical_text_is_found_first(spark):
    asked = spark.createDataFrame(
        [(1, "Un projet sur la sante", "fr"), (2, "Un projet sur la sante", "fr"), (3, "  ", "de")],
        "question_id int, question string, language string",
    )
    rows = {r.question_id: r for r in qa.answer_questions(asked, qa_chunks(spark), HashEmbedder(16), qa.QASettings(top_k=1)).collect()}
    assert rows[1].answer == rows[2].answer == fv.SUMMARY_PREFIX["fr"] + " Un projet sur la sante."
    assert rows[1].confidence == 1.0 and rows[1].used_documents == ["d1"]
    assert rows[3].answer == fv.NO_RELEVANT_SOURCE["de"] and rows[3].confidence == 0 and rows[3].citations == []


ENTRY = (
    "cache_key string, context_hash string, answer string, citations array<struct<source_type:string,url:string,title:string>>, "
    "confidence double, used_documents array<string>, created_at timestamp, expires_at timestamp"
)


def test_C14_cache_over_two_batches(spark, tmp_path):
    embedder = HashEmbedder(16)
    exact = spark.createDataFrame([], ENTRY)
    semantic = spark.createDataFrame([], ENTRY + ", embedding array<float>")
    chunks = qa_chunks(spark)
    long_text = "Wie wird ueber die Energie abgestimmt?"
    first = spark.createDataFrame(
        [(1, long_text), (2, long_text), (3, "kurz"), (4, "frag a@b.ch bitte")], "question_id int, question string"
    )
    run = qa.answer_with_cache(first, chunks, exact, semantic, embedder, dates.moment("2024-01-01T00:00:00Z"))
    got = {r.question_id: (r.outcome, r.bypass_semantic) for r in run.outcomes.collect()}
    assert got == {1: ("miss", ""), 2: ("exact_hit", ""), 3: ("miss", "too_short"), 4: ("bypass_sensitive", "")}
    run.exact_entries.write.parquet(f"{tmp_path}/exact")
    run.semantic_entries.write.parquet(f"{tmp_path}/semantic")
    exact, semantic = spark.read.parquet(f"{tmp_path}/exact"), spark.read.parquet(f"{tmp_path}/semantic")
    assert exact.count() == 2 and semantic.count() == 1
    # An hour later the exact entries are over, the semantic one is not.
    later = qa.answer_with_cache(first.limit(1), chunks, exact, semantic, embedder, dates.moment("2024-01-01T01:00:00Z"))
    row = later.outcomes.first()
    assert row.outcome == "semantic_hit" and row.score == pytest.approx(1.0)
    total = qa_cache.metrics(run.outcomes.unionByName(later.outcomes)).first()
    assert (total.exact_hits, total.semantic_hits, total.misses, total.bypass_sensitive_question) == (1, 1, 2, 1)
    assert total.hit_rate == 0.5 and total.semantic_hit_rate == 0.25


def test_semantic_threshold_rejects(spark):
    entries = spark.createDataFrame([("k", "ctx", [0.8, 0.6])], "cache_key string, context_hash string, embedding array<float>")
    asked = spark.createDataFrame([(1, "ctx", [1.0, 0.0]), (2, "no", [0.8, 0.6])], "query_id int, context_hash string, embedding array<float>")
    assert qa_cache.probe_semantic(asked, entries, 2, 0.95).count() == 0
    assert [r.query_id for r in qa_cache.probe_semantic(asked, entries, 2, 0.79).collect()] == [1]


def test_T6_D20_eviction_is_by_creation(spark):
    rows = [(f"k{i}", datetime(2024, 1, 1, i, tzinfo=UTC)) for i in range(5)]
    entries = spark.createDataFrame(rows, "cache_key string, created_at timestamp")
    assert {r.cache_key for r in qa_cache.evict_oldest(entries, 2).collect()} == {"k3", "k4"}


def replay_brute(log, ttl):
    expires, out = {}, {}
    for event, key, at in sorted(log, key=lambda e: (e[2], e[0])):
        hit = key in expires and at <= expires[key]
        if not hit:
            expires[key] = at + ttl
        out[event] = "exact_hit" if hit else "miss"
    return out


def test_replay_equals_the_sequential_cache(spark):
    rng = random.Random(5)
    start = datetime(2024, 1, 1, tzinfo=UTC)
    # One key holds most lookups, without any pause longer than the ttl.
    log = [(i, "hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", start + timedelta(seconds=rng.randrange(4000))) for i in range(400)]
    log += [(1000, "hot", start + timedelta(seconds=9000)), (1001, "edge", start), (1002, "edge", start + timedelta(seconds=60))]
    df = spark.createDataFrame(log, "event_id long, key string, asked_at timestamp")
    expected = replay_brute(log, timedelta(seconds=60))
    done = cache_replay.replay_exact(df, 60)
    assert {r.event_id: r.outcome for r in done.outcomes.collect()} == expected
    # The same log in two parts, the state handed on.
    cut = start + timedelta(seconds=2000)
    early = cache_replay.replay_exact(df.filter(F.col("asked_at") < F.lit(cut)), 60)
    late = cache_replay.replay_exact(df.filter(F.col("asked_at") >= F.lit(cut)), 60, early.state)
    assert {r.event_id: r.outcome for r in early.outcomes.unionByName(late.outcomes).collect()} == expected


# --- upserts, skip, translations ---------------------------------------------


def test_M2_last_writer_wins(spark):
    current = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    batch = spark.createDataFrame([("b", 2), ("b", 3), ("c", 1)], "k string, v int")
    merged = snapshot.upsert(current, batch, ["k"], [F.desc("v")])
    assert {tuple(r) for r in merged.collect()} == {("a", 1), ("b", 3), ("c", 1)}


def test_M1_bucketed_table(spark, tmp_path):
    table = snapshot.BucketedTable(spark, str(tmp_path), "k", buckets=3)
    rows = [(f"k{i}", i) for i in range(30)]
    replace = lambda old, new: snapshot.replace_groups(old, new, "k")
    assert table.merge(spark.createDataFrame(rows, "k string, v int"), replace) == 1
    before = table.manifest()
    assert table.merge(spark.createDataFrame([("k3", 300), ("k3", 301)], "k string, v int"), replace) == 2
    got = sorted(tuple(r) for r in table.read().select("k", "v").collect())
    assert got == sorted([r for r in rows if r[0] != "k3"] + [("k3", 300), ("k3", 301)])
    # Only the touched bucket was rewritten.
    assert sum(before[b] != folder for b, folder in table.manifest().items()) == 1


DOC = (
    "document_id string, lang string, title string, content string, source_path string, source_system string, "
    "external_id string, source_uri string, issued_at timestamp, modified_at timestamp"
)


def skip_case(spark, mode="local", **change):
    modified = datetime(2024, 1, 1, tzinfo=UTC)
    docs = spark.createDataFrame([("d", "fr", "T", "a b c", "p", "s", "e", "u", None, change.pop("modified", modified))], DOC)
    known = skip.with_index_metadata(
        spark.createDataFrame([("d", "fr", "T", "a b c", "p", "s", "e", "u", None, modified)], DOC)
    ).first()
    base = dict(complete=True, chunks=1, status="ready", hash=known.content_hash, fp=known.source_fingerprint, conf="high")
    base.update(change)
    state = spark.createDataFrame(
        [("d", base["fp"], base["conf"], base["complete"], base["chunks"])],
        "document_id string, source_fingerprint string, fingerprint_confidence string, index_complete boolean, indexed_chunk_count int",
    )
    stored = spark.createDataFrame([("d", "fr", base["status"], base["hash"])], "document_id string, lang string, status string, content_hash string")
    row = skip.skip_decisions(docs, state, stored, mode=mode, supported=["fr"] if change.get("one") else fv.SUPPORTED_LANGUAGES).first()
    return row.skip, row.reason


@pytest.mark.parametrize(
    "change, expected",
    [
        ({}, (True, "same_source")),
        ({"fp": "x"}, (True, "same_content")),
        ({"fp": "x", "hash": "y"}, (False, "changed")),
        ({"modified": None}, (True, "same_content")),
        ({"complete": False}, (False, "incomplete")),
        ({"chunks": 2}, (False, "chunk_count")),
        ({"status": "pending"}, (False, "translation")),
        ({"mode": "llm"}, (False, "translation")),
    ],
)
def test_C4_skip_rules(spark, change, expected):
    assert skip_case(spark, **change) == expected


class Upper:
    name = "upper"

    def translate(self, text, source, target, label):
        if "boom" in text:
            raise ValueError("refused")
        return f"{target}:{text.upper()}"


def test_C6_reuse_and_translate(spark):
    docs = spark.createDataFrame(
        [("d", "de", "Titel", "Inhalt eins", "p"), ("e", "es", "Otro", "texto", "q")],
        "document_id string, lang string, title string, content string, source_path string",
    )
    source_hash = docs.filter("document_id = 'd'").select(
        translation.ids.translation_source_hash(F.col("lang"), F.col("title"), F.col("content"))
    ).first()[0]
    stored = spark.createDataFrame(
        [("d", "fr", "Titre", "contenu  stocke", "ready", source_hash, ""), ("d", "it", "X", "y", "ready", "other", "m"), ("d", "en", "X", "y", "pending", source_hash, "m")],
        "document_id string, lang string, title string, content string, status string, source_hash string, provider string",
    )
    rows = {(r.document_id, r.lang): r for r in translation.ensure_translations(docs, stored, Upper()).collect()}
    assert len(rows) == 10
    assert rows["d", "de"].origin == "source"
    assert (rows["d", "fr"].origin, rows["d", "fr"].content, rows["d", "fr"].provider) == ("reused", "contenu stocke", "existing_db")
    assert (rows["d", "it"].title, rows["d", "en"].content) == ("it:TITEL", "en:INHALT EINS")
    # An unsupported language counts as the default one.
    assert rows["e", "fr"].origin == "source" and rows["e", "de"].source_lang == "fr"


def test_M8_pending_jobs(spark):
    stored = spark.createDataFrame(
        [("d", "de", "T", "c", "ready", "", ""), ("d", "fr", "F", "g", "ready", "", ""), ("x", "de", "boom", "c", "ready", "", "")],
        "document_id string, lang string, title string, content string, status string, source_hash string, provider string",
    )
    pending = spark.createDataFrame([("d", "it"), ("d", "it"), ("x", "it")], "document_id string, target_lang string")
    rows = {r.document_id: r for r in translation.translate_pending(pending, stored, Upper(), F.lit("now")).collect()}
    assert (rows["d"].title, rows["d"].status, rows["d"].source_lang) == ("it:F", "ready", "fr")
    assert (rows["x"].title, rows["x"].status) == ("boom", "failed")


def test_C21_translation_rules():
    calls = []

    def ask(prompt):
        calls.append(prompt)
        return "" if len(calls) < 2 else " Hallo "

    model = translation.ModelTranslator("m", ask, max_bytes=10)
    assert model.translate("salut", "fr", "de", "title") == "Hallo" and len(calls) == 2
    assert model.translate(" same ", "fr", "fr", "title") == "same"
    for text in ("", "far too long text"):
        with pytest.raises(ValueError):
            model.translate(text, "fr", "de", "title")
    with pytest.raises(RuntimeError, match="disabled"):
        translation.make_translator("local").translate("a", "fr", "de", "title")


# --- usage -------------------------------------------------------------------


@pytest.mark.parametrize("limit, offset, expected", [(0, 0, (100, 0)), (1001, -10, (1001, 0)), (5, 7, (5, 7))])
def test_T2_usage_paging(limit, offset, expected):
    assert usage.UsageFilter(limit=limit, offset=offset).paging() == expected


def usage_rows(spark, rows):
    from corpusmill import schemas

    blank = {f.name: ("" if f.dataType.simpleString() == "string" else None) for f in schemas.USAGE_EVENTS}
    return spark.createDataFrame([tuple({**blank, **r}.values()) for r in rows], schemas.USAGE_EVENTS)


def test_P15_normalisation(spark):
    rows = usage_rows(spark, [{"flow": " f ", "operation": "o", "mode": "m", "input_tokens": 3, "output_tokens": -1}, {"flow": "f"}])
    ok, bad = usage.normalize_events(rows).orderBy(F.desc("valid")).collect()
    assert (ok.flow, ok.provider_name, ok.status, ok.total_tokens, ok.output_tokens, ok.valid) == ("f", "unknown", "success", 3, 0, True)
    assert ok.event_id.startswith("evt_") and len(ok.event_id) == 36 and bad.valid is False
    scoped = usage.normalize_events(usage.apply_scope(rows, mode="local", flow="x")).filter("event_id is not null")
    assert {r.mode for r in scoped.collect()} == {"m", "local"}


def test_A4_A6_sums(spark):
    day = datetime(2024, 1, 1, 23, 59, tzinfo=UTC)
    base = {"flow": "f", "mode": "m", "created_at": day, "document_id": "d", "source_lang": "fr"}
    rows = [
        {**base, "operation": "embedding", "input_chars": 10, "input_tokens": 2},
        {**base, "operation": "translation", "target_lang": "de", "status": "error", "input_tokens": 1},
        {**base, "operation": "translation", "target_lang": "de", "input_tokens": 1},
        {**base, "operation": "translation", "target_lang": "it", "status": "error"},
        {**base, "operation": "translation", "target_lang": "fr"},
    ]
    events = usage.normalize_events(usage_rows(spark, rows))
    daily = {r.operation: r for r in usage.daily_usage(events).collect()}
    assert (daily["translation"].events_count, daily["translation"].error_count, daily["translation"].success_count) == (4, 2, 2)
    one = usage.per_document(events).first()
    assert (one.translations_attempted, one.translations_succeeded, one.embedding_calls, one.llm_total_tokens_sum) == (2, 1, 1, 2)


def test_D16_day_bounds_are_whole_days(spark):
    wanted = usage.UsageFilter(start=datetime(2024, 1, 2, 12, tzinfo=UTC), end=datetime(2024, 1, 3, 1, tzinfo=UTC))
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-04')) as day")
    assert [r.day.day for r in days.filter(wanted.day_condition()).collect()] == [2, 3]


# --- votes -------------------------------------------------------------------


def test_P14_selection(spark):
    rows = [(1, 0, "2024-01-01"), (2, 1, "2030-01-01"), (3, 2, "2031-01-01T00:00:00Z"), (4, 3, "bad")]
    df = spark.createDataFrame(rows, "id int, position int, date string")
    pick = lambda at, n: [(r.id, r.selection_strategy) for r in votes.select_votings(df, dates.moment(at), n).orderBy("position").collect()]
    assert pick("2025-01-01T00:00:00Z", 1) == [(2, "future")]
    assert pick("2025-01-01T00:00:00Z", 9) == [(2, "future"), (3, "future")]
    assert pick("2040-01-01T00:00:00Z", 2) == [(1, "fallback_past"), (2, "fallback_past")]


def test_C20_arguments_fill_missing_sides(spark):
    docs = spark.createDataFrame([("a", 0, "nichts"), ("a", 1, "dagegen  alles"), ("b", 0, "x"), ("b", 1, "")], "voting_id string, position int, text string")
    texts = spark.createDataFrame([("b", 0, {"fr": "texte"}), ("c", 0, {})], "voting_id string, position int, text map<string,string>")
    got = {r.voting_id: (r.pro, r.contra) for r in votes.arguments(docs, texts, 2400, 1800, 1200).collect()}
    assert got == {"a": ("nichts", "dagegen alles"), "b": ("x", "texte")}


def test_C20_hot_vote_is_exact(spark):
    pieces = [f"pro {i}" for i in range(3000)]
    docs = spark.createDataFrame([("a", i, p) for i, p in enumerate(pieces)], "voting_id string, position int, text string")
    texts = spark.createDataFrame([], "voting_id string, position int, text map<string,string>")
    assert votes.arguments(docs, texts, 2400).first().pro == " ".join(pieces)[:2400].strip() + "..."


def test_C20_pieces_are_whole(spark):
    long = "x " * 3000 + "dagegen"
    docs = spark.createDataFrame([("a", 0, long), ("b", 0, "x"), ("b", 1, ""), ("b", 2, "y")], "voting_id string, position int, text string")
    texts = spark.createDataFrame([("b", 0, {"fr": "texte"}), ("a", 0, {"fr": "frei"})], "voting_id string, position int, text map<string,string>")
    got = {(r.voting_id, r.side, r.piece) for r in votes.argument_pieces(docs, texts).collect()}
    assert got == {("a", "contra", long), ("a", "pro", "frei"), ("b", "pro", "x"), ("b", "contra", "y")}


def test_J8_D28_locations(spark):
    voting = spark.createDataFrame([(1, "261"), (2, "ZH"), (3, "9")], "voting_id int, body_key string")
    bodies = spark.createDataFrame(
        [
            (1, "u/bodies", 0, "1", "be", {"de": "Erste"}),
            (1, "u/bodies", 1, "261", "zh", {"de": "Zuerich"}),
            (2, "u/bodies", 0, "ZH", "zh", {"de": "Kanton"}),
            (3, "u/other", 0, "7", "", {"fr": "Sept"}),
        ],
        "voting_id int, url string, position int, body_key string, canton_key string, name map<string,string>",
    )
    got = {r.voting_id: (r.canton, r.commune_code, r.commune_name) for r in votes.locations(voting, bodies).collect()}
    assert got == {1: ("ZH", "261", "Zuerich"), 2: ("ZH", "", ""), 3: ("", "7", "Sept")}


# --- models ------------------------------------------------------------------


@pytest.mark.parametrize(
    "body, expected",
    [
        ('{"choices":[{"message":{"content":" Hallo "}}]}', ("Hallo", "")),
        ('{"choices":[{"message":{"content":[{"type":"text","text":"a"},{"type":"image","text":"x"},"b"]}}]}', ("a\nb", "")),
        ('{"choices":[{"text":"t"}]}', ("t", "")),
        ('{"choices":[{"message":{"content":"","reasoning":"hm"}}]}', ("", "reasoning_only")),
        ('{"choices":[{"message":{}}]}', ("", "empty_summary")),
        ('{"choices":[]}', ("", "no_choices")),
        ("oops", ("", "decode_failed")),
    ],
)
def test_chat_reply(body, expected):
    assert models.chat_reply(body) == expected


def test_C12_model_summary_and_its_events(spark):
    hits = hits_frame(spark, [(0.5, "d", "p", "T", "text", "s", "u", "fr")])

    def chat(prompt):
        calls.append(prompt)
        if len(calls) % 3:
            return '{"choices":[{"message":{"reasoning":"hm"}}]}'
        return '{"choices":[{"message":{"content":"ok"}}],"usage":{"prompt_tokens":9}}'

    calls = []
    results = models.summarize(hits, F.lit("Q?"), F.lit("fr"), chat).collect()
    assert (results[0].answer, results[0].error_code) == ("ok", "")
    frame = spark.createDataFrame(results)
    scoped = usage.apply_scope(models.usage_events(frame, "m"), flow="qa_query", mode="llm")
    event = usage.normalize_events(scoped).first()
    assert (event.operation, event.status, event.total_tokens, event.flow, event.valid) == ("summarization", "success", 9, "qa_query", True)
    failed = models.summarize(hits, F.lit("Q?"), F.lit("fr"), lambda prompt: "{}")
    assert failed.first().error_code == "no_choices"
    with pytest.raises(Exception, match="summarize failed"):
        models.require_answers(failed).collect()
