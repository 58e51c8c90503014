"""Catalogue queries, request checks, streams and the driver contract."""

import os
import random
import re
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from corpusmill import schemas
from corpusmill.functions import dates
from corpusmill.operators import translation, usage
from corpusmill.operators.cache_replay import replay_exact
from corpusmill.plans import catalog, requests
from corpusmill.streaming import stateful
from corpusmill.streaming import usage as usage_stream

UTC = timezone.utc
NOW = "2026-01-01T00:00:00Z"


def stored(spark):
    blank = {f.name: "" for f in schemas.DOCUMENTS if f.dataType.simpleString() == "string"}

    def doc(id_, votation, day, **more):
        row = {**{f.name: None for f in schemas.DOCUMENTS}, **blank, "id": id_, "votation_id": votation, **more}
        row["vote_date"] = datetime(2025, 1, day, tzinfo=UTC) if day else None
        return tuple(row.values())

    docs = spark.createDataFrame(
        [
            doc("d1", "v1", 5, level="federal", object_id="o/1", source_uri="u1", object_type="Motion", source_system="openparldata"),
            doc("d2", "v1", 6, level="federal", object_id="o/1", source_uri="u2", source_org="Org", source_system="x"),
            doc("d3", "v2", None, level="cantonal", object_id="", source_uri="u1"),
            doc("d4", "v3", 9, level="federal", source_uri=""),
            doc("d5", "", 9),
        ],
        schemas.DOCUMENTS,
    )
    texts = [
        ("d1", "de", "T-de", '{"display_title":"D-de"}'),
        ("d1", "fr", "T-fr", "{}"),
        ("d2", "de", "second", "{}"),
        ("d2", "it", "T-it", "{}"),
        ("d3", "en", "E3", "{}"),
        ("d5", "fr", "none", "{}"),
    ]
    translations = spark.createDataFrame(
        [(f"{d}:{lg}", d, lg, t, "", f"text {d}", m) for d, lg, t, m in texts], schemas.TRANSLATIONS
    )
    return docs, translations


def test_T1_D1_D2_votation_page(spark):
    found = catalog.list_votations(*stored(spark), catalog.VotationFilter(lang="fr"), dates.moment(NOW))
    # Undated first; v3 has no translation, but counts in the total.
    rows = catalog.with_lists(found).collect()
    assert [r.votation_id for r in rows] == ["v2", "v1"] and found.total.first().total == 3
    v2, v1 = rows
    assert (v2.date_iso, v2.translation_state, v2.fallback_language) == (NOW, "pending", "en")
    assert v2.display_titles == {"en": "E3", "fr": "E3"}
    assert v1.date_iso == "2025-01-06T00:00:00Z" and v1.translation_state == "ready"
    # D4: the smallest document id gives a language's title.
    assert v1.titles == {"de": "T-de", "fr": "T-fr", "it": "T-it"} and v1.display_titles["de"] == "D-de"
    assert (v1.object_ids, v1.source_urls) == (["o/1"], ["u1", "u2"])
    assert [tuple(r) for r in found.pending.collect()] == [("d3", "fr")]


def test_D1_row_paging(spark):
    wanted = catalog.VotationFilter(limit=2, offset=1)
    found = catalog.list_votations(*stored(spark), wanted, dates.moment(NOW), compat_row_paging=True)
    rows = found.items.collect()
    assert [(r.votation_id, r.titles) for r in rows] == [("v1", {"de": "second", "it": "T-it"})]


def test_with_lists_refuses_long_lists(spark):
    found = catalog.list_votations(*stored(spark), as_of=dates.moment(NOW))
    with pytest.raises(ValueError, match="long form"):
        catalog.with_lists(found, max_per_votation=1)


def test_detail_and_objects(spark):
    docs, translations = stored(spark)
    one = catalog.get_votation(docs, translations, "v1", "it", dates.moment(NOW)).items.first()
    assert (one.date_iso, one.language) == ("2025-01-06T00:00:00Z", "it")
    with pytest.raises(catalog.NotFound):
        catalog.require(catalog.get_votation(docs, translations, "nope").items, "nope")
    objects = catalog.list_objects(docs, translations, "v1", "it").collect()
    # W1: one row per object, the smallest document, whose Italian title is missing.
    assert [(o.object_id, o.title, o.slug, o.object_type) for o in objects] == [("o/1", "", "o-1", "Motion")]
    detail = catalog.get_object(docs, translations, "o/1", "it").first()
    assert (detail.language, detail.title, detail.context, detail.source_systems) == ("it", "T-it", "text d2", ["x"])
    sources = catalog.list_object_sources(docs, "o/1").collect()
    assert [(s.url, s.type, s.title) for s in sources] == [("u2", "other", "Org"), ("u1", "official", "openparldata")]


def test_A17_taxonomies(spark):
    got = [tuple(r) for r in catalog.taxonomies(*stored(spark)).collect()]
    assert got == [("languages", x) for x in ("de", "en", "fr", "it")] + [("levels", "cantonal"), ("levels", "federal"), ("object_types", "Motion")]


def test_P9_P10_requests():
    got = requests.votation_filter({"level": " Federal ", "canton": "ge", "date_from": "2025-01-01T00:00:00+02:00", "limit": "7"})
    assert (got.level, got.canton, got.limit, got.lang) == ("federal", "GE", 7, "fr")
    assert got.date_from == datetime(2024, 12, 31, 22, tzinfo=UTC)
    for bad in ({"limit": "0"}, {"limit": "101"}, {"limit": "x"}, {"offset": "-1"}, {"level": "x"}, {"status": "x"}, {"canton": "GENF"},
                {"date_from": "2025-01-01"}):
        with pytest.raises(requests.InvalidRequest) as error:
            requests.votation_filter(bad)
        assert error.value.code == "invalid_query"
    assert requests.usage_filter({})[1] == "day"
    for bad in ({"granularity": "week"}, {"flow": "x"}, {"limit": "1001"}, {"from": "2025-01-02T00:00:00Z", "to": "2025-01-01T00:00:00Z"}):
        with pytest.raises(requests.InvalidRequest):
            requests.usage_filter(bad)


def test_P11_P12_question_body():
    ok = requests.question_body('{"question":"Q?","context":{"votationId":"v:1","canton":"ge"}}')
    assert (ok["question"], ok["votation_id"], ok["canton"]) == ("Q?", "v:1", "GE")
    for bad in ("", "[]", '{"question":" "}', '{"question":"q","x":1}', '{"question":"q"} {}', '{"question":"q","context":{"y":"1"}}',
                '{"question":"q","context":{"objectId":"a b"}}', '{"question":"q","context":{"canton":"1"}}',
                '{"question":"' + "é" * 1001 + '"}'):
        with pytest.raises(requests.InvalidRequest):
            requests.question_body(bad)
    assert requests.is_safe_id("ab.c-d_e:1") and not requests.is_safe_id("a") and not requests.is_safe_id("x" * 121)


# --- streams -----------------------------------------------------------------


def parts(spark, df, folder, pieces):
    """The frame as a file stream of several triggers."""
    for number, condition in enumerate(pieces):
        df.filter(condition).coalesce(1).write.mode("append").parquet(f"{folder}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}")


def test_stream_equals_batch_with_late_events(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=UTC)
    raw = spark.range(300).select(
        F.concat(F.lit("e"), F.col("id")).alias("event_id"),
        (F.lit(start) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("created_at"),
        *[F.lit(x).alias(n) for n, x in [("flow", "f"), ("operation", "o"), ("mode", "m"), ("provider_name", "p"), ("model_name", "x")]],
        F.when(F.col("id") % 3 == 0, "error").otherwise("success").alias("status"),
        *[F.col("id").alias(n) for n in ("input_chars", "output_chars", "input_tokens", "output_tokens", "total_tokens", "duration_ms")],
    )
    # Later days first: earlier ones arrive late and still count.
    stream = parts(spark, raw, f"{tmp_path}/in", ["input_chars >= 200", "input_chars < 100", "input_chars between 100 and 199"])
    usage_stream.write_updates(usage_stream.daily_stream(stream), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = usage_stream.read_daily(spark, f"{tmp_path}/out")
    expected = usage.daily_usage(raw)
    assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_daily_counts_once_through_repeats_and_restarts(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=UTC)
    raw = spark.range(240).select(
        F.when(F.col("id") % 40 != 0, F.concat(F.lit("e"), F.col("id"))).alias("event_id"),
        (F.lit(start) + F.make_dt_interval(mins=F.col("id").cast("int") * 10)).alias("created_at"),
        *[F.lit(x).alias(n) for n, x in [("flow", "f"), ("operation", "o"), ("provider_name", "p"), ("model_name", "x")]],
        F.concat(F.lit("m"), F.col("id") % 3).alias("mode"),
        F.when(F.col("id") % 3 == 0, "error").otherwise("success").alias("status"),
        *[F.col("id").alias(n) for n in ("input_chars", "output_chars", "input_tokens", "output_tokens", "total_tokens", "duration_ms")],
    )
    out, cp = f"{tmp_path}/out", f"{tmp_path}/cp"
    # Every second batch delivers rows of the one before again; the stream stops after each.
    for wanted in ["id < 80", "id between 40 and 150", "id between 100 and 160", "id > 120", "id > 200"]:
        raw.withColumn("id", F.col("input_chars")).filter(wanted).drop("id").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        usage_stream.write_updates(usage_stream.daily_stream(stream, once_within="3 days"), out, cp).awaitTermination()
        assert len([f for f in os.listdir(out) if f.startswith("generation-")]) <= 2
    got = usage_stream.read_daily(spark, out)
    # Rows without an id can't be told apart: ids 40, 80, 120, 160, 200, 0 came 2, 1, 2, 2, 1 and 1 times.
    nameless = raw.filter("event_id is null")
    again = nameless.filter("input_chars in (40, 120, 160)")
    expected = usage.daily_usage(raw.unionByName(again))
    assert sorted(map(str, got.select(*expected.columns).collect())) == sorted(map(str, expected.collect()))
    # A generation without its mark is not read, and a repeated batch replaces its own.
    newest = max(int(f.split("-")[1]) for f in os.listdir(out))
    os.makedirs(f"{out}/generation-{newest + 1}")
    assert usage_stream.read_daily(spark, out).count() == expected.count()


@pytest.fixture
def rocks(spark):
    """Streams of this test keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def played(stream, name, checkpoint):
    """Runs a stream over what there is; its progress, trigger by trigger."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    query = query.option("checkpointLocation", checkpoint).start()
    query.awaitTermination()
    return query.recentProgress


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_cache_replay_in_random_triggers(spark, rocks, tmp_path, seed):
    rng = random.Random(seed)
    start, at, log = datetime(2024, 1, 1, tzinfo=UTC), 0, []
    for i in range(300):
        at += rng.choice([0, 0, 1, 5, 20, 61])
        log.append((i, f"k{rng.choice([0, 0, 0, 0, 1, 2, 3])}", start + timedelta(seconds=at)))
    df = spark.createDataFrame(log, "event_id long, key string, asked_at timestamp")
    cuts = sorted({0, 300, *rng.sample(range(1, 300), 3)})
    stream = parts(spark, df, f"{tmp_path}/in", [f"event_id >= {a} and event_id < {b}" for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    played(stateful.replay_cache_stream(stream, 60), f"replay{seed}", f"{tmp_path}/cp")
    got = {(r.event_id, r.key): r.outcome for r in spark.table(f"replay{seed}").collect()}
    assert got == {(r.event_id, r.key): r.outcome for r in replay_exact(df, 60).outcomes.collect()}
    ends, expected = {}, {}
    for event, key, moment in log:
        hit = key in ends and moment <= ends[key]
        ends[key] = ends[key] if hit else moment + timedelta(seconds=60)
        expected[event, key] = "exact_hit" if hit else "miss"
    assert got == expected


def test_stream_cache_forgets_what_expired(spark, rocks, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=UTC)
    many = [(i, f"k{i}", start + timedelta(seconds=i % 50)) for i in range(200)]
    few = [(1000 + i, "late", start + timedelta(seconds=3600 * (i + 1))) for i in range(3)]
    df = spark.createDataFrame(many + few, "event_id long, key string, asked_at timestamp")
    stream = parts(spark, df, f"{tmp_path}/in", ["event_id < 200", *[f"event_id = {1000 + i}" for i in range(3)]])
    progress = played(stateful.replay_cache_stream(stream, 600), "forgets", f"{tmp_path}/cp")
    rows = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert max(rows) >= 200 and rows[-1] < 20
    assert spark.table("forgets").filter("outcome = 'miss'").count() == 203


def job_log(seed):
    """Requests and ends of jobs in order of time, and how each request goes."""
    rng = random.Random(seed)
    start, at, log, until, expected = datetime(2024, 1, 1, tzinfo=UTC), 0, [], {}, {}
    for i in range(300):
        at += rng.choice([1, 5, 20, 91])
        pair, is_end = (f"d{rng.choice([0, 0, 0, 1])}", rng.choice(["en", "de"])), rng.random() < 0.2
        moment = start + timedelta(seconds=at)
        log.append((i, *pair, moment, is_end))
        if is_end:
            until.pop(pair, None)
        else:
            under_way = pair in until and moment <= until[pair]
            expected[i] = (*pair, "joined" if under_way else "started")
            until[pair] = until[pair] if under_way else moment + timedelta(seconds=90)
    return log, expected


def outcomes_of(df):
    return {r.event_id: (r.document_id, r.target_lang, r.outcome) for r in df.collect()}


JOB_LOG = "event_id long, document_id string, target_lang string, asked_at timestamp, is_end boolean"


@pytest.mark.parametrize("seed", [1, 2])
def test_M8_jobs_under_way_batch_and_stream(spark, rocks, tmp_path, seed):
    log, expected = job_log(seed)
    df = spark.createDataFrame(log, JOB_LOG)
    assert outcomes_of(translation.in_flight(df.repartition(3))) == expected
    cuts = sorted({0, 300, *random.Random(seed).sample(range(1, 300), 3)})
    stream = parts(spark, df, f"{tmp_path}/in", [f"event_id >= {a} and event_id < {b}" for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    played(stateful.new_jobs(stream), f"jobs{seed}", f"{tmp_path}/cp")
    assert outcomes_of(spark.table(f"jobs{seed}")) == expected


def test_M8_jobs_of_one_moment_and_none(spark):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    rows = [(3, "d", "en", at, False), (2, "d", "en", at, False), (9, "d", "en", at, True), (4, "d", "en", at + timedelta(seconds=90), False), (5, "d", "en", at + timedelta(seconds=91), False)]
    df = spark.createDataFrame(rows, JOB_LOG)
    got = {event: outcome for event, (*_, outcome) in outcomes_of(translation.in_flight(df)).items()}
    assert got == {2: "started", 3: "joined", 4: "joined", 5: "started"}
    assert translation.in_flight(df.limit(0)).count() == 0


def test_M6_jobs_to_start(spark):
    at = datetime(2024, 1, 1, tzinfo=UTC)
    texts = [("a", "fr", "T", "x", "ready", ""), ("b", "en", "T", "x", "ready", ""), ("b", "de", "T", "x", "ready", "old"), ("c", "de", "T", "x", "ready", "")]
    stored = spark.createDataFrame(texts, "document_id string, lang string, title string, content string, status string, source_hash string")
    log = [(1, "a", "de", at, False), (2, "a", "de", at, False), (3, "b", "de", at, False), (4, "c", "de", at, False), (5, "gone", "de", at, False)]
    events = spark.createDataFrame(log, JOB_LOG)
    started = {r.event_id: r for r in translation.jobs_to_start(events, stored).collect()}
    assert {event: r.source_lang for event, r in started.items()} == {1: "fr", 3: "en"}
    renewed = stored.withColumn("source_hash", F.when(F.col("source_hash") == "old", started[3].source_hash).otherwise(""))
    assert {r.event_id for r in translation.jobs_to_start(events, renewed).collect()} == {1}


def test_rate_limit_is_a_token_bucket(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=UTC)
    moments = [0, 0, 0, 0, 0.5, 1.2, 10, 10, 10, 10]
    rows = [(f"e{i:02d}", "c", start + timedelta(seconds=s)) for i, s in enumerate(moments)] + [("z", "other", start)]
    df = spark.createDataFrame(rows, "event_id string, client string, asked_at timestamp")
    stream = parts(spark, df, f"{tmp_path}/in", ["true"])
    out = stateful.rate_limit(stream).writeStream.format("memory").queryName("limited").outputMode("append")
    out.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination()
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    assert [got[f"e{i:02d}"] for i in range(10)] == [True, True, True, False, False, True, True, True, True, False]
    assert got["z"] is True


# --- contract ----------------------------------------------------------------


def test_entry_runs_and_contract_is_complete(spark):
    assert contract.entry(spark).count() > 0
    names = set(contract.queries())
    assert set(contract.oracle_sql()) <= names
    own = {n for n in names if not re.match(r"op\d+_|pipeline$", n)}  # the training-data queries may be absent
    assert own <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", ["vector_topk_batch", "votation_detail", "index_skip_decisions", "usage_daily"])
def test_plans_have_no_pair_products(spark, name):
    df = contract.queries()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_scan_is_pruned_and_filtered(spark):
    df = contract.queries()["votation_total"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "c_name" not in plan and "PushedFilters: [IsNotNull" in plan


def test_first_per_key_limits_before_the_shuffle(spark):
    df = contract.queries()["upsert_latest"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
