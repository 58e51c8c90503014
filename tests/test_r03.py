"""Work that grew faster than its input: search by cells and groups, JSON rows,
vectors of texts, translation jobs, crawl."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions import dates, vectors
from corpusmill.functions import json_values as js
from corpusmill.operators import search, translation, vector_cells
from corpusmill.plans.queries import REGISTRY
from corpusmill.session import cut_lineage
from corpusmill.sources.json_docs import json_documents


def test_F6_a_task_leaves_k_rows_a_query_whatever_its_cells(spark):
    rng = np.random.default_rng(5)
    held = [(i, v) for i, v in enumerate(rng.normal(size=(300, 6)).tolist())]
    items = spark.createDataFrame(held, "item_id long, embedding array<double>")
    asked = items.limit(40).withColumnRenamed("item_id", "query_id")
    index = vector_cells.build(items, 6, 30, rows_per_bin=1000)
    every = asked.withColumn("floor", F.lit(-1.0))
    met = vector_cells._meet(index, cut_lineage(vector_cells._visits(index, every, None)), 3, True, 1000)
    assert met.groupBy("query_id").count().agg(F.max("count"), F.count("*")).first() == (3, 40)


def test_F6_running_best_keeps_ties_by_id_over_blocks(monkeypatch):
    monkeypatch.setattr(search, "SCORES_PER_BLOCK", 40)
    monkeypatch.setattr(search, "CANDIDATES", 7)
    rng = np.random.default_rng(8)
    rows = rng.integers(-2, 3, size=(60, 3)).astype(float)  # many equal directions, some without any
    norms = np.sqrt((rows * rows).sum(axis=1))
    good = norms > 0
    rows[good] /= norms[good, None]
    for names in (rng.permutation(60), np.array([f"n{i % 50}" for i in range(60)], dtype=object)):
        best = search._BestRows(names[:20], rows[:20], good[:20], 4, skip_self=True)
        for part in (slice(0, 25), slice(25, 60)):
            best.add(names[part], rows[part], good[part])
        scores = np.round(rows[:20] @ rows.T, 10)
        scores[:, ~good] = -1
        scores[~good[:20]] = -1
        expected = []
        for q in range(20):
            ranked = sorted((-s, i) for s, i in zip(scores[q], names.tolist()) if i != names[q])
            expected += [(names[q], i, -s) for s, i in ranked[:4]]
        assert list(zip(*(column.tolist() for column in best.rows()))) == expected


def test_F8_only_equal_groups_meet(spark):
    left, right = np.array(["a", None, "b", "a"], dtype=object), np.array(["c", "a", None], dtype=object)
    assert sorted((x.tolist(), y.tolist()) for x, y in search._by_group(left, right)) == [([0, 3], [1]), ([1], [2])]
    rng = np.random.default_rng(2)
    rows = [(f"k{i}", v, f"g{i % 7}" if i % 9 else None) for i, v in enumerate(rng.normal(size=(120, 5)).tolist())]
    items = spark.createDataFrame(rows, "item_id string, embedding array<double>, ctx string")
    asked = items.withColumnRenamed("item_id", "query_id")
    cut = search.nearest(items, asked, 5, 2, within="ctx", skip_self=True, broadcast_budget=200, queries_per_block=11, vectors_per_slice=17)
    whole = search.nearest(items, asked, 5, 2, within="ctx", skip_self=True)
    assert {tuple(r) for r in cut.collect()} == {tuple(r) for r in whole.collect()} and whole.count() == 240


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_F4_F10_each_walk_of_a_text_runs_once(spark):
    raw = '{"source_system":"openparldata","voting":{"id":"7","title":{"de":"Ja","fr":"Oui <b>"}}}'
    files = spark.createDataFrame([("votes/7.json", raw), ("sets/1.json", '{"text":"a&b","email":"x"}')], "source_path string, raw string")
    rows = json_documents(files, dates.moment("2000-01-01T00:00:00Z"))
    # languages, removal and views of votes; removal of other objects
    assert plan(rows.select("lang", "content", "source_extra")).count("ArrowEvalPython") <= 4
    found = {(r.source_path, r.lang): r.content for r in rows.collect()}
    assert set(found) == {("votes/7.json", "de"), ("votes/7.json", "fr"), ("sets/1.json", "fr")}
    assert found["sets/1.json", "fr"] == '{"text":"a\\u0026b"}' and "Oui \\u003cb\\u003e" in found["votes/7.json", "fr"]


def test_F10_views_over_many_slices_keep_their_rows(spark):
    rows = [(i, None if i % 50 == 0 else '{"t":{"de":"x%d","fr":"y%d"}}' % (i, i)) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, raw string").coalesce(1)
    for r in df.select("i", "raw", js.project_languages(F.col("raw"), F.array(F.lit("fr"), F.lit("it"))).alias("v")).collect():
        assert r.v == [None, None] if r.raw is None else r.v[0] == '{"t":"y%d"}' % r.i


def test_F12_vectors_over_many_slices_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 97 == 5 else f"t{i}") for i in range(700)], "i int, x string").coalesce(1)
    both = df.select("x", vectors.hash_embedding_batch(F.col("x"), 4).alias("a"), vectors.hash_embedding(F.col("x"), 4).alias("b")).collect()
    assert all((r.a is None) if r.x is None else r.a == r.b for r in both) and len(both) == 700


def test_F9_writes_are_read_once(spark):
    ask = [(1, "d1", "en", 0, False), (2, "d1", "en", 5, False), (3, "d2", "en", 6, False), (4, None, "en", 7, False)]
    events = spark.createDataFrame(ask, "event_id long, document_id string, target_lang string, s long, is_end boolean")
    events = events.withColumn("asked_at", F.timestamp_seconds("s")).drop("s")
    kinds = "document_id string, lang string, title string, content string, status string, source_hash string"
    stored = spark.createDataFrame([("d1", "fr", "t", "c", "ready", None), ("d2", "en", "t", "c", "ready", None), ("d3", "fr", "t", "c", "ready", None)], kinds)
    jobs = translation.jobs_to_start(events, stored, 60)
    assert [(r.event_id, r.document_id, r.source_lang) for r in jobs.collect()] == [(1, "d1", "fr")]
    assert "title" not in plan(jobs)


def test_F11_pages_are_built_once(spark):
    assert "o_orderkey" not in plan(REGISTRY["crawl_levels"](spark, "/root/testdata/sf0.001"))
