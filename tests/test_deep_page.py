"""Pages located by counts between cuts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import deep_page as dp
from corpusmill.operators.select import page

KEYS = [("day", True), ("name", False), ("id", False)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    made = [(rng.choice([None, 1.0, 1.0, 1.0, 1.0, 2.0, 3.5, float("nan")]), rng.choice([None, "", "b", "é", "zz"]), i) for i in range(4000)]
    df = spark.createDataFrame(made, "day double, name string, id long").repartition(7)
    return df.cache()


@pytest.mark.parametrize("offset,limit", [(0, 5), (1999, 50), (3990, 50), (4000, 5), (9000, 5), (100, 3000), (7, 0)])
def test_equals_a_sorted_page(rows, offset, limit):
    wanted = page(rows, dp.sort_columns(KEYS), limit, offset)
    got = dp.deep_page(rows, KEYS, limit, offset, sortable=100)
    assert list(map(str, got.collect())) == list(map(str, wanted.collect()))


def test_only_the_range_of_the_page_is_sorted(rows):
    found = dp.narrow(rows, KEYS, 2000, 2020, sortable=100)
    assert found.rounds >= 2 and found.size <= 100 and found.rows.count() == found.size
    assert found.skipped <= 2000 and found.skipped + found.size >= 2020


def test_equal_keys_empty_tables_and_short_tables(spark):
    same = spark.range(500).select(F.lit(1).alias("k"), "id")
    found = dp.narrow(same, [("k", False)], 250, 260, sortable=10)
    assert (found.size, found.skipped) == (500, 0)
    assert dp.deep_page(same, [("k", True)], 10, 495, sortable=10).count() == 5
    assert dp.deep_page(same.limit(0), [("k", True)], 10, 5, sortable=10).count() == 0
    assert dp.narrow(same, [("k", False)], 0, 10).rounds == 0


@pytest.mark.parametrize("descending", [False, True])
def test_conditions_on_the_range_reach_the_scan(spark, tmp_path, descending):
    spark.range(5000).selectExpr("if(id % 50 = 0, null, id) as k").write.parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    found = dp.narrow(stored, [("k", descending)], 2500, 2510, sortable=200)
    pushed = found.rows._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1]
    assert "GreaterThanOrEqual(k" in pushed and "LessThanOrEqual(k" in pushed
    for place in (2500, 60, 4950):
        got = dp.deep_page(stored, [("k", descending)], 80, place, sortable=200).collect()
        assert got == page(stored, dp.sort_columns([("k", descending)]), 80, place).collect()
