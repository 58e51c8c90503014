from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpusmill.session import local_session  # noqa: E402


# Column expressions need a running session, also while tests are collected.
SESSION = local_session(4, "tests", spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def value(spark):
    """Evaluate a column over one row of given columns."""

    def run(column, schema: str = "x string", row: tuple = ("",)):
        return spark.createDataFrame([row], schema).select(column.alias("out")).first()[0]

    return run
