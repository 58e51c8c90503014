"""Numbering rows along a total order without one task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from corpusmill.llm.common import small
from corpusmill.session import work_folder


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row along ``order`` (0, 1, 2...) as a long.

    Range partitions are sorted, numbered by streaming over them, and written;
    the rows of the partitions before are added from one count per partition.
    Equal rows get consecutive numbers in no fixed order among themselves. The
    column must be new.
    """
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    shape = StructType([*df.schema]).add("_part", LongType()).add("_place", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            places = pa.array(np.arange(at, at + n, dtype=np.int64))
            parts = pa.array(np.full(n, part, np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, places], names=[*batch.schema.names, "_part", "_place"])
            at += n

    folder = work_folder(df.sparkSession)
    df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, shape).write.parquet(folder)
    placed = df.sparkSession.read.schema(shape).parquet(folder)
    before, at = [], 0
    for r in placed.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row per partition
        before.append((r["_part"], at))
        at += r["n"]
    base = df.sparkSession.createDataFrame(before, "_part long, _before long")
    return placed.join(small(base), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
