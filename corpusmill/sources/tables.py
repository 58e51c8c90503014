"""Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def write_documents(df: DataFrame, path: str, column: str = "document") -> None:
    """One JSON text per line, for a frame of normalised votes."""
    df.select(column).write.mode("errorifexists").text(path)
