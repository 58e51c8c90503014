"""Upserts, and tables that accept them.

Parquet has no MERGE. ``upsert`` and ``replace_groups`` are plain joins.
``BucketedTable`` stores their result: rows are placed by a hash of the
document into a fixed number of folders, a merge rewrites only the folders its
batch touches, and a new version becomes visible by writing one small manifest
that must not exist yet. Readers of an older version are undisturbed; a lost
executor only repeats its tasks; a lost job leaves the old version in place.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.select import first_per_key


def latest(batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Last writer per key; ``order`` puts the winner first."""
    return first_per_key(batch, keys, order)


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``current`` with the rows of ``batch`` inserted or put in their place."""
    winners = latest(batch, keys, order)
    untouched = current.join(winners.select(*keys), list(keys), "left_anti")
    return untouched.unionByName(winners, allowMissingColumns=True)


def replace_groups(current: DataFrame, batch: DataFrame, group: str, touched: DataFrame | None = None) -> DataFrame:
    """All rows of the touched groups are replaced by the batch's rows.

    ``touched`` names groups to clear even where the batch has no row for them.
    """
    cleared = (touched if touched is not None else batch).select(group).distinct()
    return current.join(cleared, group, "left_anti").unionByName(batch, allowMissingColumns=True)


class BucketedTable:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # --- reading ---

    def versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/_manifests")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        return sorted(int(name.removesuffix(".json")) for name in names if name.endswith(".json"))

    def manifest(self) -> dict[str, str]:
        """bucket -> folder of the current version."""
        known = self.versions()
        if not known:
            return {}
        text = self.spark.read.text(self._manifest_path(known[-1]), wholetext=True).first()[0]
        return json.loads(text)

    def read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        held = self.manifest()
        folders = [held[str(b)] for b in (only if only is not None else map(int, held)) if str(b) in held]
        return self.spark.read.parquet(*folders) if folders else None

    # --- writing ---

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
        """Combine the batch with the touched buckets; returns the new version.

        ``batch`` is read twice (bucket list, data): hand in one whose plan is
        cheap to repeat, or one already written.
        """
        version = (self.versions() or [0])[-1] + 1
        placed = batch.withColumn("__bucket", self.bucket())
        touched = [row[0] for row in placed.select("__bucket").distinct().collect()]  # at most ``buckets`` rows
        if not touched:
            return version - 1
        existing = self.read(touched)
        merged = combine(batch.limit(0) if existing is None else existing, batch)  # also the first batch may repeat keys
        folder = f"{self.path}/v{version:08d}"
        out = merged.withColumn("__bucket", self.bucket())
        # A random second key splits a crowded bucket over several tasks.
        out.repartition("__bucket", F.floor(F.rand(7) * 4)).write.partitionBy("__bucket").mode("overwrite").parquet(
            folder
        )
        held = self.manifest()
        fs, root = self._fs(folder)
        for bucket in touched:
            part = f"{folder}/__bucket={bucket}"
            if fs.exists(self._path(part)):
                held[str(bucket)] = part
            else:
                held.pop(str(bucket), None)
        self._publish(version, held)
        return version

    # --- files ---

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        handle = self._path(path)
        return handle.getFileSystem(self.spark._jsc.hadoopConfiguration()), handle

    def _manifest_path(self, version: int) -> str:
        return f"{self.path}/_manifests/{version:08d}.json"

    def _publish(self, version: int, held: dict[str, str]) -> None:
        fs, target = self._fs(self._manifest_path(version))
        stream = fs.create(target, False)  # fails if another writer was first
        try:
            stream.write(bytearray(json.dumps(held), "utf-8"))
        finally:
            stream.close()
