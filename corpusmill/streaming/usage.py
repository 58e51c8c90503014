"""Structured Streaming form of the daily usage aggregate.

Late events always count (there is no cut-off), so the aggregate runs in
update mode without a watermark. Its state is one row per day and dimensions;
where that matters, ``retain_days`` sets a watermark and with it a cut-off.

A source that delivers events more than once is cleaned by ``once_within``:
ids are remembered for that long by event time and a repeat is not counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators import usage


def daily_stream(events: DataFrame, retain_days: int | None = None, once_within: str | None = None) -> DataFrame:
    """Daily rows of a stream of normalised events, for update mode.

    ``once_within`` (such as ``"2 days"``) counts an event id once however often
    it is delivered, as long as its repeats come within that time; events later
    than that are dropped, since they can't be told from repeats. Without an id
    (null) rows can't be told apart, so all of them count.
    """
    if once_within is not None:
        watched = events.withWatermark("created_at", once_within)
        # A null id gets a fresh one; an id of the source never starts that way.
        key = F.coalesce(F.col("event_id"), F.concat(F.lit("\u0000"), F.uuid()))
        events = watched.withColumn("__once", key).dropDuplicatesWithinWatermark(["__once"]).drop("__once")
    if retain_days is None:
        return usage.daily_usage(events)
    window = F.window("created_at", "1 day").alias("__window")
    watched = events if once_within is not None else events.withWatermark("created_at", f"{retain_days} days")
    grouped = watched.groupBy(window, *usage.DAILY_KEYS[1:]).agg(*usage.daily_measures())
    return grouped.withColumn("day", F.to_date("__window.start")).drop("__window")


def write_updates(daily: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep the daily table as one generation a batch: the batch's changed rows
    over the rows of the generation before.

    A repeated batch writes its own generation again from the one before it, so
    a restart counts nothing twice. Two generations stay, the one that readers
    may have open and the new one; the table is small beside the events (a row
    per day and dimensions), so that writing it whole keeps files few.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        older = [n for n in _generations(spark, path) if n < number]
        rows = batch
        if older:
            kept = spark.read.parquet(_folder(path, older[-1]))
            # Keys are never null: normalisation gives each a default, but a null stays one key.
            same = [kept[key].eqNullSafe(batch[key]) for key in usage.DAILY_KEYS]
            rows = batch.unionByName(kept.join(batch, same, "left_anti"))
        rows.write.mode("overwrite").parquet(_folder(path, number))
        for n in older[:-1]:
            fs, folder = _handle(spark, _folder(path, n))
            fs.delete(folder, True)

    writer = daily.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """Current daily rows: the newest generation that was written to its end."""
    return spark.read.parquet(_folder(path, _generations(spark, path)[-1]))


def _folder(path: str, number: int) -> str:
    return f"{path}/generation-{number}"


def _handle(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _generations(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the generations that are complete, in order."""
    fs, root = _handle(spark, path)
    if not fs.exists(root):
        return []
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "generation-*/_SUCCESS"))
    return sorted(int(status.getPath().getParent().getName().removeprefix("generation-")) for status in done)
