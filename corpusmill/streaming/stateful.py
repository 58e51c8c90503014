"""State over streams: question cache with time to live, rate limit, job dedupe."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.functions import fixed_values as fv


def _per_moment(events: DataFrame, key: str, at: str) -> DataFrame:
    """Rows as key, microsecond and id."""
    return events.select(F.col(key).alias("key"), F.unix_micros(at).alias("at"), F.col("event_id"))


def rate_limit(requests: DataFrame, qps: float = fv.RATE_QPS, burst: int = fv.RATE_BURST) -> DataFrame:
    """``event_id, key, allowed``: a token bucket per client.

    ``requests``: ``client, asked_at, event_id``. A non-positive rate or burst
    allows everything. The state of a client is two numbers. A trigger's
    requests of one client meet in one task, as each depends on the one
    before; bound a trigger with ``maxFilesPerTrigger``.
    """
    if qps <= 0 or burst <= 0:
        rows = _per_moment(requests, "client", "asked_at")
        return rows.select(F.col("event_id").cast("string"), "key", F.lit(True).alias("allowed"))

    def spend(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (float(burst), None)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable")
        allowed = []
        for moment in rows["at"].tolist():
            if last is not None and moment > last:
                tokens = min(float(burst), tokens + (moment - last) / 1e6 * qps)
            last = moment if last is None else max(last, moment)
            allowed.append(tokens >= 1.0)
            if allowed[-1]:
                tokens -= 1.0
        state.update((float(tokens), int(last)))
        yield pd.DataFrame({"event_id": rows["event_id"], "key": key[0], "allowed": allowed})

    return (
        _per_moment(requests, "client", "asked_at")
        .groupBy("key")
        .applyInPandasWithState(
            spend,
            "event_id string, key string, allowed boolean",
            "tokens double, last long",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


class _Entry(StatefulProcessor):
    """One key's cache entry: the moment it ends, in microseconds."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ends = handle.getValueState("ends", "ends long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        ends = self.ends.get()[0] if self.ends.exists() else None
        before = ends
        # a trigger's rows may come in several pieces; only moments and ids are kept
        asked = pd.concat([r[["at", "event_id"]] for r in rows]).sort_values(["at", "event_id"], kind="stable")
        outcomes = []
        for at in asked["at"].tolist():
            hit = ends is not None and at <= ends
            outcomes.append("exact_hit" if hit else "miss")
            if not hit:
                ends = at + self.ttl
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(_after(before))
            self.ends.update((ends,))
            self.handle.registerTimer(_after(ends))
        yield pd.DataFrame({"event_id": asked["event_id"], "key": key[0], "outcome": outcomes})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.ends.clear()
        return iter(())

    def close(self) -> None:
        pass


def _after(micros: int) -> int:
    """The first whole millisecond after a moment: the last one still counts."""
    return micros // 1000 + 1


def replay_cache_stream(lookups: DataFrame, ttl_seconds: int = fv.EXACT_TTL_SECONDS, late: str = "0 seconds") -> DataFrame:
    """``event_id, key, outcome`` of a stream of lookups ``event_id, key, asked_at``.

    State is one number per key with a living entry. A timer in event time
    removes it when the watermark (``late`` behind the newest lookup) has passed
    its end, so the state follows the keys asked of late, not all keys ever
    asked. Lookups later than the watermark are dropped. Lookups of a trigger
    are taken in time order, those of one moment by id; one key's lookups of a
    trigger meet in one task, as each depends on the one before (bound a trigger
    with ``maxFilesPerTrigger``). The session must name the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    timed = lookups.withWatermark("asked_at", late).select("key", "event_id", F.unix_micros("asked_at").alias("at"), "asked_at")
    kinds = {f.name: f.dataType.simpleString() for f in timed.schema}
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Entry(ttl_seconds * 1_000_000),
        outputStructType=f"event_id {kinds['event_id']}, key {kinds['key']}, outcome string",
        outputMode="append",
        timeMode="eventTime",
    )


class _Job(_Entry):
    """One pair's job under way: the moment of its deadline, in microseconds."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        ends = self.ends.get()[0] if self.ends.exists() else None
        before = ends
        told = pd.concat([r[["at", "event_id", "is_end"]] for r in rows])
        told = told.assign(later=~told["is_end"]).sort_values(["at", "later", "event_id"], kind="stable")
        outcomes = []
        for at, is_end in zip(told["at"].tolist(), told["is_end"].tolist()):
            if is_end:
                ends = None
                continue
            under_way = ends is not None and at <= ends
            outcomes.append("joined" if under_way else "started")
            if not under_way:
                ends = at + self.ttl
        if ends != before:
            if before is not None:
                self.handle.deleteTimer(_after(before))
            if ends is None:
                self.ends.clear()
            else:
                self.ends.update((ends,))
                self.handle.registerTimer(_after(ends))
        yield pd.DataFrame({"event_id": told["event_id"][~told["is_end"]], "document_id": key[0], "target_lang": key[1], "outcome": outcomes})


def new_jobs(events: DataFrame, seconds: int = fv.TRANSLATION_JOB_SECONDS, late: str = "0 seconds") -> DataFrame:
    """The stream form of ``translation.in_flight``: ``event_id, document_id,
    target_lang, outcome`` of each request.

    State is one number per pair with a job under way. The end of a job frees its
    pair, and so does the deadline: a timer in event time removes what never
    finished. What ``replay_cache_stream`` says of late rows, of the rows of a
    trigger and of the state store holds here too.
    """
    timed = events.withWatermark("asked_at", late).select("document_id", "target_lang", "event_id", "is_end", F.unix_micros("asked_at").alias("at"), "asked_at")
    kind = timed.schema["event_id"].dataType.simpleString()
    return timed.groupBy("document_id", "target_lang").transformWithStateInPandas(
        statefulProcessor=_Job(seconds * 1_000_000),
        outputStructType=f"event_id {kind}, document_id string, target_lang string, outcome string",
        outputMode="append",
        timeMode="eventTime",
    )
