"""Fetching pages: content-addressed cache, rate gate, retry.

Spark owns the work list and the cache join; a task only walks its share of
the urls that are still missing. The transport is handed in, so tests and
offline runs need no network.
"""

from __future__ import annotations

import email.utils
import random
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv
from corpusmill.functions import ids, urls

# url -> (status, headers, body)
Transport = Callable[[str], tuple[int, dict[str, str], bytes]]


@dataclass(frozen=True)
class FetchSettings:
    min_interval: float = fv.FETCH_MIN_INTERVAL_SECONDS
    max_retries: int = fv.FETCH_MAX_RETRIES
    backoff_max: float = fv.FETCH_BACKOFF_MAX_SECONDS
    max_bytes: int | None = None  # a longer body is an error; the replaced application had fv.FETCH_MAX_BYTES
    ttl_seconds: int = fv.FETCH_TTL_SECONDS
    retention_seconds: int = fv.FETCH_RETENTION_SECONDS
    tasks: int = 1  # concurrent fetchers; the interval stretches with them


class HttpStatus(Exception):
    def __init__(self, status: int, retry_after: float):
        super().__init__(f"unexpected HTTP status: {status}")
        self.status, self.retry_after = status, retry_after


def retry_after_seconds(raw: str, now: float) -> float:
    """Seconds named by a Retry-After header: a number or a date; else 0."""
    value = raw.strip()
    try:
        return max(0.0, float(int(value)))
    except ValueError:
        pass
    try:
        return max(0.0, email.utils.parsedate_to_datetime(value).timestamp() - now)
    except (TypeError, ValueError):
        return 0.0


def retry_delay(attempt: int, retry_after: float, backoff_max: float) -> float:
    return min(backoff_max, retry_after if retry_after > 0 else float(2**attempt))


def is_retryable(error: Exception) -> bool:
    return isinstance(error, HttpStatus) and error.status in fv.RETRYABLE_STATUS


class PoliteFetcher:
    """One task's fetcher: waits between requests and retries what may pass."""

    def __init__(self, transport: Transport, settings: FetchSettings, clock=time.time, sleep=time.sleep, rng=None):
        self._transport, self._settings = transport, settings
        self._clock, self._sleep, self._rng = clock, sleep, rng or random.Random()
        self._last: float | None = None

    def _gate(self) -> None:
        interval = self._settings.min_interval * max(1, self._settings.tasks)
        if interval > 0 and self._last is not None:
            rest = interval - (self._clock() - self._last)
            if rest > 0:
                low, high = fv.FETCH_JITTER_MS
                self._sleep(rest + self._rng.randint(low, high) / 1000)
        self._last = self._clock()

    def _once(self, url: str) -> tuple[str, bytes]:
        status, headers, body = self._transport(url)
        named = {key.lower(): value for key, value in headers.items()}
        if not 200 <= status < 300:
            raise HttpStatus(status, retry_after_seconds(named.get("retry-after", ""), self._clock()))
        if self._settings.max_bytes is not None and len(body) > self._settings.max_bytes:
            raise ValueError(f"response exceeds {self._settings.max_bytes} bytes")
        return named.get("content-type", ""), body

    def fetch(self, url: str) -> tuple[str, bytes]:
        for attempt in range(self._settings.max_retries + 1):
            self._gate()
            try:
                return self._once(url)
            except HttpStatus as error:
                if not is_retryable(error) or attempt == self._settings.max_retries:
                    raise
                self._sleep(retry_delay(attempt, error.retry_after, self._settings.backoff_max))
        raise AssertionError("unreachable")


def cache_key(url: Column) -> Column:
    return ids.sha256(urls.canonical(url))


def fresh(cache: DataFrame, as_of: Column, settings: FetchSettings = FetchSettings()) -> DataFrame:
    """Cache rows within their time to live whose body is intact.

    ``cache``: ``cache_key, url, content_type, body, sha256, fetched_at``.
    """
    age = F.unix_micros(as_of) - F.unix_micros("fetched_at")
    intact = F.lower(F.trim("sha256")) == F.sha2(F.col("body"), 256)
    return cache.filter((age <= settings.ttl_seconds * 1_000_000) & intact)


def retained(cache: DataFrame, as_of: Column, settings: FetchSettings = FetchSettings()) -> DataFrame:
    """Cache rows young enough to keep; no retention keeps all."""
    if settings.retention_seconds <= 0:
        return cache
    age = F.unix_micros(as_of) - F.unix_micros("fetched_at")
    return cache.filter(age <= settings.retention_seconds * 1_000_000)


def fetch_missing(wanted: DataFrame, cache: DataFrame, transport: Transport, as_of: Column, settings: FetchSettings = FetchSettings(), force: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(pages, cache rows)`` for distinct ``wanted.url``.

    Pages come from the cache where it is fresh; the rest is fetched. Write
    the cache rows before using the pages twice, or the fetch repeats.
    """
    keyed = wanted.select(urls.canonical(F.col("url")).alias("url")).distinct().withColumn("cache_key", cache_key(F.col("url")))
    usable = fresh(cache, as_of, settings).drop("url")
    if force:
        usable = usable.filter(F.lit(False))
    hits = keyed.join(usable, "cache_key")
    missing = keyed.join(usable.select("cache_key"), "cache_key", "left_anti")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = PoliteFetcher(transport, settings)
        for rows in batches:
            got = [fetcher.fetch(url) for url in rows["url"]]
            yield rows.assign(content_type=[kind for kind, _ in got], body=[body for _, body in got])

    fetched = missing.repartition(settings.tasks).mapInPandas(
        work, "cache_key string, url string, content_type string, body binary"
    )
    new_rows = fetched.withColumns({"sha256": F.sha2(F.col("body"), 256), "fetched_at": as_of})
    columns = ["cache_key", "url", "content_type", "body", "sha256", "fetched_at"]
    return hits.select(*columns).unionByName(new_rows.select(*columns)), new_rows.select(*columns)
