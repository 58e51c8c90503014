"""Model-usage events: normalisation, filters, daily and per-document sums.

The daily table is always derived from the events, never kept twice.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv
from corpusmill.functions import ids
from corpusmill.functions import text as tx
from corpusmill.operators.deep_page import Key, deep_page
from corpusmill.operators.select import page

_TEXT = [
    "flow",
    "operation",
    "mode",
    "provider_name",
    "model_name",
    "run_id",
    "request_id",
    "document_id",
    "source_lang",
    "target_lang",
    "usage_source",
    "status",
    "error_code",
]
_COUNTS = ["input_chars", "output_chars", "input_tokens", "output_tokens", "total_tokens", "duration_ms"]
_SCOPED = ["flow", "mode", "run_id", "request_id", "document_id"]
_DEFAULTS = {"provider_name": "unknown", "model_name": "unknown", "usage_source": "unknown", "status": "success"}
DAILY_KEYS = ["day", "flow", "operation", "mode", "model_name", "provider_name"]


def apply_scope(events: DataFrame, **scope: str) -> DataFrame:
    """Fill blank dimensions from the request or run the events belong to."""
    unknown = set(scope) - set(_SCOPED)
    if unknown:
        raise ValueError(f"not a scope field: {sorted(unknown)}")
    return events.withColumns({name: tx.non_empty(F.col(name), F.lit(value)) for name, value in scope.items()})


def normalize_events(events: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Trimmed text, defaults, no negative counters, a total that adds up.

    Adds ``valid``: false where flow, operation or mode is missing. Split with
    a filter on it; nothing is dropped here.
    """
    text = {name: tx.trim(F.coalesce(F.col(name), F.lit(""))) for name in _TEXT}
    for name, default in _DEFAULTS.items():
        text[name] = F.coalesce(F.nullif(text[name], F.lit("")), F.lit(default))
    floor = {name: F.greatest(F.coalesce(F.col(name), F.lit(0)), F.lit(0)).cast("long") for name in _COUNTS}
    summed = F.when(floor["total_tokens"] == 0, floor["input_tokens"] + floor["output_tokens"])
    floor["total_tokens"] = F.coalesce(summed, floor["total_tokens"])
    valid = (text["flow"] != "") & (text["operation"] != "") & (text["mode"] != "")
    now = as_of if as_of is not None else F.current_timestamp()
    return events.withColumns(
        {
            **text,
            **floor,
            "event_id": F.coalesce(F.nullif(F.col("event_id"), F.lit("")), ids.usage_event_id()),
            "created_at": F.coalesce(F.col("created_at"), now),
            "valid": valid,
        }
    )


@dataclass(frozen=True)
class UsageFilter:
    start: datetime | None = None
    end: datetime | None = None
    flow: str = ""
    operation: str = ""
    mode: str = ""
    limit: int = 0
    offset: int = 0

    def paging(self) -> tuple[int, int]:
        return (fv.USAGE_LIMIT[0] if self.limit < 1 else self.limit), max(self.offset, 0)

    def _dimensions(self) -> list[Column]:
        wanted = {"flow": self.flow.strip(), "operation": self.operation.strip(), "mode": self.mode.strip()}
        return [F.col(name) == value for name, value in wanted.items() if value]

    def event_condition(self) -> Column:
        """Both ends inclusive, to the exact moment."""
        terms = self._dimensions()
        if self.start:
            terms.append(F.col("created_at") >= F.lit(self.start))
        if self.end:
            terms.append(F.col("created_at") <= F.lit(self.end))
        return reduce(Column.__and__, terms, F.lit(True))

    def day_condition(self) -> Column:
        """Both ends truncated to their UTC day, so the last day counts whole."""
        terms = self._dimensions()
        if self.start:
            terms.append(F.col("day") >= F.lit(_utc_day(self.start)))
        if self.end:
            terms.append(F.col("day") <= F.lit(_utc_day(self.end)))
        return reduce(Column.__and__, terms, F.lit(True))


def _utc_day(value: datetime) -> date:
    return (value.astimezone(timezone.utc) if value.tzinfo else value).date()


def daily_measures() -> list[Column]:
    """Shared by the batch and the streaming aggregate."""
    success = (F.col("status") == "success").cast("long")
    return [
        F.count("*").alias("events_count"),
        F.sum(success).alias("success_count"),
        F.sum(1 - success).cast("long").alias("error_count"),
        *[F.sum(name).cast("long").alias(f"{name}_sum") for name in _COUNTS],
    ]


def daily_usage(events: DataFrame) -> DataFrame:
    """One row per day and dimensions; partial sums are taken map-side."""
    return events.withColumn("day", F.to_date("created_at")).groupBy(*DAILY_KEYS).agg(*daily_measures())


def events_page(events: DataFrame, wanted: UsageFilter) -> DataFrame:
    limit, offset = wanted.paging()
    return page(events.filter(wanted.event_condition()), [F.desc("created_at"), F.desc("event_id")], limit, offset)


#: The order of ``events_page`` as sort keys.
NEWEST_FIRST: list[Key] = [("created_at", True), ("event_id", True)]


def events_deep_page(events: DataFrame, wanted: UsageFilter) -> DataFrame:
    """``events_page`` for large offsets: only the range of the page is sorted."""
    limit, offset = wanted.paging()
    return deep_page(events.filter(wanted.event_condition()), NEWEST_FIRST, limit, offset)


def daily_page(daily: DataFrame, wanted: UsageFilter) -> DataFrame:
    """Newest day first; model and provider complete the order."""
    limit, offset = wanted.paging()
    order = [F.desc("day"), *[F.asc(name) for name in DAILY_KEYS[1:]]]
    return page(daily.filter(wanted.day_condition()), order, limit, offset)


def per_document(events: DataFrame) -> DataFrame:
    """Usage of each document of an index run.

    Two levels, (document, target language) then document, so the distinct
    targets need no distinct aggregate and no set is held in memory.
    """
    embedding = F.col("operation") == "embedding"
    translation = F.col("operation") == "translation"
    target = tx.trim(F.col("target_lang"))
    foreign = translation & (target != "") & (target != tx.trim(F.col("source_lang")))

    def part(when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.greatest(F.col(name), F.lit(0))).otherwise(0))

    by_target = (
        events.withColumn("document_id", tx.trim(F.col("document_id")))
        .filter("document_id <> ''")
        .groupBy("document_id", F.when(foreign, target).alias("target"))
        .agg(
            F.sum(embedding.cast("long")).alias("embedding_calls"),
            part(embedding, "input_chars").alias("embedding_input_chars_sum"),
            part(embedding, "input_tokens").alias("embedding_input_tokens_sum"),
            part(embedding, "total_tokens").alias("embedding_total_tokens_sum"),
            part(translation, "input_tokens").alias("llm_input_tokens_sum"),
            part(translation, "output_tokens").alias("llm_output_tokens_sum"),
            part(translation, "total_tokens").alias("llm_total_tokens_sum"),
            F.max((tx.trim(F.col("status")) == "success").cast("long")).alias("succeeded"),
        )
    )
    has_target = F.col("target").isNotNull()
    summed = [c for c in by_target.columns if c not in ("document_id", "target", "succeeded")]
    return by_target.groupBy("document_id").agg(
        F.sum(has_target.cast("long")).alias("translations_attempted"),
        F.sum(F.when(has_target, F.col("succeeded")).otherwise(0)).cast("long").alias("translations_succeeded"),
        *[F.sum(name).cast("long").alias(name) for name in summed],
    )
