"""Summaries by a chat model, and the usage events they leave.

The model is a function from prompt to raw response text. It is called inside
tasks, one Arrow batch of prompts at a time; everything around it (prompts,
token counts, events) is expressions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import json_values as js
from corpusmill.functions import text as tx
from corpusmill.operators import summary

Chat = Callable[[str], str]
ATTEMPTS = 3
_TEXT_PARTS = ("", "text", "output_text")


def _clean(value: Any) -> str:
    return value.strip() if isinstance(value, str) else ""


def _content_text(content: Any) -> str:
    """A plain string, or the text parts of a list, one per line."""
    if not isinstance(content, list):
        return _clean(content)
    parts = [
        _clean(part) if isinstance(part, str) else _clean(part.get("text"))
        for part in content
        if isinstance(part, str) or (isinstance(part, dict) and _clean(part.get("type")) in _TEXT_PARTS)
    ]
    return "\n".join(part for part in parts if part)


def chat_reply(body: str) -> tuple[str, str]:
    """``(text, problem)`` of a chat response; one of them is empty.

    Problems: decode_failed, no_choices, reasoning_only, empty_summary.
    """
    try:
        choices = json.loads(body).get("choices")
    except (ValueError, AttributeError):
        return "", "decode_failed"
    if not isinstance(choices, list) or not choices or not isinstance(choices[0], dict):
        return "", "no_choices"
    message = choices[0].get("message")
    message = message if isinstance(message, dict) else {}
    text = _content_text(message.get("content")) or _clean(choices[0].get("text"))
    if text:
        return text, ""
    thought = _clean(message.get("reasoning_content")) or _clean(message.get("reasoning"))
    return "", "reasoning_only" if thought else "empty_summary"


def summarize(
    hits: DataFrame, question: Column, language: Column, chat: Chat, max_bytes: int | None = None, max_hits: int | None = None
) -> DataFrame:
    """``query_id, prompt, answer, error_code, body, duration_ms``.

    A response that holds only reasoning is asked for again, up to three
    times. Failed rows keep an empty answer and say why; ``require_answers``
    turns them into an error.
    """
    asked = summary.prompts(hits, question, language, max_bytes, max_hits)
    if max_bytes is not None:
        asked = asked.withColumn("prompt", tx.byte_prefix(F.col("prompt"), max_bytes))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            done = []
            for prompt in rows["prompt"]:
                started = time.monotonic()
                for _ in range(ATTEMPTS):
                    body = chat(prompt)
                    text, problem = chat_reply(body)
                    if problem != "reasoning_only":
                        break
                done.append((text, problem, body, int((time.monotonic() - started) * 1000)))
            columns = ["answer", "error_code", "body", "duration_ms"]
            yield rows.join(pd.DataFrame(done, columns=columns, index=rows.index))

    kind = asked.schema["query_id"].dataType.simpleString()
    schema = f"query_id {kind}, prompt string, answer string, error_code string, body string, duration_ms long"
    return asked.mapInPandas(work, schema)


def require_answers(results: DataFrame) -> DataFrame:
    failed = F.raise_error(F.concat(F.lit("summarize failed: "), F.col("error_code"))).cast("string")
    return results.withColumn("answer", F.when(F.col("error_code") != "", failed).otherwise(F.col("answer")))


def usage_events(results: DataFrame, model_name: str, operation: str = "summarization") -> DataFrame:
    """One usage event per call, ready for ``usage.apply_scope``."""
    counted = results.withColumn("usage", js.usage_tokens(F.when(F.col("error_code") != "decode_failed", F.col("body"))))
    blank = {name: F.lit("") for name in ("event_id", "flow", "mode", "run_id", "request_id", "document_id", "source_lang", "target_lang")}
    values = {
        **blank,
        "created_at": F.current_timestamp(),
        "operation": F.lit(operation),
        "provider_name": F.lit("llm"),
        "model_name": F.lit(model_name),
        "input_chars": tx.byte_len(F.col("prompt")).cast("long"),
        "output_chars": tx.byte_len(F.col("answer")).cast("long"),
        "input_tokens": F.coalesce("usage.input_tokens", F.lit(0)),
        "output_tokens": F.coalesce("usage.output_tokens", F.lit(0)),
        "total_tokens": F.coalesce("usage.total_tokens", F.lit(0)),
        "usage_source": F.coalesce("usage.usage_source", F.lit("unknown")),
        "status": F.when(F.col("error_code") == "", "success").otherwise("error"),
        "duration_ms": F.col("duration_ms"),
        "error_code": F.col("error_code"),
    }
    return counted.select(*[value.alias(name) for name, value in values.items()])
