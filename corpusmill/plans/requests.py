"""Checks of request arguments; the messages name the argument."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from datetime import datetime

from corpusmill.functions import fixed_values as fv
from corpusmill.functions import lang as lg
from corpusmill.operators.usage import UsageFilter
from corpusmill.plans.catalog import VotationFilter

_SAFE_ID = re.compile(r"[a-zA-Z0-9:_\-.]{2,120}")
_CANTON = re.compile(r"[A-Z]{2,3}")
_RFC3339 = re.compile(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})")
_BODY_KEYS = {"question": str, "language": str, "context": dict, "client": dict}
_NESTED_KEYS = {"context": {"votationId", "objectId", "canton"}, "client": {"instance", "version"}}


class InvalidRequest(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def _query_error(name: str) -> InvalidRequest:
    return InvalidRequest("invalid_query", f"{name} is invalid")


def is_safe_id(value: str) -> bool:
    return bool(_SAFE_ID.fullmatch(value))


def safe_id(value: str) -> str:
    if not is_safe_id(value):
        raise InvalidRequest("invalid_path_param", "id is invalid")
    return value


def _number(args: Mapping[str, str], name: str, default: int, low: int, high: int | None) -> int:
    raw = args.get(name, "").strip()
    if not raw:
        return default
    if not re.fullmatch(r"[+-]?\d+", raw) or int(raw) < low or (high is not None and int(raw) > high):
        raise _query_error(name)
    return int(raw)


def _choice(args: Mapping[str, str], name: str, allowed: Sequence[str]) -> str:
    value = args.get(name, "").strip().lower()
    if value and value not in allowed:
        raise _query_error(name)
    return value


def _moment(args: Mapping[str, str], name: str) -> datetime | None:
    raw = args.get(name, "").strip()
    if not raw:
        return None
    try:
        if not _RFC3339.fullmatch(raw):
            raise ValueError(raw)
        return datetime.fromisoformat(raw)
    except ValueError:
        raise _query_error(name) from None


def votation_filter(args: Mapping[str, str]) -> VotationFilter:
    canton = args.get("canton", "").strip().upper()
    if canton and not _CANTON.fullmatch(canton):
        raise _query_error("canton")
    return VotationFilter(
        date_from=_moment(args, "date_from"),
        date_to=_moment(args, "date_to"),
        level=_choice(args, "level", fv.LEVELS),
        canton=canton,
        status=_choice(args, "status", fv.STATUSES),
        lang=lg.normalize_code(args.get("lang", "")) or fv.DEFAULT_LANGUAGE,
        limit=_number(args, "limit", fv.LIST_LIMIT[0], 1, fv.LIST_LIMIT[1]),
        offset=_number(args, "offset", 0, 0, None),
    )


def usage_filter(args: Mapping[str, str]) -> tuple[UsageFilter, str]:
    """The filter and the granularity, ``day`` unless ``event`` is asked for."""
    granularity = _choice(args, "granularity", ["event", "day"]) or "day"
    start, end = _moment(args, "from"), _moment(args, "to")
    if start and end and start > end:
        raise _query_error("from")
    wanted = UsageFilter(
        start=start,
        end=end,
        flow=_choice(args, "flow", fv.USAGE_FLOWS),
        operation=_choice(args, "operation", fv.USAGE_OPERATIONS),
        mode=_choice(args, "mode", fv.USAGE_MODES),
        limit=_number(args, "limit", fv.USAGE_LIMIT[0], 1, fv.USAGE_LIMIT[1]),
        offset=_number(args, "offset", 0, 0, None),
    )
    return wanted, granularity


def question_body(raw: str) -> dict[str, str]:
    """A question request: one JSON object, known keys only."""

    def broken() -> InvalidRequest:
        return InvalidRequest("invalid_body", "body is invalid")

    try:
        body = json.loads(raw)
    except ValueError:
        raise broken() from None
    if not isinstance(body, dict):
        raise broken()
    for key, value in body.items():
        if key not in _BODY_KEYS or not isinstance(value, _BODY_KEYS[key]):
            raise broken()
        if key in _NESTED_KEYS and any(
            inner not in _NESTED_KEYS[key] or not isinstance(text, str) for inner, text in value.items()
        ):
            raise broken()
    question, context = body.get("question", ""), body.get("context", {})
    if not question.strip():
        raise InvalidRequest("invalid_body", "question is required")
    if len(question.encode()) > fv.QUESTION_REJECT_BYTES:
        raise InvalidRequest("invalid_body", "question is too long")
    for name in ("votationId", "objectId"):
        if context.get(name) and not is_safe_id(context[name]):
            raise InvalidRequest("invalid_body", f"context.{name} is invalid")
    canton = context.get("canton", "").upper()
    if canton and not _CANTON.fullmatch(canton):
        raise InvalidRequest("invalid_body", "context.canton is invalid")
    return {
        "question": question,
        "language": body.get("language", ""),
        "votation_id": context.get("votationId", ""),
        "object_id": context.get("objectId", ""),
        "canton": canton,
    }
