"""Language-code functions.

The four normalisers differ on purpose (region kept or stripped, unknown code
to empty or to a default) and must not be merged.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv
from corpusmill.functions import text as tx


def normalize(code: Column) -> Column:
    """Lower-cased code, or empty text when it is not ``xx`` / ``xx-yy``."""
    low = F.lower(tx.trim(F.coalesce(code, F.lit(""))))
    return F.when(F.rlike(low, F.lit(fv.LANGUAGE_CODE)), low).otherwise("")


def supported_or_empty(code: Column, supported: Sequence[str] = fv.SUPPORTED_LANGUAGES) -> Column:
    low = normalize(code)
    return F.when(low.isin(*supported), low).otherwise("")


def normalize_or(code: Column, fallback: str, supported: Sequence[str] = fv.SUPPORTED_LANGUAGES) -> Column:
    low = normalize(code)
    known = low != ""
    if supported:
        known = known & low.isin(*supported)
    return F.when(known, low).otherwise(fallback)


def request_language(code: Column) -> Column:
    """Request language: region kept, anything malformed becomes the default."""
    low = normalize(code)
    return F.when(low == "", fv.DEFAULT_LANGUAGE).otherwise(low)


def summary_language(code: Column) -> Column:
    """Language of a summary: region dropped, blank becomes the default."""
    low = F.lower(tx.trim(F.coalesce(code, F.lit(""))))
    base = F.when(F.locate("-", low) > 1, F.substring_index(low, "-", 1)).otherwise(low)
    return F.when(base == "", fv.DEFAULT_LANGUAGE).otherwise(base)


def message(messages: dict[str, str], code: Column) -> Column:
    """Text of ``code``, or the default language's text."""
    picked = F.lit(messages[fv.DEFAULT_LANGUAGE])
    for lang, value in messages.items():
        picked = F.when(code == lang, value).otherwise(picked)
    return picked


def from_location(url: Column, path: Column) -> Column:
    """Language named by a path marker such as ``/de/``; French otherwise."""
    where = F.lower(F.concat_ws(" ", F.coalesce(url, F.lit("")), F.coalesce(path, F.lit(""))))
    picked = F.lit(fv.DEFAULT_LANGUAGE)
    for code in reversed(fv.LANGUAGE_PATH_MARKERS):
        picked = F.when(F.contains(where, F.lit(f"/{code}/")), code).otherwise(picked)
    return picked


def rank_in(code: Column, order: Sequence[str]) -> Column:
    """Position of ``code`` in ``order``; codes outside rank last."""
    rank = F.lit(len(order))
    for position in range(len(order) - 1, -1, -1):
        rank = F.when(code == order[position], position).otherwise(rank)
    return rank


def stable_sorted(codes: Column) -> Column:
    """Sorted distinct valid codes of an array column."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(codes, normalize), lambda c: c != "")))


def first_preferred(codes: Column, order: Sequence[str] = fv.SUPPORTED_LANGUAGES) -> Column:
    """First language of ``order`` that is in the array, else its first element."""
    preferred = F.filter(F.array(*[F.lit(c) for c in order]), lambda c: F.array_contains(codes, c))
    return F.coalesce(F.try_element_at(preferred, F.lit(1)), F.try_element_at(codes, F.lit(1)), F.lit(order[0]))


def localized(values: Column, order: Sequence[str] = fv.SUPPORTED_LANGUAGES) -> Column:
    """Best text of a language map: fixed order first, then the smallest key."""
    ordered = [F.nullif(tx.trim(F.try_element_at(values, F.lit(code))), F.lit("")) for code in order]
    filled = F.map_keys(F.map_filter(values, lambda _, text: tx.trim(text) != ""))
    smallest = tx.trim(F.try_element_at(values, F.array_min(filled)))
    return F.coalesce(*ordered, smallest, F.lit(""))


# --- request-time helpers (one header or one option, never data) ------------


def normalize_code(code: str) -> str:
    low = (code or "").strip().lower()
    return low if re.fullmatch(r"[a-z]{2}(-[a-z]{2})?", low) else ""


def base_code(code: str) -> str:
    return normalize_code(code).split("-")[0]


def parse_supported(raw: str, defaults: Sequence[str] = fv.SUPPORTED_LANGUAGES) -> list[str]:
    parts = raw.split(",") if raw.strip() else list(defaults)
    return list(dict.fromkeys(code for code in map(normalize_code, parts) if code))


def accepted_languages(header: str) -> list[str]:
    """Codes of an Accept-Language header in written order; q=0 entries dropped."""
    accepted: dict[str, None] = {}
    for item in header.split(","):
        tag, *params = [part.strip() for part in item.split(";")]
        quality = next((p[2:].strip() for p in params if p.lower().startswith("q=")), "1")
        code = base_code(tag)
        if code and quality not in ("0", "0.0", "0.00", "0.000"):
            accepted.setdefault(code)
    return list(accepted)


def resolve_question_language(
    body: str = "",
    header: str = "",
    supported: Sequence[str] = fv.SUPPORTED_LANGUAGES,
    default: str = fv.DEFAULT_LANGUAGE,
) -> str:
    """Body language, else the first supported header language, else the default."""
    if body.strip():
        code = base_code(body)
        if not code:
            raise ValueError("language is malformed")
        if supported and code not in supported:
            raise ValueError("language is not supported")
        return code
    wanted = accepted_languages(header)
    if wanted:
        for code in wanted:
            if not supported or code in supported:
                return code
        raise ValueError("language is not supported")
    code = base_code(default)
    if code and (not supported or code in supported):
        return code
    return supported[0] if supported else fv.DEFAULT_LANGUAGE
