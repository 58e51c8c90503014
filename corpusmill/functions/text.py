"""String functions on columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv

# With the Unicode flag \s is exactly the White_Space property.
SPACE_RUN = r"(?U)\s+"

_LOCAL_PART = r"[A-Za-z0-9._%+\-]"
# A match can only start where a run of local-part characters starts (or right
# after the previous match), so the scan stays linear on long junk words.
EMAIL = rf"(?:\G|(?<!{_LOCAL_PART})){_LOCAL_PART}++@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}"
PHONE = r"\+?[0-9][0-9\-\t\n\f\r ]{7,}[0-9]"


def trim(text: Column) -> Column:
    """Trim every Unicode white-space character on both sides."""
    return F.trim(text, F.lit(fv.WHITE_SPACE))


def squeeze(text: Column) -> Column:
    """Collapse white-space runs to one blank and trim."""
    return F.trim(F.regexp_replace(text, SPACE_RUN, " "))


def words(text: Column) -> Column:
    """White-space separated tokens; an empty array for blank text."""
    return F.array_remove(F.split(text, SPACE_RUN), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over one evaluation of ``value``, which it may use many times.

    Keeps nested expressions from growing exponentially. It is interpreted, so
    it is only for small inputs such as the hits of a question.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def byte_len(text: Column) -> Column:
    return F.octet_length(text)


def byte_prefix(text: Column, limit: int) -> Column:
    """The longest prefix of whole characters that fits in ``limit`` bytes.

    Seen as single bytes, the prefix must not be followed by a UTF-8
    continuation byte (80-BF).
    """
    single_bytes = F.decode(F.substring(text.cast("binary"), 1, limit + 1), "ISO-8859-1")
    fitting = F.regexp_extract(single_bytes, rf"(?s)^(.{{0,{limit}}})(?![\x80-\xBF])", 1)
    return F.encode(fitting, "ISO-8859-1").cast("string")


def non_empty(value: Column, fallback: Column) -> Column:
    """``value`` untouched unless it is null or blank."""
    return F.when(trim(F.coalesce(value, F.lit(""))) == "", fallback).otherwise(value)


def first_non_empty(*values: Column) -> Column:
    """First value that is not blank, trimmed; empty text if there is none."""
    picked = [F.nullif(trim(value), F.lit("")) for value in values]
    return F.coalesce(*picked, F.lit(""))


def compact(text: Column, limit: int) -> Column:
    """Squeeze, cut to ``limit`` bytes and mark the cut with three dots."""
    flat = squeeze(text)
    return F.when(byte_len(flat) <= limit, flat).otherwise(
        F.concat(F.trim(byte_prefix(flat, limit)), F.lit("..."))
    )


def end_sentence(text: Column) -> Column:
    return F.when(text == "", text).when(F.right(text, F.lit(1)).isin(".", "!", "?"), text).otherwise(
        F.concat(text, F.lit("."))
    )


def highlight(text: Column, limit: int = fv.HIGHLIGHT_BYTES) -> Column:
    """A sentence-like snippet: cut at the last blank that leaves enough text."""

    def at_blank(head: Column) -> Column:
        before = F.left(head, F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1)
        return F.when(F.contains(head, F.lit(" ")) & (byte_len(before) > fv.HIGHLIGHT_MIN_BREAK), before).otherwise(head)

    def cut(flat: Column) -> Column:
        return F.when(byte_len(flat) > limit, let(byte_prefix(flat, limit), at_blank)).otherwise(flat)

    return let(F.trim(let(squeeze(text), cut)), end_sentence)


def lead(text: Column, limit: int = fv.HIGHLIGHT_BYTES) -> Column:
    """The opening of a text that has the same ``highlight``: squeezed, and so long that
    what is left without a blank at its end is still longer than ``limit`` bytes."""
    return F.left(squeeze(text), F.lit(limit + 2))


def sample_snippet(text: Column, limit: int = fv.SAMPLE_SNIPPET_BYTES) -> Column:
    return F.when(byte_len(text) > limit, F.concat(byte_prefix(text, limit), F.lit("..."))).otherwise(text)


def strip_markdown(text: Column) -> Column:
    return F.translate(text, "#*_`[]()", " " * 8)


def slug(text: Column) -> Column:
    return F.translate(F.lower(trim(text)), " _/:.", "-----")


def redact(text: Column) -> Column:
    # most texts have no "@", and looking for it is much cheaper than the pattern
    masked = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL, fv.EMAIL_MARK)).otherwise(text)
    return F.regexp_replace(masked, PHONE, fv.PHONE_MARK)


def has_email(text: Column) -> Column:
    return F.contains(text, F.lit("@")) & F.rlike(text, F.lit(EMAIL))


def has_phone(text: Column) -> Column:
    return F.rlike(text, F.lit(PHONE))


def sanitize_question(text: Column, max_bytes: int | None = None) -> Column:
    """Trim and mask personal data; with ``max_bytes`` (the replaced application
    used ``fv.QUESTION_BYTES``) only so much of the question is kept."""
    whole = trim(text)
    return trim(redact(whole if max_bytes is None else byte_prefix(whole, max_bytes)))


def is_cacheable(question: Column) -> Column:
    return (
        (trim(question) != "")
        & ~F.contains(question, F.lit(fv.EMAIL_MARK))
        & ~F.contains(question, F.lit(fv.PHONE_MARK))
    )


def token_estimate(byte_count: Column) -> Column:
    """About four bytes per token, at least one for any text."""
    return F.when(byte_count <= 0, 0).otherwise(F.ceil(byte_count / 4)).cast("long")


def base_name(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def count_contained(text: Column, parts: Sequence[str]) -> Column:
    total = F.lit(0)
    for part in parts:
        total = total + F.contains(text, F.lit(part)).cast("int")
    return total


def argument_side(text: Column) -> Column:
    """pro / contra / unknown by counted word parts; a tie counts as pro."""

    def side(counts: Column) -> Column:
        pro, contra = counts["pro"], counts["contra"]
        return F.when((pro == 0) & (contra == 0), "unknown").when(pro >= contra, "pro").otherwise("contra")

    def counts(low: Column) -> Column:
        return F.struct(count_contained(low, fv.PRO_WORDS).alias("pro"), count_contained(low, fv.CONTRA_WORDS).alias("contra"))

    return let(let(F.lower(text), counts), side)


def is_initiant_role(role: Column) -> Column:
    return contains_any(F.lower(trim(role)), fv.INITIANT_ROLE_WORDS)


def file_label(hint: Column, url: Column) -> Column:
    """Readable name for a stored page: the hint, else the url path, dashes only."""
    path = F.translate(F.trim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), "/._", "---")
    label = F.translate(F.lower(first_non_empty(hint, path, F.lit("node"))), " /:?&=._", "--------")
    return F.trim(F.regexp_replace(label, "-+", "-"), F.lit("-"))
