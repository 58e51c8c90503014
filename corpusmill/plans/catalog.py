"""Catalogue queries over the stored ``documents`` and ``document_translations``.

Lists that can grow with the data (objects and sources of a votation) are
returned in long form, one row each, so a votation that owns a third of all
documents is still many small rows. ``with_lists`` nests them where they are
known to be short.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import dates
from corpusmill.functions import fixed_values as fv
from corpusmill.functions import json_values as js
from corpusmill.functions import lang as lg
from corpusmill.functions import text as tx
from corpusmill.functions import urls
from corpusmill.operators.select import first_per_key, page


class NotFound(LookupError):
    """No row for the requested id."""


@dataclass(frozen=True)
class VotationFilter:
    date_from: datetime | None = None
    date_to: datetime | None = None
    level: str = ""
    canton: str = ""
    status: str = ""
    lang: str = ""
    limit: int = fv.LIST_LIMIT[0]
    offset: int = 0

    def condition(self) -> Column:
        terms = [F.col("votation_id") != ""]
        if self.date_from is not None:
            terms.append(F.col("vote_date") >= F.lit(self.date_from))
        if self.date_to is not None:
            terms.append(F.col("vote_date") <= F.lit(self.date_to))
        for name in ("level", "canton", "status"):
            if getattr(self, name):
                terms.append(F.col(name) == getattr(self, name))
        return reduce(Column.__and__, terms)

    def paging(self) -> tuple[int, int]:
        return (fv.LIST_LIMIT[0] if self.limit <= 0 else self.limit), max(self.offset, 0)


@dataclass(frozen=True)
class LanguageSettings:
    supported: Sequence[str] = tuple(fv.SUPPORTED_LANGUAGES)
    default: str = fv.DEFAULT_LANGUAGE
    fallback: str = fv.FALLBACK_LANGUAGE


@dataclass(frozen=True)
class VotationPage:
    items: DataFrame
    objects: DataFrame  # votation_id, object_id
    sources: DataFrame  # votation_id, source_uri
    pending: DataFrame  # document_id, target_lang: translations to request
    total: DataFrame  # one row: number of votations under the filter
    limit: int
    offset: int


_SCALARS = ["level", "canton", "commune_code", "commune_name", "status"]


def display_title(metadata: str = "metadata", title: str = "title") -> Column:
    """Stored display title, else the title."""
    return F.coalesce(F.nullif(F.get_json_object(metadata, "$.display_title"), F.lit("")), F.col(title))


def total_votations(documents: DataFrame, wanted: VotationFilter) -> DataFrame:
    """Votations under the filter, with or without any translation."""
    return documents.filter(wanted.condition()).agg(F.count_distinct("votation_id").alias("total"))


def _rows(documents: DataFrame, translations: DataFrame) -> DataFrame:
    texts = translations.select("document_id", "lang", "title", display_title().alias("display_title"))
    columns = ["id", "votation_id", "vote_date", *_SCALARS, "object_id", "source_uri"]
    return documents.select(*columns).join(texts, F.col("id") == F.col("document_id")).drop("document_id")


def _page_ids(documents: DataFrame, translations: DataFrame, limit: int, offset: int) -> DataFrame:
    """Votations of the page: newest first, undated before all, then by id."""
    translated = translations.select(F.col("document_id").alias("id"))
    listed = documents.select("id", "votation_id", "vote_date").join(translated, "id", "left_semi")
    heads = listed.groupBy("votation_id").agg(
        F.max(F.col("vote_date").isNull()).alias("undated"), F.max("vote_date").alias("newest")
    )
    return page(heads, [F.desc("undated"), F.desc("newest"), F.asc("votation_id")], limit, offset).select("votation_id")


def newest_first() -> list[Column]:
    """Ascending sort keys for: undated rows, then newest, then language, id."""
    return [F.col("vote_date").isNotNull(), -F.unix_micros("vote_date"), F.col("lang"), F.col("id")]


def preferring(lang: str) -> list[Column]:
    return [F.col("lang") != lang, F.col("lang"), F.col("id")]


def summarise_rows(rows: DataFrame, first_order: Sequence[Column], as_of: Column) -> DataFrame:
    """One row per votation: scalars of its first row and its language maps.

    Everything is reduced per (votation, language) with partial aggregates,
    so the rows are read once, a huge votation is spread over all tasks, and
    the maps only ever collect one entry per language.
    """

    def named(column: str) -> Column:
        return F.min_by(column, F.when((F.col(column) != "") & (F.col("lang") != ""), F.col("id"))).alias(column)

    key = F.struct(*[c.alias(f"k{n}") for n, c in enumerate(first_order)])
    per_language = rows.groupBy("votation_id", "lang").agg(
        named("title"),
        named("display_title"),
        F.min_by(F.struct("vote_date", *_SCALARS), key).alias("head"),
        F.min(key).alias("key"),
    )

    def as_map(column: str, alias: str) -> Column:
        entries = F.collect_list(F.when(F.col(column).isNotNull(), F.struct("lang", column)))
        return F.map_from_entries(F.array_sort(entries)).alias(alias)

    whole = per_language.groupBy("votation_id").agg(
        F.min_by("head", "key").alias("head"), as_map("title", "titles"), as_map("display_title", "display_titles")
    )
    return whole.select(
        "votation_id",
        dates.utc_text(F.coalesce("head.vote_date", as_of)).alias("date_iso"),
        *[f"head.{name}" for name in _SCALARS],
        "titles",
        "display_titles",
        F.col("head.vote_date").alias("vote_date"),
    )


def with_translation_state(items: DataFrame, requested: str, languages: LanguageSettings = LanguageSettings()) -> DataFrame:
    """``ready`` when the requested title exists; else the best other title is
    shown for it and the state is ``pending``."""
    code = lg.normalize_code(requested)
    wanted = code if code in languages.supported else languages.default
    shown, titles = F.col("display_titles"), F.col("titles")

    def at(values: Column, key: str) -> Column:
        return F.nullif(tx.trim(F.try_element_at(values, F.lit(key))), F.lit(""))

    def smallest(values: Column) -> Column:
        return F.try_element_at(F.array_sort(F.filter(F.map_entries(values), lambda e: tx.trim(e["value"]) != "")), F.lit(1))

    def choice(value: Column, key: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(key.alias("lang"), value.alias("title")))

    fallback = lg.normalize_code(languages.fallback)
    picked = F.coalesce(
        choice(at(shown, fallback), F.lit(fallback)),
        choice(at(titles, fallback), F.lit(fallback)),
        choice(smallest(shown)["value"], smallest(shown)["key"]),
        choice(smallest(titles)["value"], smallest(titles)["key"]),
    )
    staged = items.withColumns({"language": F.lit(wanted), "__ready": at(shown, wanted).isNotNull(), "__pick": picked})
    pending = ~F.col("__ready") & F.col("__pick").isNotNull()
    filled = F.map_concat(
        F.map_filter(shown, lambda k, _: k != wanted), F.create_map(F.lit(wanted), F.col("__pick.title"))
    )
    return staged.withColumns(
        {
            "display_titles": F.when(pending, filled).otherwise(shown),
            "translation_state": F.when(F.col("__ready"), "ready").when(pending, "pending"),
            "fallback_language": F.when(pending, F.col("__pick.lang")),
            "translation_message": F.when(pending, fv.TRANSLATION_PENDING_MESSAGE),
        }
    ).drop("__ready", "__pick")


def _long(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column) != "").select("votation_id", column).distinct()


def _assemble(rows: DataFrame, order: Sequence[Column], lang: str, as_of: Column, languages: LanguageSettings):
    items = with_translation_state(summarise_rows(rows, order, as_of), lang, languages)
    waiting = items.filter("translation_state = 'pending'").select("votation_id", F.col("language").alias("target_lang"))
    pending = rows.select("votation_id", F.col("id").alias("document_id")).join(waiting, "votation_id")
    return items, pending.select("document_id", "target_lang").distinct()


def list_votations(
    documents: DataFrame,
    translations: DataFrame,
    wanted: VotationFilter = VotationFilter(),
    as_of: Column | None = None,
    languages: LanguageSettings = LanguageSettings(),
    compat_row_paging: bool = False,
) -> VotationPage:
    """A page of votations.

    By default the page counts votations. ``compat_row_paging`` counts joined
    translation rows instead, so a page may hold fewer votations and one may
    straddle two pages.
    """
    as_of = as_of if as_of is not None else dates.moment(None)
    limit, offset = wanted.paging()
    filtered = documents.filter(wanted.condition())
    if compat_row_paging:
        order = [F.desc_nulls_first("vote_date"), F.asc("votation_id"), F.asc("lang"), F.asc("id")]
        rows = page(_rows(filtered, translations), order, limit, offset)
    else:
        ids_ = _page_ids(filtered, translations, limit, offset)
        # At most ``limit`` ids; a page of a size that a request may ask for is broadcast.
        chosen = F.broadcast(ids_) if limit <= fv.LIST_LIMIT[1] else ids_
        rows = _rows(filtered.join(chosen, "votation_id", "left_semi"), translations)
    items, pending = _assemble(rows, newest_first(), wanted.lang, as_of, languages)
    ordered = items.orderBy(F.desc_nulls_first("vote_date"), F.asc("votation_id"))
    return VotationPage(
        ordered, _long(rows, "object_id"), _long(rows, "source_uri"), pending, total_votations(documents, wanted), limit, offset
    )


def with_lists(found: VotationPage, max_per_votation: int | None = None) -> DataFrame:
    """Items with sorted ``object_ids`` and ``source_urls`` arrays.

    For pages whose lists are short; the long form has no lists. With
    ``max_per_votation`` a longer list is an error.
    """

    def nested(df: DataFrame, column: str, alias: str) -> DataFrame:
        sizes = df.groupBy("votation_id").agg(F.count("*").alias("n"))
        if max_per_votation is not None and sizes.filter(F.col("n") > max_per_votation).limit(1).count():
            raise ValueError(f"a votation has more than {max_per_votation} values of {column}; use the long form")
        return df.groupBy("votation_id").agg(F.array_sort(F.collect_list(column)).alias(alias))

    joined = found.items.join(nested(found.objects, "object_id", "object_ids"), "votation_id", "left").join(
        nested(found.sources, "source_uri", "source_urls"), "votation_id", "left"
    )
    empty = F.array().cast("array<string>")
    lists = {name: F.coalesce(F.col(name), empty) for name in ("object_ids", "source_urls")}
    return joined.withColumns(lists).orderBy(F.desc_nulls_first("vote_date"), F.asc("votation_id"))


def get_votation(
    documents: DataFrame,
    translations: DataFrame,
    votation_id: str | None,
    lang: str = "",
    as_of: Column | None = None,
    languages: LanguageSettings = LanguageSettings(),
) -> VotationPage:
    """One votation (every one without an id); the preferred language's row
    gives the scalars."""
    as_of = as_of if as_of is not None else dates.moment(None)
    lang = lang or fv.DEFAULT_LANGUAGE
    chosen = documents if votation_id is None else documents.filter(F.col("votation_id") == votation_id)
    rows = _rows(chosen, translations)
    items, pending = _assemble(rows, preferring(lang), lang, as_of, languages)
    total = chosen.agg(F.count_distinct("votation_id").alias("total"))
    return VotationPage(items, _long(rows, "object_id"), _long(rows, "source_uri"), pending, total, 1, 0)


def list_objects(documents: DataFrame, translations: DataFrame, votation_id: str | None = None, lang: str = "") -> DataFrame:
    """Objects of a votation (of every votation without an id), one row each."""
    chosen = documents.filter(F.col("object_id") != "")
    if votation_id is not None:
        chosen = chosen.filter(F.col("votation_id") == votation_id)
    # Reduce to one document per object before the join, so only those need a title.
    keys = ["votation_id", "object_id"]
    one = first_per_key(chosen.select(*keys, "id", "object_type", "object_theme", "status"), keys, [F.asc("id")])
    texts = translations.filter(F.col("lang") == (lang or fv.DEFAULT_LANGUAGE)).select("document_id", "title")
    joined = one.join(texts, F.col("id") == F.col("document_id"), "left")
    return joined.select(
        "votation_id",
        "object_id",
        F.coalesce("title", F.lit("")).alias("title"),
        "object_type",
        "object_theme",
        tx.slug(F.col("object_id")).alias("slug"),
        "status",
    )


def get_object(documents: DataFrame, translations: DataFrame, object_id: str | None = None, lang: str = "") -> DataFrame:
    """Object detail in the preferred language (of every object without an id)."""
    lang = lang or fv.DEFAULT_LANGUAGE
    chosen = documents.filter(F.col("object_id") == object_id if object_id is not None else F.col("object_id") != "")
    rows = chosen.select(
        "id", "object_id", "votation_id", "object_type", "object_theme", "source_system", "source_metadata"
    ).join(
        translations.select("document_id", "lang", "title", "content_normalized"), F.col("id") == F.col("document_id")
    )
    best = first_per_key(rows, ["object_id"], [F.desc(F.col("lang") == lang), F.asc("lang"), F.asc("id")])
    tags = F.filter(F.array("object_type", "object_theme"), lambda t: t != "")
    return best.select(
        "object_id",
        "votation_id",
        F.col("lang").alias("language"),
        "title",
        "object_type",
        "object_theme",
        F.col("content_normalized").alias("context"),
        js.argument_text(F.col("source_metadata")).alias("arguments"),
        tags.alias("tags"),
        F.array("source_system").alias("source_systems"),
    )


def list_object_sources(documents: DataFrame, object_id: str | None = None) -> DataFrame:
    """Sources of an object (of every object without an id): each uri once,
    its newest document's row; undated documents last."""
    chosen = documents.filter(F.col("object_id") == object_id if object_id is not None else F.col("object_id") != "")
    named = chosen.filter(F.col("source_uri") != "").select(
        "object_id", "source_uri", "source_system", "source_org", "source_metadata", "vote_date", "id"
    )
    newest = [F.desc_nulls_last("vote_date"), F.asc("id")]
    first = first_per_key(named, ["object_id", "source_uri"], newest)
    listed = first.select(
        "object_id",
        urls.catalog_source_type(F.col("source_system"), F.col("source_uri")).alias("type"),
        tx.non_empty(F.col("source_org"), F.col("source_system")).alias("title"),
        F.col("source_uri").alias("url"),
        js.origin(F.col("source_metadata")).alias("origin"),
        "vote_date",
        "id",
    )
    return (listed.orderBy(*newest) if object_id is not None else listed).drop("vote_date", "id")


TAXONOMIES = {
    "level": "levels",
    "canton": "cantons",
    "status": "statuses",
    "object_type": "object_types",
    "object_theme": "themes",
}


def taxonomies(documents: DataFrame, translations: DataFrame) -> DataFrame:
    """``taxonomy, value``: distinct non-empty values, one scan per table.

    Long form because nothing bounds the number of types or themes.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("taxonomy"), F.col(c).alias("value")) for c, name in TAXONOMIES.items()])
    values = documents.select(F.explode(pairs).alias("p")).select("p.taxonomy", "p.value")
    langs = translations.select(F.lit("languages").alias("taxonomy"), F.col("lang").alias("value"))
    return values.unionByName(langs).filter("value <> ''").distinct().orderBy("taxonomy", "value")


def require(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or ``NotFound`` when it is empty."""
    if df.isEmpty():
        raise NotFound(what)
    return df
