"""From crawled API payloads to normalised votes.

Payload pages are exploded to rows with their position, and every per-vote
step is a join, an aggregate or a ranked selection keyed by ``voting_id``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import dates
from corpusmill.functions import fixed_values as fv
from corpusmill.functions import lang as lg
from corpusmill.functions import text as tx
from corpusmill.operators.select import first_per_key, top_per_key
from corpusmill.session import cut_lineage


def page_rows(pages: DataFrame, element: T.StructType, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """Elements of ``{"data": [...]}`` bodies, with their ``position``."""
    page = T.StructType([T.StructField("data", T.ArrayType(element))])
    parsed = pages.select(*(keep or [c for c in pages.columns if c != body]), F.from_json(body, page).alias("__page"))
    kept = [c for c in parsed.columns if c != "__page"]
    return parsed.select(*kept, F.posexplode("__page.data").alias("position", "row")).select(*kept, "position", "row.*")


# --- selection ---------------------------------------------------------------


def select_votings(votings: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Future votings in listed order, or all when none is ahead; with ``limit``
    (the replaced application had ``fv.CRAWL_VOTINGS``) the first of them.

    Future rows sort first, so the first ``limit`` rows decide everything and
    the final filter runs on that bounded set only; without one, whether any is
    ahead is added up first.
    """
    when = dates.parse_vote_time(F.col("date"))
    marked = votings.withColumn("__future", F.coalesce(when > as_of, F.lit(False)))
    if limit is None:
        head = marked.crossJoin(F.broadcast(marked.agg(F.max("__future").alias("__any"))))
    else:
        first = marked.orderBy(F.desc("__future"), F.asc("position")).limit(limit)
        head = first.withColumn("__any", F.max("__future").over(Window.partitionBy(F.lit(0))))
    return (
        head.filter(F.col("__future") == F.col("__any"))
        .withColumn("selection_strategy", F.when(F.col("__any"), "future").otherwise("fallback_past"))
        .drop("__future", "__any")
    )


def seed_urls(votings: DataFrame) -> DataFrame:
    """``voting_id, position, name, url``: the crawl's starting points."""
    api = F.concat(F.lit(f"{fv.VOTE_API_ROOT}/votings/"), F.col("id").cast("string"), F.lit("/affairs"))
    named = [
        ("voting", F.col("url_api")),
        ("affairs", F.col("links.affairs")),
        ("votes", F.col("links.votes")),
        ("meeting", F.col("links.meeting")),
        ("bodies", F.col("links.bodies")),
        ("affairs-fallback", F.when(tx.trim(F.coalesce("links.affairs", F.lit(""))) == "", api)),
    ]
    seeds = F.array(*[F.struct(F.lit(name).alias("name"), tx.trim(url).alias("url")) for name, url in named])
    rows = votings.select(F.col("id").alias("voting_id"), F.posexplode(seeds).alias("position", "seed"))
    return rows.select("voting_id", "position", "seed.name", "seed.url").filter(F.coalesce("url", F.lit("")) != "")


def required_urls(affairs: DataFrame) -> DataFrame:
    """``voting_id, kind, url`` of the payloads a vote document needs."""
    base = F.concat(F.lit(f"{fv.VOTE_API_ROOT}/affairs/"), F.col("id").cast("string"), F.lit("/"))
    wanted = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                tx.first_non_empty(F.col(f"links.{kind}"), F.concat(base, F.lit(kind))).alias("url"),
            )
            for kind in ("contributors", "docs", "texts")
        ]
    )
    return affairs.select("voting_id", F.explode(wanted).alias("w")).select("voting_id", "w.kind", "w.url")


def missing_bodies(required: DataFrame, crawled: DataFrame) -> DataFrame:
    """Required urls that the crawl did not bring; only these are fetched."""
    return required.select("url").distinct().join(crawled.select("url"), "url", "left_anti")


# --- parts of a vote ---------------------------------------------------------


def display_titles(affair_title: Column, affair: Column, voting: Column) -> Column:
    """Per language: the voting's affair title, the affair's, the voting's own."""

    def best(code: str) -> Column:
        options = [F.nullif(tx.trim(F.try_element_at(m, F.lit(code))), F.lit("")) for m in (affair_title, affair, voting)]
        return F.coalesce(*options)

    entries = F.array(*[F.struct(F.lit(code).alias("key"), best(code).alias("value")) for code in fv.SUPPORTED_LANGUAGES])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def clean_map(values: Column) -> Column:
    """Trimmed keys and texts, blank texts dropped; null when nothing is left."""
    kept = F.map_filter(values, lambda _, v: tx.trim(v) != "")
    trimmed = F.map_from_entries(
        F.transform(F.map_entries(kept), lambda e: F.struct(tx.trim(e["key"]).alias("key"), tx.trim(e["value"]).alias("value")))
    )
    return F.when(F.size(trimmed) > 0, trimmed)


def initiants(contributors: DataFrame) -> DataFrame:
    """``voting_id, position, fullname, party, role``.

    People with an initiant's role; where a vote has none, all its persons.
    """
    full = tx.first_non_empty(
        F.col("fullname"),
        F.concat_ws(" ", tx.trim(F.coalesce("firstname", F.lit(""))), tx.trim(F.coalesce("lastname", F.lit("")))),
    )
    rows = contributors.select(
        "voting_id",
        "position",
        full.alias("name"),
        lg.localized(F.col("party")).alias("party"),
        tx.first_non_empty(lg.localized(F.col("role_harmonized")), lg.localized(F.col("role"))).alias("role"),
        (F.lower(tx.trim(F.coalesce("type", F.lit("")))) == "person").alias("person"),
    ).filter("name <> ''")
    marked = rows.withColumn("initiant", tx.is_initiant_role(F.col("role")))
    some = marked.groupBy("voting_id").agg(F.max("initiant").alias("__some"))
    picked = marked.join(some, "voting_id").filter(F.when(F.col("__some"), F.col("initiant")).otherwise(F.col("person")))
    return picked.select("voting_id", "position", F.col("name").alias("fullname"), "party", "role")


def _piece(text: Column, limit: int | None) -> Column:
    return tx.squeeze(text) if limit is None else tx.compact(text, limit)


def _marked(docs: DataFrame, texts: DataFrame, doc_bytes: int | None, text_bytes: int | None) -> DataFrame:
    """``voting_id, origin, position, found``: the piece and its side, null for
    a blank piece. A piece is made once per row, whatever is asked of it."""

    def found(text: Column, limit: int | None, side: Callable[[Column], Column]) -> Column:
        return tx.let(_piece(text, limit), lambda p: F.when(p != "", F.struct(p.alias("piece"), side(p).alias("side")))).alias("found")

    from_docs = docs.select("voting_id", F.lit(0).alias("origin"), "position", found(F.col("text"), doc_bytes, tx.argument_side))
    unknown = found(lg.localized(F.col("text")), text_bytes, lambda p: F.lit("unknown"))
    return from_docs.unionByName(texts.select("voting_id", F.lit(1).alias("origin"), "position", unknown))


def _sided(docs: DataFrame, texts: DataFrame, doc_bytes: int | None, text_bytes: int | None) -> DataFrame:
    """``voting_id, origin, position, piece, side`` of pieces that are not blank."""
    marked = _marked(docs, texts, doc_bytes, text_bytes)
    return marked.withColumn("found", F.explode(F.array_compact(F.array("found")))).select("voting_id", *_IN_ORDER, "found.*")


_IN_ORDER = ("origin", "position")


def argument_pieces(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``voting_id, side, origin, position, piece``: the arguments pro and
    contra, one whole document or text a row, in the order (origin, position).

    Documents are sorted into sides by all their words. Where a vote has none
    for a side, its first piece of no side stands in for pro, its second for
    contra. Nothing is gathered per vote: sides are decided in one pass that
    keeps no text, a side's presence is a flag added up before the shuffle, and
    the two stand-ins come from a limited rank. Texts are read once more for the
    result, where the few stand-ins meet them.
    """
    pieces = _sided(docs, texts, None, None)
    sides = cut_lineage(pieces.select("voting_id", *_IN_ORDER, "side"))
    known = sides.filter("side <> 'unknown'")
    has = known.groupBy("voting_id").agg(*[F.max((F.col("side") == s).cast("int")).alias(f"has_{s}") for s in ("pro", "contra")])
    free = top_per_key(sides.filter("side = 'unknown'"), ["voting_id"], [F.asc(c) for c in _IN_ORDER], 2, rank="nth")
    standing = free.withColumn("stand", F.when(F.col("nth") == 1, "pro").otherwise("contra")).join(has, "voting_id", "left")
    missing = F.when(F.col("stand") == "pro", F.col("has_pro")).otherwise(F.col("has_contra"))
    standing = standing.filter(F.coalesce(missing, F.lit(0)) == 0).select("voting_id", *_IN_ORDER, "stand")
    side = F.when(F.col("side") == "unknown", F.col("stand")).otherwise(F.col("side"))
    placed = pieces.join(standing, ["voting_id", *_IN_ORDER], "left").withColumn("side", side)
    return placed.filter("side is not null").select("voting_id", "side", *_IN_ORDER, "piece")


def arguments(docs: DataFrame, texts: DataFrame, side_bytes: int, doc_bytes: int | None = None, text_bytes: int | None = None) -> DataFrame:
    """``voting_id, pro, contra``: each side as one text of ``side_bytes`` at most.

    For short displays; ``argument_pieces`` has everything. A piece takes at
    least two bytes with its separator, so the first pieces up to half the
    limit decide the result. They are ranked within hashed parts of a vote
    first, each part keeping that many, then among what is left.
    """
    most, parts = side_bytes // 2 + 1, 64
    pieces = _sided(docs, texts, doc_bytes, text_bytes).withColumn("part", F.pmod(F.xxhash64("origin", "position"), F.lit(parts)))
    order = [F.asc(c) for c in _IN_ORDER]
    some = top_per_key(pieces, ["voting_id", "side", "part"], order, most)
    first = top_per_key(some, ["voting_id", "side"], order, most, rank="nth")
    gathered = first.groupBy("voting_id").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("nth", "piece")))).alias(side)
            for side in ("pro", "contra", "unknown")
        ]
    )

    def filler(at: int) -> Column:
        return F.try_element_at(F.col("unknown"), F.lit(at))["piece"]

    def side(name: str, at: int) -> Column:
        joined = F.array_join(F.transform(name, lambda p: p["piece"]), "\n\n")
        text = F.when(F.size(name) > 0, joined).otherwise(filler(at))
        return F.coalesce(tx.compact(text, side_bytes), F.lit(fv.ARGUMENT_MISSING)).alias(name)

    return gathered.select("voting_id", side("pro", 1), side("contra", 2))


def whole_arguments(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``voting_id, pro, contra``: all of ``argument_pieces``, a side as one text."""
    placed = argument_pieces(docs, texts).groupBy("voting_id").agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct(*_IN_ORDER, "piece")))).alias(side)
            for side in ("pro", "contra")
        ]
    )
    joined = [F.nullif(F.array_join(F.transform(s, lambda p: p["piece"]), "\n\n"), F.lit("")) for s in ("pro", "contra")]
    return placed.select("voting_id", *[F.coalesce(j, F.lit(fv.ARGUMENT_MISSING)).alias(s) for j, s in zip(joined, ("pro", "contra"), strict=True)])


def available_languages(votings: DataFrame, affairs: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """``voting_id, available_languages``: sorted codes with any text.

    Distinct (vote, language) pairs first, so a set holds at most five codes.
    """

    def of_map(df: DataFrame, column: str) -> DataFrame:
        filled = F.map_keys(F.map_filter(column, lambda _, v: tx.trim(v) != ""))
        return df.select("voting_id", F.explode(filled).alias("lang"))

    sources = [
        *[of_map(votings, c) for c in ("title", "affair_title")],
        *[of_map(affairs, c) for c in ("title", "title_long", "type_name", "state_name")],
        docs.select("voting_id", F.col("language").alias("lang")),
        of_map(texts, "text"),
    ]
    pairs = sources[0]
    for more in sources[1:]:
        pairs = pairs.unionByName(more)
    known = pairs.select("voting_id", F.lower(tx.trim(F.col("lang"))).alias("lang"))
    known = known.filter(F.col("lang").isin(*fv.SUPPORTED_LANGUAGES)).distinct()
    sets = known.groupBy("voting_id").agg(F.array_sort(F.collect_list("lang")).alias("codes"))
    default = F.array(F.lit(fv.DEFAULT_LANGUAGE))
    return votings.select("voting_id").join(sets, "voting_id", "left").select(
        "voting_id", F.coalesce("codes", default).alias("available_languages")
    )


def locations(votings: DataFrame, bodies: DataFrame) -> DataFrame:
    """``voting_id, canton, commune_code, commune_name`` from body payloads.

    ``bodies``: ``voting_id, url, position, body_key, canton_key, name``. Body
    pages come before other pages, the voting's own body before the first
    listed one, and a match with a place before one without. Only numeric
    body keys name a commune.
    """
    key, canton = tx.trim(F.coalesce("body_key", F.lit(""))), F.upper(tx.trim(F.coalesce("canton_key", F.lit(""))))
    rows = bodies.select(
        "voting_id", "url", "position", key.alias("key"), canton.alias("canton"), tx.trim(lg.localized(F.col("name"))).alias("place")
    ).filter("key <> '' or canton <> '' or place <> ''")
    target = votings.select("voting_id", tx.trim(F.coalesce("body_key", F.lit(""))).alias("target"))
    joined = rows.join(target, "voting_id")
    own = (F.col("target") != "") & (F.col("key") == F.col("target"))
    tier = F.when(own & ((F.col("canton") != "") | (F.col("place") != "")), 0).when(own, 1).otherwise(2)
    other_page = ~F.contains(F.lower("url"), F.lit("/bodies"))
    best = first_per_key(joined, ["voting_id"], [other_page, tier, F.asc("url"), F.asc("position")])
    commune = F.rlike("key", F.lit(r"^\d+$"))
    return best.select(
        "voting_id",
        "canton",
        F.when(commune, F.col("key")).otherwise("").alias("commune_code"),
        F.when(commune, F.col("place")).otherwise("").alias("commune_name"),
    )


def vote_documents(
    votings: DataFrame,
    affairs: DataFrame,
    contributors: DataFrame,
    docs: DataFrame,
    texts: DataFrame,
    bodies: DataFrame,
    as_of: Column,
    doc_bytes: int | None = None,
    text_bytes: int | None = None,
    side_bytes: int | None = None,
    argument_doc_bytes: int | None = None,
    argument_text_bytes: int | None = None,
) -> DataFrame:
    """``voting_id, document``: the normalised vote as one JSON text.

    Documents, texts and arguments are whole, documents sorted into sides by all
    their words. The limits of the replaced application are ``fv.DOC_TEXT_BYTES``
    of a document, ``fv.FREE_TEXT_BYTES`` of a text, ``fv.ARGUMENT_SIDE_BYTES`` of
    a side, and ``fv.ARGUMENT_DOC_BYTES`` and ``fv.ARGUMENT_TEXT_BYTES`` of its
    pieces; these two count only with ``side_bytes``.

    ``votings`` carries ``selection_strategy``; only a vote's first affair
    counts. A crawl holds at most 150 pages per vote, which bounds the lists
    nested here.
    """
    affair = first_per_key(affairs, ["voting_id"], [F.asc("position")])
    people = initiants(contributors).groupBy("voting_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "fullname", "party", "role"))).alias("__people")
    )
    doc_list = docs.select(
        "voting_id",
        F.struct(
            "position",
            *[tx.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("name", "url", "date", "language", "format")],
            _piece(F.coalesce("text", F.lit("")), doc_bytes).alias("text"),
        ).alias("d"),
    )
    doc_list = doc_list.groupBy("voting_id").agg(F.array_sort(F.collect_list("d")).alias("__docs"))
    text_list = texts.select(
        "voting_id",
        F.struct(
            lg.localized(F.col("type")).alias("kind"),
            "position",
            _piece(lg.localized(F.col("text")), text_bytes).alias("text"),
            clean_map(F.col("type")).alias("type_localized"),
            clean_map(F.col("text")).alias("text_localized"),
        ).alias("t"),
    )
    text_list = text_list.groupBy("voting_id").agg(F.collect_list("t").alias("__texts"))
    joined = votings
    for part in (
        affair.select("voting_id", F.struct(*[c for c in affair.columns if c not in ("voting_id", "position")]).alias("affair")),
        people,
        whole_arguments(docs, texts) if side_bytes is None else arguments(docs, texts, side_bytes, argument_doc_bytes, argument_text_bytes),
        doc_list,
        text_list,
        available_languages(votings, affair, docs, texts),
        locations(votings, bodies),
    ):
        joined = joined.join(part, "voting_id", "left")

    def optional(column: Column) -> Column:
        return F.nullif(column, F.lit(""))

    voting_fields = [c for c in votings.columns if c not in ("voting_id", "position", "selection_strategy")]
    shown = display_titles(F.col("affair_title"), F.col("affair.title"), F.col("title"))
    ordered_texts = F.array_sort(
        F.col("__texts"),
        lambda a, b: F.when(a["kind"] < b["kind"], -1)
        .when(a["kind"] > b["kind"], 1)
        .when(a["position"] < b["position"], -1)
        .otherwise(1),
    )
    document = F.struct(
        F.lit(fv.VOTE_SYSTEM).alias("source_system"),
        F.lit(fv.VOTE_ORG).alias("source_org"),
        dates.utc_text(as_of).alias("fetched_at_utc"),
        "selection_strategy",
        "available_languages",
        F.when(F.size(shown) > 0, shown).alias("display_title"),
        optional(F.col("canton")).alias("canton"),
        optional(F.col("commune_code")).alias("commune_code"),
        optional(F.col("commune_name")).alias("commune_name"),
        F.struct(*voting_fields).alias("voting"),
        "affair",
        F.coalesce(
            F.transform(
                "__people",
                lambda p: F.struct(p["fullname"].alias("fullname"), optional(p["party"]).alias("party"), optional(p["role"]).alias("role")),
            ),
            F.array().cast("array<struct<fullname:string,party:string,role:string>>"),
        ).alias("initiants"),
        F.create_map(
            F.lit("pro"),
            F.coalesce("pro", F.lit(fv.ARGUMENT_MISSING)),
            F.lit("contra"),
            F.coalesce("contra", F.lit(fv.ARGUMENT_MISSING)),
        ).alias("arguments"),
        F.transform(
            "__docs", lambda d: F.struct(*[optional(d[c]).alias(c) for c in ("name", "url", "date", "language", "format", "text")])
        ).alias("docs"),
        F.transform(
            ordered_texts,
            lambda t: F.struct(
                optional(t["kind"]).alias("type"), optional(t["text"]).alias("text"), t["type_localized"].alias("type_localized"), t["text_localized"].alias("text_localized")
            ),
        ).alias("texts"),
    )
    return joined.select("voting_id", F.to_json(document).alias("document"))
