"""The engine's model as views over the given star-schema tables.

* ``documents``/``labels``  -> corpus documents and their stored index state
* ``orders``/``customer``   -> catalogue documents of votations and objects
* ``lineitem``              -> writes of document translations (with repeats)
* ``events``                -> model-usage events
* ``conversations``         -> questions
* ``embeddings``            -> stored vectors

Only expressions, so filters and column pruning still reach the scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import dates, ids
from corpusmill.functions import lang as lg
from corpusmill.functions import text as tx
from corpusmill.operators import skip, snapshot
from corpusmill.operators.chunking import ChunkPlan, chunk_documents, expected_chunks
from corpusmill.operators.embedding import HashEmbedder
from corpusmill.sources.tables import table

AS_OF = "2000-01-01T00:00:00Z"
WRITE_LANGUAGES = ["fr", "de", "it", "rm", "en", "es", "pt"]


def as_of() -> Column:
    return dates.moment(AS_OF)


def _text(column: str) -> Column:
    return F.col(column).cast("string")


def corpus_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    key = _text("doc_id")
    modified = F.when(
        F.col("lang") == "fr", F.timestamp_add("MINUTE", F.col("n_chars").cast("int"), F.lit("2024-01-01").cast("timestamp"))
    )
    return docs.select(
        "doc_id",
        ids.document_id(F.col("source"), key).alias("document_id"),
        "lang",
        F.concat(F.lit("Document "), key).alias("title"),
        F.col("text").alias("content"),
        F.concat(F.lit("/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), key, F.lit(".txt")).alias("source_path"),
        F.col("source").alias("source_system"),
        key.alias("external_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), key).alias("source_uri"),
        F.lit(None).cast("timestamp").alias("issued_at"),
        modified.alias("modified_at"),
    ).withColumn("translation_id", ids.translation_id(F.col("document_id"), lg.supported_or_empty(F.col("lang"))))


def corpus_chunks(spark: SparkSession, sf: str, plan: ChunkPlan = ChunkPlan()) -> DataFrame:
    docs = corpus_documents(spark, sf)
    keep = ["document_id", "translation_id", "lang", "title", "source_path", "source_system", "source_uri", "content"]
    return chunk_documents(docs.select(*keep), plan)


def embedded_chunks(spark: SparkSession, sf: str) -> DataFrame:
    persons = F.array().cast("array<struct<first_name:string,last_name:string,role:string>>")
    return corpus_chunks(spark, sf).withColumns(
        {"embedding": HashEmbedder().embed(F.col("content")), "persons": persons}
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").filter("role = 'user'")
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        F.col("text").alias("question"),
        F.when(F.col("turn") == 0, "de").otherwise("en-gb").alias("language"),
    )


def stored_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding", "label")


def index_state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """State as stored for the labelled documents; some of it is stale."""
    labelled = corpus_documents(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    facts = skip.with_index_metadata(labelled)
    state = facts.select(
        "document_id",
        "source_fingerprint",
        "fingerprint_confidence",
        (F.col("quality") == 1).alias("index_complete"),
        expected_chunks(tx.word_count(F.col("content"))).alias("indexed_chunk_count"),
    )
    translations = facts.select(
        "document_id",
        "lang",
        "title",
        "content",
        F.when(F.col("lang") == "es", "pending").otherwise("ready").alias("status"),
        F.lit("source").alias("provider"),
        ids.translation_source_hash(F.col("lang"), F.col("title"), F.col("content")).alias("source_hash"),
        F.when(F.col("toxic") == 1, "stale").otherwise(F.col("content_hash")).alias("content_hash"),
    )
    return state, translations


# --- catalogue ---------------------------------------------------------------


def catalog_documents(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    votation = F.concat(F.lit("v"), _text("o_custkey"))
    priority = F.substring("o_orderpriority", 1, 1)
    vote_date = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderdate").cast("timestamp"))
    arguments = F.concat(F.lit('{"arguments":{"pro":" for '), priority, F.lit(' ","contra":"against"}'))
    return joined.select(
        F.concat(F.lit("orders:"), _text("o_orderkey")).alias("id"),
        F.lit("orders").alias("source_system"),
        F.concat(F.lit("https://www."), F.lower("o_orderstatus"), F.lit(".admin.ch/"), _text("o_custkey")).alias("source_uri"),
        _text("o_orderkey").alias("external_id"),
        votation.alias("votation_id"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.concat(F.lit("Obj/"), _text("o_custkey"), F.lit("."), priority)).alias("object_id"),
        F.when(F.col("o_orderstatus") == "F", "federal").when(F.col("o_orderstatus") == "O", "cantonal").otherwise("communal").alias("level"),
        F.concat(F.lit("N"), F.char(F.col("c_nationkey") + 65)).alias("canton"),
        F.when(F.col("o_orderstatus") == "P", _text("c_nationkey")).otherwise("").alias("commune_code"),
        F.lit("").alias("commune_name"),
        F.coalesce(dates.vote_status(vote_date, as_of()), F.lit("past")).alias("status"),
        F.substring("o_orderpriority", 3, 20).alias("object_type"),
        F.col("c_mktsegment").alias("object_theme"),
        vote_date.alias("vote_date"),
        F.col("c_name").alias("source_org"),
        F.when(F.col("o_orderstatus") == "F", F.concat(arguments, F.lit(',"selection_strategy":"future"}')))
        .otherwise(F.concat(arguments, F.lit("}")))
        .alias("source_metadata"),
    )


def translation_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Every write of a (document, language); the newest one is current."""
    items = table(spark, sf, "lineitem")
    code = F.element_at(F.array(*[F.lit(c) for c in WRITE_LANGUAGES]), F.col("l_linenumber"))
    part = _text("l_partkey")
    shown = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Shown "), part)).otherwise("")
    state = F.when(F.col("l_linestatus") == "F", "ready").otherwise("pending")
    return items.select(
        F.concat(F.lit("orders:"), _text("l_orderkey")).alias("document_id"),
        code.alias("lang"),
        F.concat(F.lit("Title "), part).alias("title"),
        F.concat(F.lit("Text of "), part, F.lit(" by "), _text("l_suppkey")).alias("content_normalized"),
        F.concat(F.lit('{"display_title":"'), shown, F.lit('","translation_status":"'), state, F.lit('"}')).alias("metadata"),
        F.col("l_shipdate").alias("written_at"),
        F.col("l_partkey").alias("sequence"),
        F.col("l_suppkey").alias("writer"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("line"),
    )


NEWEST_WRITE = [F.desc, F.desc, F.desc, F.asc, F.asc]
WRITE_ORDER = ["written_at", "sequence", "writer", "flag", "line"]


def write_order() -> list[Column]:
    return [direction(name) for direction, name in zip(NEWEST_WRITE, WRITE_ORDER)]


def catalog_translations(spark: SparkSession, sf: str) -> DataFrame:
    newest = snapshot.latest(translation_writes(spark, sf), ["document_id", "lang"], write_order())
    return newest.drop(*WRITE_ORDER)


# --- usage -------------------------------------------------------------------


def usage_from(events: DataFrame) -> DataFrame:
    """Works for a batch and for a stream of the events table."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("evt_"), F.lpad(_text("event_id"), 12, "0")).alias("event_id"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.when(kind.isin("view", "click"), "qa_query").when(kind == "signup", "").otherwise(" rag_index ").alias("flow"),
        F.when(kind == "click", "summarization").when(kind.isin("error", "purchase"), "translation").otherwise("embedding").alias("operation"),
        F.when(k < 50, "local").otherwise("llm").alias("mode"),
        F.when(k < 10, "").otherwise("model-x").alias("provider_name"),
        F.concat(F.lit("m"), F.substring(k.cast("string"), 1, 1)).alias("model_name"),
        F.lit("").alias("run_id"),
        F.lit("").alias("request_id"),
        F.concat(F.lit("doc-"), _text("user_id")).alias("document_id"),
        F.lit("en").alias("source_lang"),
        F.when(k < 30, "fr").when(k < 60, "de").when(k < 80, " en ").otherwise("it").alias("target_lang"),
        (k * 4 - 40).alias("input_chars"),
        (k * 2).alias("output_chars"),
        k.alias("input_tokens"),
        F.floor(k / 2).alias("output_tokens"),
        F.when(k < 20, 0).otherwise(k * 2).alias("total_tokens"),
        F.lit("provider").alias("usage_source"),
        F.when(kind == "error", "error").otherwise("").alias("status"),
        F.round(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.lit("").alias("error_code"),
    )


def usage_events(spark: SparkSession, sf: str) -> DataFrame:
    from corpusmill.operators import usage

    scoped = usage.apply_scope(usage_from(table(spark, sf, "events")), flow="rag_index")
    return usage.normalize_events(scoped, as_of()).filter("valid").drop("valid")


# --- crawl payloads ----------------------------------------------------------


def votings(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    key, empty = _text("o_orderkey"), F.lit("")
    naive_day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return orders.select(
        F.col("o_orderkey").alias("voting_id"),
        F.col("o_orderkey").alias("position"),
        naive_day.alias("date"),
        F.create_map(F.lit("de"), F.concat(F.lit(" Abstimmung "), key), F.lit("en"), empty).alias("title"),
        F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("fr"), F.concat(F.lit("Affaire "), key)))
        .otherwise(F.create_map(F.lit("fr"), empty))
        .alias("affair_title"),
    )


def affairs(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    low = F.col("o_orderpriority") == "5-LOW"
    return orders.select(
        F.col("o_orderkey").alias("voting_id"),
        F.when(low, F.create_map(F.lit("it"), F.col("o_orderpriority"))).otherwise(F.create_map(F.lit("xx"), F.lit("?"))).alias("title"),
        F.create_map(F.lit("rm"), F.when(F.col("o_orderstatus") == "O", "lung").otherwise(" ")).alias("title_long"),
    ).withColumns({"type_name": F.col("title"), "state_name": F.col("title")})


def contributors(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    role = F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "Motionnaire principal").otherwise("Membre")
    return items.select(
        F.col("l_orderkey").alias("voting_id"),
        (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")).alias("position"),
        F.when(F.col("l_returnflag") == "A", " Person").otherwise("body").alias("type"),
        F.lit("Anna").alias("firstname"),
        F.concat(F.lit("Nr"), _text("l_suppkey")).alias("lastname"),
        F.when(F.col("l_linenumber") < 4, F.concat(F.lit("Full "), _text("l_suppkey"))).otherwise("").alias("fullname"),
        F.create_map(F.lit("fr"), role).alias("role"),
        F.create_map(F.lit("fr"), F.lit(" ")).alias("role_harmonized"),
        F.create_map(F.lit("zz"), F.lit("P2"), F.lit("aa"), F.lit("P1")).alias("party"),
    )


def vote_docs(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select(F.col("source").alias("voting_id"), F.col("doc_id").alias("position"), "text", F.col("lang").alias("language"))


def vote_texts(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "benchmark")
    return items.select(
        F.concat(F.lit("src"), _text("item_id")).alias("voting_id"),
        F.col("item_id").alias("position"),
        F.create_map(F.lit("de"), F.col("text")).alias("text"),
    )


def body_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Customers as votings of their nation, a region's nations as its bodies."""
    nations = table(spark, sf, "nation")
    people = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    target = F.when(F.col("c_mktsegment") == "BUILDING", "none").otherwise(_text("c_nationkey"))
    votes = people.select(F.col("c_custkey").alias("voting_id"), target.alias("body_key"), "n_regionkey")
    listed = nations.select(
        F.col("n_regionkey").alias("region"),
        F.col("n_nationkey").alias("position"),
        _text("n_nationkey").alias("body_key"),
        F.when(F.col("n_nationkey") > 12, F.concat(F.lit("n"), F.char(F.col("n_nationkey") + 97))).otherwise("").alias("canton_key"),
        F.create_map(F.lit("it"), F.when(F.col("n_nationkey") > 5, F.col("n_name")).otherwise("")).alias("name"),
    )
    bodies = votes.select("voting_id", "n_regionkey").join(listed, F.col("n_regionkey") == F.col("region"))
    url = F.concat(F.lit("https://x/"), F.when(F.col("region") < 3, "bodies/").otherwise("v/"), _text("region"))
    return votes, bodies.withColumn("url", url).drop("n_regionkey", "region")


_API = "https://api.openparldata.ch/v1/"


def link_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Seeds and pages of a link graph: customer, its orders, nation, region."""
    orders = table(spark, sf, "orders")
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, sf, "nation")

    def url(kind: str, column: str) -> Column:
        return F.concat(F.lit(f"{_API}{kind}/"), _text(column))

    links = orders.groupBy("o_custkey").agg(F.collect_list(url("o", "o_orderkey")).alias("orders"))
    roots = people.join(links, F.col("c_custkey") == F.col("o_custkey"), "left")
    elsewhere = F.lit("https://elsewhere.example/x")
    pages = [
        roots.select(
            url("c", "c_custkey").alias("url"),
            F.to_json(F.struct(F.struct("orders", elsewhere.alias("other")).alias("Links"))).alias("body"),
        ),
        orders.join(people, F.col("o_custkey") == F.col("c_custkey")).select(
            url("o", "o_orderkey").alias("url"),
            F.to_json(F.struct(F.array(F.struct(F.struct(url("n", "c_nationkey").alias("nation")).alias("links"))).alias("data"))).alias("body"),
        ),
        nations.select(
            url("n", "n_nationkey").alias("url"),
            F.to_json(F.struct(F.struct(url("r", "n_regionkey").alias("next_page")).alias("meta"))).alias("body"),
        ),
        table(spark, sf, "region").select(url("r", "r_regionkey").alias("url"), F.lit("{}").alias("body")),
    ]
    every = pages[0]
    for more in pages[1:]:
        every = every.unionByName(more)
    seeds = people.select(F.col("c_custkey").alias("voting_id"), F.lit(0).alias("position"), F.lit("").alias("name"), url("c", "c_custkey").alias("url"))
    return seeds, every


# --- JSON files --------------------------------------------------------------


def spread(df: DataFrame) -> DataFrame:
    """Narrow rows of few file splits dealt to more tasks, for work that costs far
    more a row than reading it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * max(cores, df.rdd.getNumPartitions()))


def vote_files(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as normalised votes. Federal ones declare their languages, one of
    them unknown; the others are discovered from their language maps, one of
    which is blank for communal ones; those of low priority have no affair."""
    key, state = _text("o_orderkey"), F.col("o_orderstatus")

    def said(**texts: Column) -> Column:
        return F.create_map(*[part for code, text in texts.items() for part in (F.lit(code), text)])

    voting = F.struct(
        F.concat(F.lit("v"), key).alias("external_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.when(state == "F", "CH").when(state == "O", "ZH").otherwise(F.pmod("o_custkey", F.lit(25)).cast("string")).alias("body_key"),
        said(
            de=F.concat(F.lit("Vorlage "), key), it=F.when(state == "P", " ").otherwise(F.concat(F.lit("Oggetto "), key))
        ).alias("title"),
    )
    affair = F.struct(
        F.col("o_orderkey").alias("id"),
        said(de=F.concat(F.lit("Geschaeft "), key)).alias("title"),
        said(fr=F.substring("o_orderpriority", 3, 20)).alias("type_name"),
    )
    author = F.struct(F.concat(F.lit("Anna Nr"), F.col("o_custkey")).alias("fullname"), F.lit("Urheber").alias("role"))
    body = F.struct(
        F.lit("openparldata").alias("source_system"),
        F.when(state == "F", F.array(F.lit("de"), F.lit("fr"), F.lit("xx"))).alias("available_languages"),
        F.when(state == "P", "be").alias("canton"),
        voting.alias("voting"),
        F.when(F.col("o_orderpriority") != "5-LOW", affair).alias("affair"),
        F.array(author).alias("initiants"),
    )
    path = F.concat(F.lit("votes/"), key, F.lit(".json"))
    return spread(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")).select(path.alias("source_path"), F.to_json(body.alias("b")).alias("raw"))


def dataset_files(spark: SparkSession, sf: str) -> DataFrame:
    """French documents as dataset listings, the others as plain objects."""
    docs, key = table(spark, sf, "documents"), _text("doc_id")
    found = F.struct(
        F.concat(F.lit("ds-"), key).alias("id"),
        F.create_map(F.lit("it"), F.concat(F.lit("Dati "), key), F.lit("de"), F.concat(F.lit("Daten "), key)).alias("title"),
        F.array(F.lit("it"), F.lit("xx"), F.col("lang")).alias("language"),
        F.struct(F.create_map(F.lit("fr"), F.col("source")).alias("display_name")).alias("organization"),
        F.lit("cc-by").alias("license_id"),
        F.concat(F.lit("https://data.example.org/"), key).alias("url"),
        F.lit("2024-02-03T04:05:06").alias("issued"),
        F.lit("Anna Meier, Bo Li Ost,Solo").alias("author"),
        F.lit("a@b.ch").alias("author_email"),
        F.col("text").alias("notes"),
    )
    listing = F.struct(F.struct(F.lit(1).alias("count"), F.array(found).alias("results")).alias("result"))
    plain = F.struct("text", F.struct(F.lit("x").alias("contact_name"), F.lit(1.5).alias("share")).alias("more"))
    raw = F.when(F.col("lang") == "fr", F.to_json(listing)).otherwise(F.to_json(plain))
    return docs.select(F.concat(F.lit("sets/"), key, F.lit(".json")).alias("source_path"), raw.alias("raw"))
