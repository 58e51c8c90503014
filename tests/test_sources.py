"""Files, votes, fetching and crawling."""

import dataclasses
import email.utils
import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import dates
from corpusmill.functions import fixed_values as fv
from corpusmill.operators import votes
from corpusmill.plans import index_job
from corpusmill.sources import crawl as cr
from corpusmill.sources import fetch
from corpusmill.sources.files import front_matter, read_corpus, require_documents
from corpusmill.sources.html import page_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])
NOW = "2026-01-01T00:00:00Z"


def write(folder, files):
    for name, text in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text if isinstance(text, str) else json.dumps(text))


def vote(**change):
    base = {
        "source_system": "openparldata",
        "selection_strategy": "future",
        "voting": {
            "id": 7,
            "external_id": "x_1",
            "url_api": "https://api.example/v/7",
            "body_key": "GE",
            "date": "2026-03-10T16:42:53",
            "title": {"de": "Titel", "fr": "Titre"},
            "affair_title": {"de": "Geschaeftstitel"},
        },
        "affair": {"id": 12, "title": {"de": "A"}, "type_name": {"de": "Motion"}, "state_name": {}},
        "initiants": [{"fullname": "Anna Maria Meier", "role": "Urheber"}, {"fullname": "anna maria meier"}, {"fullname": "Solo"}],
    }
    base["voting"].update(change.pop("voting", {}))
    base.update(change)
    return base


def corpus(spark, folder, **kwargs):
    return read_corpus(spark, str(folder), dates.moment(NOW), **kwargs)


def test_S2_formats(spark, tmp_path):
    write(
        tmp_path,
        {
            "a.md": "# Titre\n\n- source_url: https://www.abstimmungen.admin.ch/x?proposalId=42\n- lang: de\n- Lang: it\n"
            "- intervenants: Jean Dupont; jean dupont; Solo\n\nCorps *du* [texte]\n# Pas un titre\n",
            "sub/de/b.txt": "plain words",
            "c.csv": "a,b\n1,2\n",
            "d.HTML": "<p>Hello <b>bold</b><!-- no --> end</p><script>var a;</script>",
            "e.bin": "x",
            "empty.md": "# only a title\n",
            "ckan.json": {"help": "h", "result": {"results": [{"id": "ds", "title": {"en": "E", "de": "D"}, "language": ["en", "de"],
                          "issued": "2020-01-01", "author": "A B, C", "owner_email": "x@y.z"}]}},
        },
    )
    rows = {r.title: r for r in corpus(spark, tmp_path).collect()}
    assert set(rows) == {"Titre", "b", "c", "d", "D"}
    md = rows["Titre"]
    assert (md.document_id, md.lang, md.content) == ("abstimmungen_admin:42", "it", "Corps du texte Pas un titre")
    assert [(p.first_name, p.last_name) for p in md.persons] == [("Jean", "Dupont")]
    assert rows["b"].lang == "de" and rows["c"].content == "a,b 1,2" and rows["c"].lang == "fr"
    assert rows["d"].content == "Hello bold end var a;"
    ds = rows["D"]
    assert (ds.document_id, ds.lang, ds.available_languages) == ("opendata_swiss:ds", "de", ["en", "de"])
    assert "x@y.z" not in ds.content and ds.issued_at.year == 2020


def test_S1_limits(spark, tmp_path):
    write(tmp_path, {"a.txt": "x" * 100})
    with pytest.raises(Exception, match="exceeds size limit"):
        corpus(spark, tmp_path, max_bytes=50).collect()
    (tmp_path / "a.txt").rename(tmp_path / "a.bin")
    with pytest.raises(ValueError, match="no supported files"):
        require_documents(corpus(spark, tmp_path))
    with pytest.raises(ValueError):
        corpus(spark, " ")


def test_S8_pdf_reader_hook(spark, tmp_path):
    write(tmp_path, {"a.pdf": "page one\n page two"})
    with pytest.raises(RuntimeError, match="no PDF reader"):
        corpus(spark, tmp_path)
    row = corpus(spark, tmp_path, pdf_reader=lambda raw: raw.decode().upper()).first()
    assert (row.content, row.content_type) == ("PAGE ONE PAGE TWO", "application/pdf")


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("# T\n- a: 1\n\n- b:2\nbody\n- c: 3", ("T", [("a", "1"), ("b", "2")], "body\n- c: 3")),
        ("\n\n- k: v", ("", [("k", "v")], "")),
        ("- no colon here\nx", ("", [], "- no colon here\nx")),
        ("#T\nx", ("", [], "#T\nx")),
        ("# A\n# B\nx", ("A", [], "# B\nx")),
    ],
)
def test_S4_front_matter(value, raw, expected):
    out = value(front_matter(F.col("x")), row=(raw,))
    assert (out.title, [(e.key, e.value) for e in out.entries], out.body) == expected


def test_S7_html_nodes():
    assert page_text("<title>A &amp; B</title>x<br>y <!-- c --> z") == "A & B x y z"
    assert page_text("<p>a</p><script>b</script><style>c</style>d", strip_scripts=True) == "a d"


def test_C16_places(spark, tmp_path):
    cases = [
        ({}, "cantonal", "GE", None),
        ({"voting": {"body_key": "ZH", "municipality_code": "261"}}, "communal", "ZH", "261"),
        ({"voting": {"body_key": "351"}}, "communal", None, "351"),
        ({"voting": {"body_key": "351"}, "canton": "be"}, "communal", "BE", "351"),
        ({"voting": {"body_key": "CH"}}, "federal", None, None),
        ({"voting": {"body_key": "ZH"}, "gemeinde": "Uster"}, "communal", "ZH", None),
    ]
    for number, (change, *_) in enumerate(cases):
        write(tmp_path, {f"v{number}.json": vote(**change)})
    metas = {r.source_path[-7:-5]: json.loads(r.metadata) for r in corpus(spark, tmp_path).collect()}
    for number, (_, *expected) in enumerate(cases):
        meta = metas[f"v{number}"]
        assert [meta["level"], meta.get("canton"), meta.get("commune_code")] == expected
    assert metas["v5"]["commune_name"] == "Uster"


def test_S10_S23_vote_rows(spark, tmp_path):
    write(tmp_path, {"v.json": vote(), "w.json": vote(voting={"external_id": "w"}, available_languages=["de", "xx"])})
    rows = {(r.external_id, r.lang): r for r in corpus(spark, tmp_path).collect()}
    assert set(rows) == {("x_1", "de"), ("x_1", "fr"), ("w", "de")}
    row = rows["x_1", "fr"]
    meta = json.loads(row.metadata)
    assert row.title == meta["display_title"] == "Geschaeftstitel"
    assert (meta["votation_id"], meta["object_id"], meta["object_type"], meta["status"]) == ("x_1", "12", "Motion", "upcoming")
    assert [(p.first_name, p.last_name, p.role) for p in row.persons] == [("Anna", "Maria Meier", "Urheber")]
    body = json.loads(row.content)
    assert body["voting"]["title"] == "Titre" and "title" not in body["affair"]


def test_index_twice_skips_all(spark, tmp_path):
    write(tmp_path / "in", {"v.json": vote(), "a.txt": "some words here"})
    store = index_job.Store(spark, str(tmp_path / "store"), buckets=2)
    docs, now = corpus(spark, tmp_path / "in"), dates.moment(NOW)
    first = index_job.run_index(docs, store, now)
    assert (first.documents, first.processed, first.chunks) == (2, 2, 3)
    second = index_job.run_index(docs, store, now)
    assert (second.skipped, second.processed) == (2, 0)
    write(tmp_path / "in", {"a.txt": "other words"})
    third = index_job.run_index(corpus(spark, tmp_path / "in"), store, now)
    assert (third.skipped, third.processed) == (1, 1)
    assert store.read("rag_chunks").count() == 3
    texts = {r.content for r in store.read("rag_chunks").filter("doc_id like 'local%'").collect()}
    assert texts == {"other words"}
    assert store.read("document_intervenants").count() == 1
    found = index_job.search_chunks(store).filter("lang = 'fr' and document_id like 'openparl%'").first()
    assert found.persons[0].last_name == "Maria Meier" and found.source_system == "openparldata"


class Reverse:
    name = "reverse"

    def translate(self, text, source, target, label):
        return f"{target} {text[::-1]}"


def test_D7_D8_model_mode_translates_then_skips(spark, tmp_path):
    write(tmp_path / "in", {"de/a.txt": "some words here"})
    store = index_job.Store(spark, str(tmp_path / "store"), buckets=1)
    docs, now = corpus(spark, tmp_path / "in"), dates.moment(NOW)
    settings = index_job.IndexSettings(mode="llm")
    first = index_job.run_index(docs, store, now, settings, translator=Reverse())
    assert (first.processed, first.chunks) == (1, 5)
    rows = {r.lang: r for r in store.read("document_translations").collect()}
    assert rows["fr"].content_normalized == "fr ereh sdrow emos" and rows["de"].content_normalized == "some words here"
    assert store.read("index_document_metrics").first().translations_succeeded == 4
    assert index_job.run_index(docs, store, now, settings, translator=Reverse()).skipped == 1


# --- fetch -------------------------------------------------------------------


class Clock:
    def __init__(self):
        self.now, self.slept = 1000.0, []

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds


def test_S21_retry_and_gate():
    clock, answers = Clock(), [(503, {}, b""), (429, {"Retry-After": "99"}, b""), (200, {"Content-Type": "json"}, b"ok")]
    settings = fetch.FetchSettings(min_interval=1.0, backoff_max=30.0)
    fetcher = fetch.PoliteFetcher(lambda url: answers.pop(0), settings, clock, clock.sleep)
    assert fetcher.fetch("u") == ("json", b"ok")
    assert clock.slept == [1.0, 30.0]
    answers.append((200, {}, b"x"))
    fetcher.fetch("u")
    assert 1.1 <= clock.slept[-1] <= 1.25
    capped = dataclasses.replace(settings, max_bytes=fv.FETCH_MAX_BYTES)
    for answer, error in [((404, {}, b""), fetch.HttpStatus), ((200, {}, b"x" * 2_000_000), ValueError)]:
        with pytest.raises(error):
            fetch.PoliteFetcher(lambda url, a=answer: a, capped, clock, clock.sleep).fetch("u")
    assert len(fetch.PoliteFetcher(lambda url: (200, {}, b"x" * 2_000_000), settings, clock, clock.sleep).fetch("u")[1]) == 2_000_000  # no limit by default
    assert fetch.retry_after_seconds(email.utils.formatdate(1060, usegmt=True), 1000.0) == 60
    assert fetch.retry_after_seconds("soon", 0) == 0


def test_S12_cache(spark):
    def transport(url):
        return 200, {"content-type": "json"}, f"new {url}".encode()

    wanted = spark.createDataFrame([("https://h/a#x",), ("https://h/a",), ("https://h/b",), ("https://h/c",)], "url string")
    rows = [("https://h/a", b"old", True, "2025-12-31"), ("https://h/b", b"old", True, "2025-12-01"), ("https://h/c", b"bad", False, "2025-12-31")]
    held = spark.createDataFrame(rows, "url string, body binary, intact boolean, day string")
    cache = held.select(
        fetch.cache_key(F.col("url")).alias("cache_key"),
        "url",
        F.lit("json").alias("content_type"),
        "body",
        F.when(F.col("intact"), F.sha2("body", 256)).otherwise("x").alias("sha256"),
        F.col("day").cast("timestamp").alias("fetched_at"),
    )
    settings = fetch.FetchSettings(min_interval=0)
    pages, new = fetch.fetch_missing(wanted, cache, transport, dates.moment(NOW), settings)
    got = {r.url: bytes(r.body) for r in pages.collect()}
    assert got == {"https://h/a": b"old", "https://h/b": b"new https://h/b", "https://h/c": b"new https://h/c"}
    assert new.count() == 2 and fetch.retained(cache, dates.moment(NOW)).count() == 2
    forced, _ = fetch.fetch_missing(wanted, cache, transport, dates.moment(NOW), settings, force=True)
    assert all(bytes(r.body).startswith(b"new") for r in forced.collect())


# --- crawl -------------------------------------------------------------------

API = "https://api.openparldata.ch/v1/"


def graph_brute(graph, seeds, max_depth, max_nodes):
    out = {}
    for voting, start in seeds.items():
        queue, seen = [(u, 0) for u in start], []
        while queue:
            url, depth = queue.pop(0)
            if depth > max_depth or url in seen or not url.startswith(API):
                continue
            if len(seen) >= max_nodes:
                break
            seen.append(url)
            out[voting, url] = depth
            queue += [(child, depth + 1) for child in graph[url]]
    return out


@pytest.mark.parametrize("max_nodes", [3, 5, 150])
def test_S14_crawl_is_breadth_first(spark, max_nodes):
    graph = {API + k: [API + c if c != "out" else "https://other/x" for c in v.split()] for k, v in
             {"a": "b c out", "b": "d a", "c": "e d", "d": "f", "e": "", "f": "g", "g": ""}.items()}
    pages = spark.createDataFrame([(u, json.dumps({"links": c})) for u, c in graph.items()], "url string, body string")
    seeds = spark.createDataFrame(
        [(1, 0, "voting", API + "a"), (1, 1, "x", API + "e"), (2, 0, "voting", API + "d")],
        "voting_id int, position int, name string, url string",
    )
    got = {(r.voting_id, r.url): r.depth for r in cr.crawl(seeds, cr.from_table(pages), 3, max_nodes).collect()}
    assert got == graph_brute(graph, {1: [API + "a", API + "e"], 2: [API + "d"]}, 3, max_nodes)


def test_S14_missing_page(spark):
    seeds = spark.createDataFrame([(1, 0, "v", API + "a")], "voting_id int, position int, name string, url string")
    nothing = spark.createDataFrame([], "url string, body string")
    with pytest.raises(Exception, match="page not available"):
        cr.crawl(seeds, cr.from_table(nothing))
    assert cr.crawl(seeds, cr.from_table(nothing), on_missing="skip").count() == 0


def test_C18_vote_document_is_read_back(spark, tmp_path):
    def rows(items, element):
        page = spark.createDataFrame([(1, json.dumps({"data": items}))], "voting_id int, body string")
        return votes.page_rows(page, element)

    voting = {"id": 1, "body_key": "AG", "external_id": "6_1", "date": "2026-03-10T16:42:53", "title": {"de": "T"}, "links": {"affairs": ""}}
    votings = rows([voting], schemas.VOTING).withColumn("selection_strategy", F.lit("future"))
    seeds = {r.name: r.url for r in votes.seed_urls(votings).collect()}
    assert seeds == {"affairs-fallback": API + "votings/1/affairs"}
    affairs = rows([{"id": 5, "title": {"de": "Geschaeft"}, "type_name": {"de": "Motion"}}, {"id": 6}], schemas.AFFAIR)
    wanted = {r.kind: r.url for r in votes.required_urls(affairs.filter("id = 5")).collect()}
    assert wanted["docs"] == API + "affairs/5/docs"
    people = rows([{"type": "person", "firstname": "A", "lastname": "B", "role": {"de": "Urheber"}}, {"type": "Person", "fullname": "C D"}], schemas.CONTRIBUTOR)
    docs = rows([{"name": " D ", "text": "Wir sind dafur  sehr", "language": "DE"}], schemas.DOC)
    texts = rows([{"type": {"de": "z"}, "text": {"de": "spaet"}}, {"type": {"de": "b"}, "text": {"de": "frueh", "it": " "}}], schemas.TEXT)
    bodies = rows([{"body_key": "AG", "canton_key": "ag", "name": {"de": "Aargau"}}], schemas.BODY).withColumn("url", F.lit("u/bodies"))
    made = votes.vote_documents(votings, affairs, people, docs, texts, bodies, dates.moment(NOW)).first()
    out = json.loads(made.document)
    assert out["available_languages"] == ["de"] and out["canton"] == "AG" and "commune_code" not in out
    assert out["initiants"] == [{"fullname": "A B", "role": "Urheber"}]
    assert out["arguments"] == {"pro": "Wir sind dafur sehr", "contra": "frueh"}
    assert [t["text"] for t in out["texts"]] == ["frueh", "spaet"] and out["docs"][0]["name"] == "D"
    write(tmp_path, {"v.json": made.document})
    row = corpus(spark, tmp_path).first()
    assert (row.document_id, row.title, row.lang) == ("openparldata:6_1", "Geschaeft", "de")


def test_C18_vote_document_is_whole_by_default(spark):
    def rows(items, element):
        return votes.page_rows(spark.createDataFrame([(1, json.dumps({"data": items}))], "voting_id int, body string"), element)

    voting = {"id": 1, "body_key": "AG", "date": "2026-03-10T16:42:53", "title": {"de": "T"}, "links": {"affairs": ""}}
    votings = rows([voting], schemas.VOTING).withColumn("selection_strategy", F.lit("future"))
    late, free = "wort " * 1000 + "dagegen", "satz " * 1000 + "ende"
    docs = rows([{"name": "D", "text": late, "language": "de"}, {"name": "E", "text": "dafur", "language": "de"}], schemas.DOC)
    texts = rows([{"type": {"de": "z"}, "text": {"de": free}}], schemas.TEXT)
    parts = (rows([{"id": 5}], schemas.AFFAIR), rows([], schemas.CONTRIBUTOR), docs, texts, rows([], schemas.BODY).withColumn("url", F.lit("u")))
    out = json.loads(votes.vote_documents(votings, *parts, dates.moment(NOW)).first().document)
    assert out["arguments"] == {"pro": "dafur", "contra": late}
    assert [d["text"] for d in out["docs"]] == [late, "dafur"] and out["texts"][0]["text"] == free
    limits = {"doc_bytes": 4000, "text_bytes": 2000, "side_bytes": 2400, "argument_doc_bytes": 1800, "argument_text_bytes": 1200}
    cut = json.loads(votes.vote_documents(votings, *parts, dates.moment(NOW), **limits).first().document)
    assert len(cut["docs"][0]["text"]) < 4010 and len(cut["texts"][0]["text"]) < 2010 and len(cut["arguments"]["contra"]) < 2410


def test_no_limits_by_default(spark):
    listed = spark.createDataFrame([(i, i, f"2026-03-{i + 10}T00:00:00Z") for i in range(9)], "id int, position int, date string")
    assert votes.select_votings(listed, dates.moment("2026-01-01T00:00:00Z")).count() == 9
    past = votes.select_votings(listed, dates.moment("2027-01-01T00:00:00Z")).collect()
    assert len(past) == 9 and {r.selection_strategy for r in past} == {"fallback_past"}
    assert votes.select_votings(listed, dates.moment("2026-03-16T12:00:00Z")).count() == 2
    fetcher = fetch.PoliteFetcher(lambda url: (200, {}, b"x" * 2_000_000), fetch.FetchSettings(min_interval=0))
    assert len(fetcher.fetch("u")[1]) == 2_000_000


def test_S2_branches_read_their_own_files_only(spark, tmp_path):
    from corpusmill.sources.files import list_files

    for name in ("a.MD", "b.json", "c.Html", "d.htm", "e.bin", "md"):
        (tmp_path / name).write_text(name)
    names = lambda *e: sorted(r.source_path.rsplit("/", 1)[1] for r in list_files(spark, str(tmp_path), *e).collect())
    assert names(".md", ".txt") == ["a.MD"] and names(".html", ".htm") == ["c.Html", "d.htm"] and names(".csv") == []
    assert all(f.endswith((".Html", ".htm")) for f in list_files(spark, str(tmp_path), ".html", ".htm").inputFiles())
