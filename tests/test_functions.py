"""Scalar functions, ids and hashes."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import dates, ids, urls, vectors
from corpusmill.functions import fixed_values as fv
from corpusmill.functions import json_values as js
from corpusmill.functions import lang as lg
from corpusmill.functions import text as tx

X = F.col("x")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_white_space_is_the_unicode_property():
    assert set(fv.WHITE_SPACE) == {chr(c) for c in range(0x3001) if chr(c).isspace()} - set("\x1c\x1d\x1e\x1f")


@pytest.mark.parametrize("raw, count", [("a b c\td　e", 5), ("  ", 0), ("", 0), ("\x0bone\x85two ", 2)])
def test_words_split_on_unicode_space(value, raw, count):
    assert value(tx.word_count(X), row=(raw,)) == count
    assert value(tx.squeeze(X), row=(raw,)) == " ".join(raw.split())


@pytest.mark.parametrize("raw", ["abc", "Müri", "a€bc", "x𝄞y", "é" * 7, "\n€\n€\n"])
@pytest.mark.parametrize("limit", [3, 4, 5, 6])
def test_D13_byte_prefix_keeps_whole_characters(value, raw, limit):
    expected = raw.encode()[:limit].decode(errors="ignore")
    assert value(tx.byte_prefix(X, limit), row=(raw,)) == expected


def test_compact_marks_the_cut(value):
    assert value(tx.compact(X, 5), row=("a  b",)) == "a b"
    assert value(tx.compact(X, 6), row=("abcde fgh",)) == "abcde..."


def test_highlight_cuts_at_a_late_blank(value):
    words = " ".join(["word"] * 100)
    out = value(tx.highlight(X), row=(words,))
    assert out == " ".join(["word"] * 44) + "." and len(out) <= 221
    assert value(tx.highlight(X), row=("x" * 300,)) == "x" * 220 + "."
    assert value(tx.highlight(X), row=("Fertig!",)) == "Fertig!"
    # A blank too early in the text is not a place to cut.
    assert value(tx.highlight(X), row=("ab " + "y" * 300,)) == "ab " + "y" * 217 + "."


def test_redaction_and_cacheability(value):
    out = value(tx.sanitize_question(X), row=(" mail a.b@c.org, tel +41 79 123 45 67 ",))
    assert out == f"mail {fv.EMAIL_MARK}, tel {fv.PHONE_MARK}"
    assert value(tx.is_cacheable(X), row=(out,)) is False
    assert value(tx.is_cacheable(X), row=("plain",)) is True
    # A second address directly after the first is found too.
    assert value(tx.redact(X), row=("a@b.com_x@y.zz",)) == fv.EMAIL_MARK * 2


def test_question_is_cut_to_its_byte_limit(value):
    assert value(tx.sanitize_question(X, 1200), row=("é" * 1000,)) == "é" * 600


@pytest.mark.parametrize("chars, tokens", [(-1, 0), (0, 0), (1, 1), (4, 1), (5, 2)])
def test_token_estimate(value, chars, tokens):
    assert value(tx.token_estimate(X), "x int", (chars,)) == tokens


@pytest.mark.parametrize(
    "text, side",
    [("Begrundung", "pro"), ("ablehnung und refus", "contra"), ("pro und contra", "pro"), ("nichts", "unknown")],
)
def test_D21_argument_side(value, text, side):
    assert value(tx.argument_side(X), row=(text,)) == side


def test_names_and_slugs(value):
    assert value(tx.slug(X), row=(" A_b/c:d.e f ",)) == "a-b-c-d-e-f"
    assert value(tx.base_name(X), row=("/a/b.c/file.tar.gz",)) == "file.tar"
    assert value(tx.file_label(F.lit("link"), X), row=("https://h/v1/x_y",)) == "link"
    assert value(tx.file_label(F.lit(""), X), row=("https://h/v1/x_y.z/",)) == "v1-x-y-z"


def test_language_normalisers_differ(value):
    codes = {name: value(fn(X), row=(" EN-gb ",)) for name, fn in vars(lg).items() if name in
             ("normalize", "supported_or_empty", "request_language", "summary_language")}
    assert codes == {"normalize": "en-gb", "supported_or_empty": "", "request_language": "en-gb", "summary_language": "en"}
    assert value(lg.request_language(X), row=("english",)) == "fr"
    assert value(lg.normalize_or(X, "de"), row=("es",)) == "de"
    assert value(lg.from_location(X, F.lit("/it/a")), row=("http://h/x",)) == "it"


def test_D5_localized_takes_smallest_other_key(value):
    schema = "x map<string,string>"
    assert value(lg.localized(X), schema, ({"zz": "z", "aa": " a ", "de": " "},)) == "a"
    assert value(lg.localized(X), schema, ({"en": "e", "it": "i"},)) == "i"
    assert value(lg.localized(X), schema, ({},)) == ""


def test_D25_question_language_resolution():
    assert lg.resolve_question_language("de-CH") == "de"
    assert lg.resolve_question_language("", "en;q=0, es, it;q=0.1, de;q=0.9") == "it"
    assert lg.resolve_question_language(default="rm") == "rm"
    for body, header in (("??", ""), ("es", ""), ("", "es")):
        with pytest.raises(ValueError):
            lg.resolve_question_language(body, header)
    assert lg.parse_supported(" FR , de,x,fr") == ["fr", "de"]


def test_ids(value):
    assert value(ids.document_id(X, F.lit(" ")), row=(" My Sys ",)) == "my_sys:document"
    assert value(ids.chunk_id(X, F.lit(7)), row=("a:b c:fr",)) == "a_b_c_fr_chunk_0007"
    assert value(ids.person_id(X, F.lit("de la/Tour"), F.lit("")), row=("Jean",)) == "intv:jean_de_la_tour_"
    assert value(ids.path_id(X), row=("/a/b.json",)) == "_a_b_json"


def test_content_hash_and_fingerprint(value):
    assert value(ids.content_hash(F.lit("fr"), X, F.lit("a  b")), row=(" T ",)) == sha("fr|T|a b")
    assert value(ids.content_hash(F.lit("fr"), X, F.lit(" ")), row=(" ",)) == ""
    none = F.lit(None).cast("timestamp")
    moment = F.lit("2024-01-02T03:04:05Z").cast("timestamp")
    empty = F.lit("")
    assert value(ids.source_fingerprint(empty, empty, empty, none, none)) == ""
    assert value(ids.source_fingerprint(X, F.lit("e"), empty, none, moment), row=("s",)) == sha("s|e|||2024-01-02T03:04:05Z")
    assert value(ids.fingerprint_confidence(none, moment)) == "high"


def test_D24_translation_hash_trims_the_language(value):
    assert value(ids.translation_source_hash(X, F.lit(" t"), F.lit("c ")), row=(" fr ",)) == sha("fr|t|c")


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("2026-03-10T16:42:53", "2026-03-10T16:42:53Z"),
        (" 2026-03-10 ", "2026-03-10T00:00:00Z"),
        ("2026-03-10T16:42:53.5+02:00", "2026-03-10T14:42:53Z"),
        ("2026-02-31", None),
        ("10.3.2026", None),
        ("", None),
    ],
)
def test_parse_time(value, raw, expected):
    assert value(dates.utc_text(dates.parse_time(X)), row=(raw,)) == expected


def test_vote_time_refuses_naive_clock(value):
    assert value(dates.parse_vote_time(X), row=("2026-03-10T16:42:53",)) is None


def test_urls(value):
    assert value(urls.external_id(X, F.lit("/p/q.md")), row=("https://h/x?a=1&proposalId=a%20b",)) == "a b"
    assert value(urls.external_id(X, F.lit("/p/q.md")), row=("",)) == "_p_q_md"
    assert value(urls.canonical(X), row=(" https://h/x#top ",)) == "https://h/x"
    for url, allowed in [("https://API.openparldata.ch/v1", True), ("http://api.openparldata.ch/", False),
                         ("https://evil.ch/api.openparldata.ch", False), ("", False)]:
        assert value(urls.is_allowed_api(X), row=(url,)) is allowed


def test_hash_embedding_both_ways(spark):
    def component(i, text):
        return int.from_bytes(hashlib.sha256(f"{i}:{text}".encode()).digest()[:4], "big") / 4294967295 * 2 - 1

    df = spark.createDataFrame([("Müri",), ("b",)], "x string")
    rows = df.select("x", vectors.hash_embedding(X, 16).alias("a"), vectors.hash_embedding_batch(X, 16).alias("b")).collect()
    for row in rows:
        assert row.a == row.b
        assert row.a == pytest.approx([component(i, row.x) for i in range(16)], abs=1e-6)


def test_D11_cosine_guards(value):
    def pair(a, b):
        return value(vectors.cosine(F.col("a"), F.col("b")), "a array<float>, b array<float>", (a, b))

    assert pair([1.0, 0.0], [0.8, 0.6]) == pytest.approx(0.8, abs=1e-6)
    assert pair([0.0, 0.0], [1.0, 0.0]) == pair([1.0], [1.0, 0.0]) == pair([], []) == -1


def test_P18_json_scalars(value):
    doc = F.parse_json(X)
    text = '{"s":" a ","i":101357,"d":12.50,"e":1e3,"b":true,"n":null,"o":{},"l":[1]}'
    got = {k: value(js.scalar(doc, f"$.{k}"), row=(text,)) for k in "sidebnol"}
    assert got == {"s": "a", "i": "101357", "d": "12.5", "e": "1000", "b": "", "n": "", "o": "", "l": ""}


def test_usage_tokens(value):
    def parse(body):
        return tuple(value(js.usage_tokens(X), row=(body,)))

    assert parse('{"usage":{"prompt_tokens":3,"completion_tokens":"4"}}') == (3, 4, 7, "provider")
    assert parse('{"usage":{"input_tokens":5,"total_tokens":9}}') == (5, 0, 9, "provider")
    assert parse('{"usage":{}}') == parse("{}") == (0, 0, 0, "unknown")


def test_stable_json_numbers_and_escapes():
    assert js.stable_json({"b": [1.0, 1e21, 1e-7, 0.5, 123456789012345680.0], "a": "<&>é"}) == (
        '{"a":"\\u003c\\u0026\\u003eé","b":[1,1e+21,1e-7,0.5,123456789012345680]}'
    )


def test_P13_sensitive_keys_go_at_any_depth(value):
    doc = '{"a":{"Contact_name":1,"k":[{"E-mail":"x","my_email":"y","z":null}]},"n":null}'
    assert value(js.remove_sensitive(X), row=(doc,)) == '{"a":{"k":[{"E-mail":"x"}]}}'


def test_language_projection_prunes(value):
    doc = '{"t":{"fr":"F","de":" "},"e":{},"l":[{"x":{"de":"D"}},""],"n":7}'
    assert value(js.project_language(X, F.lit("fr")), row=(doc,)) == '{"n":7,"t":"F"}'
    assert value(js.project_language(X, F.lit("de")), row=(doc,)) == '{"l":[{"x":"D"}],"n":7}'
    assert value(js.project_language(X, F.lit("rm")), row=('{"t":{"fr":"F"}}',)) is None
    assert value(js.discover_languages(X), row=(doc,)) == ["fr", "de"]


def test_S15_child_links(value):
    doc = '{"meta":{"next_page":" n "},"data":[{"links":{"b":"u2","a":["u1","u2",""]}},{"LINKS":"u3"}],"other":"no"}'
    assert value(js.extract_links(X), row=(doc,)) == ["u1", "u2", "u3", "n"]
    assert value(js.extract_links(X), row=("not json",)) == []


def test_arguments_and_origin(value):
    meta = '{"arguments":{"pro":" ja ","contra":""},"selection_strategy":null}'
    assert value(js.argument_text(X), row=(meta,)) == "pro: ja"
    assert value(js.origin(X), row=(meta,)) == "dataset"
    assert value(js.origin(X), row=("{}",)) == ""
