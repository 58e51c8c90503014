"""Wrappers, preference pairs, suffix order and the pipeline."""

from __future__ import annotations

import json
import random

import numpy as np

import corpus_pipeline
from corpusmill.llm import html_wrappers, preferences
from corpusmill.llm.lyndon import suffix_order


def page(body: str, title: str = "T") -> str:
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><script>var a = '<p>no</p>';</script><style>p{{}}</style></head><body>"
        f"<header class='site'><h1>Site name</h1></header><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li></ul></nav>"
        f"<div class='cookie-notice'>We use cookies</div>{body}<aside><p>Related things to read</p></aside>"
        f"<form><p>Subscribe now</p><input></form><div id='comments'><p>Nice post, really</p></div><footer>(c) 2020</footer></body></html>"
    )


def test_wrapper_finds_the_article(spark):
    rows = [(i, "https://a.example/x", page(f"<article><h1>Title {i}</h1><p>First &amp; {i} <b>bold</b>\n text<br>line</p><p>Second {i}</p><p class=share>Share this</p></article>")) for i in range(5)]
    rows += [(9, None, page("<article><p>Lone</p></article>")), (10, "https://b.example", page("<div class='content'><h2>Head</h2><p>Long text of the page without an article element</p><p>More<p>And more</div>"))]
    rows += [(11, "x", None), (12, "https://b.example", ""), (13, "https://c.example", "<p>cut off <b>here & the"), (14, "https://c.example", "<<<>>> < a"), (0, "https://a.example/x", rows[0][2])]
    df = spark.createDataFrame([(*r, "row", "host") for r in rows], "page_id long, url string, html string, row string, host string")
    got = {r.page_id: r.text for r in html_wrappers.report(df).collect()}
    assert html_wrappers.report(df).count() == len(rows)
    classed = page("<article class='post has-sidebar'><div class='entry-header'><h1>T</h1><p>By me</p></div><p>Body text</p></article><article class='comment'><p>No</p></article>")
    one = html_wrappers.report(spark.createDataFrame([(1, "https://d.example", classed)], "page_id long, url string, html string")).first()
    assert (one.text, one.n_chars) == ("T\n\nBody text", 12)
    for i in range(5):
        assert got[i] == f"Title {i}\n\nFirst & {i} bold text line\n\nSecond {i}"
    assert got[9] == "Lone"
    assert got[10] == "Head\n\nLong text of the page without an article element\n\nMore\n\nAnd more"
    assert got[11] == got[12] == ""
    assert got[13] == "cut off here & the"
    assert html_wrappers.extracted(df).count() == len(rows)
    assert html_wrappers.report(df.limit(0)).count() == 0


def test_wrapper_is_union_free_and_order_does_not_matter():
    pages = [html_wrappers.wrap(html_wrappers.parse(f"<body><article>{'<p>x</p>' * n}{'<table><tr><td>1</td></tr></table>' if n % 2 else ''}<h2>Same</h2></article>")) for n in (1, 2, 3)]
    first = html_wrappers.merge(html_wrappers.merge(pages[0], pages[1]), pages[2])
    assert first == html_wrappers.merge(pages[2], html_wrappers.merge(pages[0], pages[1])) or first[4][0][1] == "body"
    article = first[4][0][4][0][4]
    assert [(c[1], c[2], c[3]) for c in article] == [("p", True, False), ("table", False, True), ("h2", False, False)]
    assert article[2][4][0][1] == "Same"


def texts_of(*bodies: str) -> list[str]:
    """Main texts of pages of one host."""
    wrapper = html_wrappers.wrap(html_wrappers.parse(bodies[0]))
    for body in bodies[1:]:
        wrapper = html_wrappers.merge(wrapper, html_wrappers.wrap(html_wrappers.parse(body)))
    rules = json.loads(json.dumps(html_wrappers.places(wrapper, len(bodies))))
    return [html_wrappers.main_text(b, *html_wrappers.rules_of(rules)) for b in bodies]


def test_constants_need_support():
    short = "<body><article><h1>T{0}</h1><p>One {0}</p><p>Two {0}</p></article></body>"
    longer = "<body><article><h1>T9</h1><p>One 9</p><h2>Part</h2><p>Last words</p></article></body>"
    got = texts_of(short.format(1), short.format(2), longer)
    assert got == ["T1\n\nOne 1\n\nTwo 1", "T2\n\nOne 2\n\nTwo 2", "T9\n\nOne 9\n\nPart\n\nLast words"]
    # a constant of all pages goes, other text at its path stays
    shared = "<body><article><p>One {0}</p><div class='tail'>Read more here</div></article></body>"
    other = "<body><article><p>One 9</p><div class='tail'>Read more here</div><h2>H</h2><div class='tail'>Ten more words</div></article></body>"
    assert texts_of(*[shared.format(i) for i in range(3)], other) == ["One 0", "One 1", "One 2", "One 9\n\nH\n\nTen more words"]
    assert texts_of(shared.format(1), shared.format(2)) == ["One 1\n\nRead more here", "One 2\n\nRead more here"]  # too few pages


def test_each_page_has_its_own_places():
    article = "<body><article><p>In an article {0}</p></article></body>"
    main = "<body><main><p>In a main part {0}</p></main></body>"
    div = "<body class='single category-{0}'><div class='c'><p>In a division {0}</p></div><div class='s'><p>Few</p></div></body>"
    assert texts_of(article.format("a"), main.format("b"), div.format("c"), div.format("d")) == ["In an article a", "In a main part b", "In a division c", "In a division d"]
    split = "<body><div><h1>Title</h1><section id='intro'><h2>A</h2><p>Some text</p></section><section id='more'><h2>B</h2><p>And other text</p></section></div><div><p>Few</p></div></body>"
    assert texts_of(split) == ["Title\n\nA\n\nSome text\n\nB\n\nAnd other text"]
    nested = "<body><div class='s' id='a'><h1>T</h1><p>Short</p><div class='s' id='b'><h2>U</h2><p>A much longer paragraph</p></div></div></body>"
    assert texts_of(nested) == ["T\n\nShort\n\nU\n\nA much longer paragraph"]
    copies = ["<body><article><p>Same text</p></article></body>"] * 3
    assert texts_of(*copies) == ["Same text"] * 3
    empty = "<body><article></article><main><p>Text {0}</p></main></body>"
    assert texts_of(empty.format(1), article.format(2)) == ["Text 1", "In an article 2"]


def test_everyday_words_drop_no_article_text():
    kept = (
        "<h2 id='social-history'>Social</h2><p id='share-of-votes'>Votes {0}</p><p class='notice'>Mind {0}</p><section id='discussion'><h2>Discussion</h2><p>Open {0}</p></section>"
        "<section id='related-work'><p>Others {0}</p></section><div class='alert alert-info'>Care {0}</div><div class='page-with-sidebar'>Wide {0}</div>"
        "<p>So {0} <math><mi>x</mi><mo>=</mo><mn>2</mn></math><svg><text>axis</text></svg><canvas>drawn</canvas><object>shown</object></p>"
    )
    gone = "<div class='comments-area'><p>Nice {0}</p></div>"
    links = "<div class='related-posts'><a href='/{0}'>Also {0}</a></div><div class='share'>Share this</div>"
    page = f"<body><article><h1>T {{0}}</h1>{kept}{gone}{links}</article></body>"
    text = "T {0}\n\nSocial\n\nVotes {0}\n\nMind {0}\n\nDiscussion\n\nOpen {0}\n\nOthers {0}\n\nCare {0}\n\nWide {0}\n\nSo {0} x=2axisdrawnshown"
    assert texts_of(page.format("a")) == [text.format("a") + "\n\nAlso a\n\nShare this"]  # one page confirms nothing
    assert texts_of(*[page.format(x) for x in "abcd"]) == [text.format(x) for x in "abcd"]


def test_very_long_and_broken_pages():
    text = "<div>" * 3000 + "<p>deep</p>"
    assert html_wrappers.parse("<p>" + "word " * 100_000) is not None
    assert html_wrappers.parse('<a href="' + "x" * 100_000) is not None
    try:
        html_wrappers.main_text(text, {"/"}, set())
    except RecursionError:
        raise AssertionError("deep nesting must not fail") from None


def brute(conversations, pairs):
    turns = {}
    for c, n, r, t in sorted({(c, n, r or "", t or "") for c, n, r, t in conversations if c is not None and n is not None}):
        turns.setdefault(c, []).append((r, t))
    out = []
    for pair, a, b in pairs:
        x, y = turns.get(a, []), turns.get(b, [])
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        render = lambda ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts)
        learned = lambda s, ts: [t + "<|im_end|>\n" for r, t in ts if r == "assistant"]
        out.append((pair, n, render(x[:n]), render(x[n:]), learned(None, x[n:]), render(y[n:]), learned(None, y[n:])))
    return out


def test_preferences_equal_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for c in range(40):
        for n in range(rng.randint(0, 6)):
            rows.append((c, n, ["user", "assistant"][n % 2], f"t{n}" if rng.random() < 0.8 else f"é{rng.randint(0, 3)}"))
    rows += [rows[0], (2, 9, None, None), (3, 9, None, None), (None, 1, "user", "x"), (5, None, "user", "x"), (6, 1, "assistant", "tie"), (7, 1, "assistant", "tie")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n string")
    pairs = [(p, 2 * p, 2 * p + 1) for p in range(20)] + [(90, 0, 0), (91, 3, 999), (92, 0, 1)]
    given = spark.createDataFrame([*pairs, (None, 1, 2), (93, None, 2), pairs[0]], "pair_id long, chosen long, rejected long")
    got = preferences.formatted(given, df).collect()
    cut = lambda text, spans: [text[s.start : s.end] for s in spans]
    assert sorted(
        (r.pair_id, r.n_prompt, r.prompt, r.chosen_completion, cut(r.chosen_completion, r.chosen_spans), r.rejected_completion, cut(r.rejected_completion, r.rejected_spans)) for r in got
    ) == sorted(brute(rows, pairs))
    assert {(r.chosen, r.rejected) for r in preferences.adjacent_pairs(df).collect()} == {(c // 2 * 2, c // 2 * 2 + 1) for c, *_ in rows if c is not None}
    assert preferences.formatted(given, df.limit(0)).count() == len(pairs)
    assert preferences.formatted(given.limit(0), df).count() == 0


def test_alternative_endings_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(c, n, rng.choice(["system", "user", "assistant", "assistant", None]), f"t{rng.randint(0, 2)}") for c in range(30) for n in range(rng.randint(0, 6))]
    rows += [rows[0], (50, 0, "assistant", None), (51, 0, "user", None), (52, None, "user", "x"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, id string")
    turns = {c: [] for c, *_ in rows if c is not None}
    for c, _, r, t in sorted({(c, n, r or "", t or "") for c, n, r, t in rows if c is not None and n is not None}):
        turns[c].append((r, t))
    derived, pairs = [], []
    for c, own in turns.items():
        answers = [n for n, (r, _) in enumerate(own) if r == "assistant"]
        other = list(own)
        if answers:
            other = [*own[: answers[-1]], ("assistant", own[answers[-2]][1] if len(answers) > 1 else "")]
        derived += [(2 * c, n, *t) for n, t in enumerate(own)] + [(2 * c + 1, n, *t) for n, t in enumerate(other)]
        pairs.append((c, 2 * c, 2 * c + 1))
    given, both = preferences.alternative_endings(df)
    assert sorted(map(tuple, given.collect())) == sorted(pairs)
    assert sorted(map(tuple, both.select("conv_id", "turn", "role", "text").collect())) == sorted(derived)
    got = {(r.pair_id, r.n_prompt, r.prompt, r.chosen_completion, r.rejected_completion) for r in preferences.formatted(given, both).collect()}
    assert got == {(p, n, prompt, a, b) for p, n, prompt, a, _, b, _ in brute(derived, pairs)}
    assert len({n for _, n, *_ in got}) > 2
    assert preferences.alternative_endings(df.limit(0))[1].count() == 0


def test_suffix_order_equals_sorting():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.randint(1, rng.randint(1, 3)) for _ in range(rng.randint(0, 25))] + [0] for _ in range(rng.randint(1, 6))] + [[1, 2] * 15 + [0], [1] * 30 + [0]]
        ends = np.cumsum([len(t) for t in texts]) - 1
        got, at = suffix_order(np.array([x for t in texts for x in t]), ends).tolist(), 0
        for t in texts:
            assert got[at : at + len(t)] == [at + i for i in sorted(range(len(t)), key=lambda i, t=t: t[i:])]
            at += len(t)


def test_pipeline_stages(spark, messy, nothing, tmp_path):
    secret = "token = 'abcdef123456'"
    prose = " ".join(f"word{i} of" for i in range(60))
    extra = messy.limit(1).selectExpr("1000L doc_id", f"""\"{prose} {secret}\" text""", "lang", "source", "0L n_chars", "row", "t", "id", "h", "kept", "n_words", "_k")
    docs = messy.union(extra)
    item = " ".join(f"bench{i}" for i in range(12))
    docs = docs.union(extra.selectExpr("1001L doc_id", f"'{prose.replace('of', 'by')} {item}' text", *docs.columns[2:]))
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert set(docs.columns) <= set(out.columns)
    rows = {r.doc_id: r for r in out.collect()}
    assert 1000 in rows and 1001 not in rows  # the benchmark passage goes, the secret is hidden
    assert secret not in rows[1000].text and "[secret]" in rows[1000].text and rows[1000].n_chars == len(rows[1000].text)
    assert 10 in rows and not {11, 12, 13, 14} & rows.keys()  # one of the near copies
    assert not {1, 2, 3, 4, 5} & rows.keys()  # too short
    assert all(len(r.ids) == r.n_tokens for r in rows.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "secret scans", "token ids"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
