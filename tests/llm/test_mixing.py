"""Importance resampling, token alignment and source mixing against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import alignment, importance, ranking, source_mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FILES = [public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model")]


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ---- numbering and importance


def test_numbering_is_the_order(spark):
    rows = [((i * 7919) % 501, i % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "x long, y long").repartition(7)
    got = ranking.numbered(df, [F.col("x").desc(), F.col("y")], "n").collect()
    assert [(r.x, r.y) for r in sorted(got, key=lambda r: r.n)] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r.n for r in got) == list(range(2000))
    with pytest.raises(ValueError):
        ranking.numbered(df, [F.col("x")], "y")


def low(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def importance_brute(docs, target, most, least=20):
    def grams(text):
        w = low(text)
        return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % 10000
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(map(bucket, grams(x)))
    for x in target:
        t.update(map(bucket, grams(x)))
    big_s, big_t = s.total(), t.total()
    rows = []
    for k, x in docs:
        g = grams(x)
        w = sum(math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in map(bucket, g))
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(g), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(low(x))))
    enough = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    return rows, [(r[0], r[3]) for r in enough[: 10 * len(enough) // 100]]


@pytest.mark.parametrize("most", [1, 3])
def test_importance_equals_brute_force(spark, messy, most):
    rng = random.Random(2)
    extra = [(100 + i, " ".join(rng.choice(["cat", "Dog", "é", "x-1", "und"]) for _ in range(rng.randint(15, 60)))) for i in range(200)]
    rows = [(r.doc_id, r.text) for r in messy.collect()] + extra
    target = ["the cat; the CAT", None, "", "Éé dog x"]
    df, goal = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.report(df, goal, most=most).collect()
    expected, ranked = importance_brute(rows, target, most)
    assert in_order((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in got) == in_order(expected)
    drawn = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [(r.doc_id, r.score) for r in drawn] == ranked and [r["rank"] for r in drawn] == list(range(1, len(ranked) + 1))


def test_importance_of_messy_and_empty_tables(spark, messy, nothing):
    goal = spark.createDataFrame([("the cat sat",)], "text string")
    assert importance.report(nothing, goal).count() == 0
    assert all(r.weight <= 0 or r.n_features for r in importance.report(messy, goal.limit(0)).collect())
    kept = importance.drawn(messy, goal, percent=50)
    assert kept.columns == messy.columns and 0 < kept.count() < messy.count()


# ---- alignment


def alignment_brute(rows):
    tokenizer = Tokenizer.from_file(FILES[1])
    tokenizer.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    names = {v: k for k, v in tokenizer.get_vocab().items()}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}

    def piece(i):
        return bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()

    out, links = [], []
    for key, text in rows:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        parts = [[bytes(back[c] for c in names[i]) for i in a], [piece(i) for i in b]]
        if not text or any(b"".join(p) != (" " + text).encode() for p in parts):
            out.append((key, 0, 0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        groups, found, at = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            upto = [x.index(e) + 1 for x in ends]
            i, j = (range(at[k], upto[k]) for k in (0, 1))
            groups.append(",".join(str(a[x]) for x in i) + "|" + ",".join(str(b[y]) for y in j))
            spans = [{x: (ends[k][x] - len(parts[k][x]), ends[k][x]) for x in r} for k, r in ((0, i), (1, j))]
            found += [(a[x], b[y]) for x in i for y in j if spans[0][x][0] < spans[1][y][1] and spans[1][y][0] < spans[0][x][1]]
            at = upto
        out.append((key, len(a), len(b), len(groups), len(found), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(found)
    counts = Counter(p for f in links for p in set(f))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [(*o[:5], sum(counts[p] == best[p[0]] for p in f), sum(counts[p] for p in f), o[5]) for o, f in zip(out, links, strict=True)], counts


ODD = [
    (None, ""), (5, None), (6, "a▁b c"), (6, "a  c  é 日本語 <s> <|endoftext|> d"), (7, "x" * 3000 + " " + "日" * 500), (8, "\x00 a\n\n\n  b  c　d"),
    (6, "  don't  stop  "), (9, " "), (10, "word " * 2000), (11, " " * 30_000 + "a b"), (12, "ﬁ ① Å"), (13, "naïve café " * 60), (13, "naïve café " * 60),
]


@pytest.mark.parametrize(("size", "context"), [(1 << 18, 4096), (700, 64), (60, 12)])
def test_alignment_equals_brute_force(spark, messy, size, context):
    rows = ODD + [(r.doc_id, r.text and r.text[: 4000 if size > 100 else 600]) for r in messy.collect()]
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, pairs string").repartition(3)
    got, pairs = alignment.aligned(docs, alignment.Pair(*FILES), size=size, context=context)
    expected, counts = alignment_brute(rows)
    assert in_order(got.collect()) == in_order(expected)
    assert {(r.a, r.b): r.docs for r in pairs.collect()} == counts


def test_alignment_of_an_empty_table(spark, nothing):
    assert alignment.report(nothing, alignment.Pair(*FILES)).count() == 0


def test_fragments_compose_in_any_grouping():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(5, 60)
        streams = [sorted({n, *(rng.randint(1, n) for _ in range(rng.randint(0, n)))}) for _ in range(2)]
        ids = [np.array([rng.randint(0, 40_000) for _ in s], np.int64) for s in streams]
        a, b = (np.array(s, np.int64) for s in streams)
        cuts = sorted({0, n, *(rng.randint(1, n) for _ in range(4))})
        parts = [alignment.fragment(ids[0][(a > x) & (a <= y)], a[(a > x) & (a <= y)], ids[1][(b > x) & (b <= y)], b[(b > x) & (b <= y)]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        whole = alignment.finish(alignment.fragment(ids[0], a, ids[1], b))
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [alignment.compose(parts[i], parts[i + 1])]
        done = alignment.finish(parts[0])
        assert (done.groups, done.n_groups, done.n_a, done.n_b) == (whole.groups, whole.n_groups, whole.n_a, whole.n_b)
        assert done.pairs.tolist() == whole.pairs.tolist() and done.times.tolist() == whole.times.tolist()


# ---- mixing


def targets_brute(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    rest, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / total for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


def mix_checked(df, got):
    rows = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in df.collect()]
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    goal = targets_brute(sizes)
    assert in_order((r.doc_id, r["_source"], r["size"]) for r in got) == in_order(rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r["_source"]] and abs(r.target - goal[r["_source"]]) <= 1e-6 * max(1, r.target)
        assert r.taken == r["copies"] * r["size"] and r.taken <= 2 * r["size"]
        assert math.floor(r.target / max(1, r.source_size) - 1e-9) <= r["copies"] <= math.ceil(r.target / max(1, r.source_size) + 1e-9)
        taken[r["_source"]] += r.taken
        largest[r["_source"]] = max(largest[r["_source"]], r["size"])
    assert all(abs(taken[s] - goal[s]) <= largest[s] for s in goal)


def test_mix_reaches_its_targets(spark, messy, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1.2))), rng.choice(["hot"] * 9 + ["a", "b", "é", "z", None])) for i in range(3000)]
    rows += [(5000, "one two three", "b")] * 70 + [(None, "one two", "hot")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(source_mix, "BLOCK", 50)
    monkeypatch.setattr(source_mix, "FAN", 3)
    got = source_mix.report(df).collect()
    mix_checked(df, got)
    assert in_order(got) == in_order(source_mix.report(df.repartition(5, "text")).collect())
    mixed = source_mix.mixed(df)
    assert mixed.columns == df.columns
    assert mixed.select(F.sum(F.regexp_count("text", F.lit(source_mix.WORD)))).first()[0] == sum(r.taken for r in got)


def test_mix_of_messy_and_empty_tables(messy, nothing):
    mix_checked(messy, source_mix.report(messy).collect())
    assert source_mix.report(nothing).count() == 0


def test_rounding_keeps_expectations():
    size, p = np.array([50.0, 20, 20, 8, 8, 4, 4, 2]), np.array([0.3, 0.7, 0.5, 0.5, 0.2, 0.9, 0.4, 0.6])
    runs = np.array([source_mix.settle(p, size, np.random.default_rng(i), True)[0] for i in range(4000)])
    assert set(np.unique(runs)) == {0.0, 1.0}
    assert np.abs(runs.mean(0)[:4] - p[:4]).max() < 0.04  # all but those that settle the last difference
    assert np.abs(runs @ size - p @ size).max() <= 50
