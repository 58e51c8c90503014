"""Aligning the tokens of two tokenizers over the same bytes.

Both vocabularies cut a text, with a space in front, into tokens of known bytes.
Offsets where tokens of both end cut the two token streams into groups; tokens
whose bytes overlap are linked.

A byte range of a document yields a *fragment*: the tokens up to the first
common end (open prefix), the closed groups up to the last one, and the tokens
after it (open suffix); without a common end all of it is open. Fragments
compose: the suffix of one and the prefix of the next make one more closed
group. Composition is associative, so documents longer than ``RANGE`` bytes are
cut into ranges that go to different tasks, and a tree of groupings, ``FAN``
neighbours to one, makes one fragment of them. Other documents are one range.
A range starts and ends at any byte; its text is read a little further on both
sides, from one place where neither vocabulary joins bytes to another such place.

How many documents hold a pair of ids linked is added up in two steps: distinct
pairs of a piece of some megabytes of text first, then a shuffle of those rows.
The counts go back to the pieces the same way, where they meet the pieces' documents.
Texts and token ids are never shuffled but for long documents.

Defined cases: null or empty texts, and texts that a vocabulary does not give
back byte by byte, have no tokens; repeated rows count as documents of their
own, null ids too; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import dataclasses
import hashlib
import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm.tokens import chunks
from corpusmill.session import cut_lineage, work_folder

#: Bytes of a fragment's range; bytes read beyond it before the range is moved instead.
RANGE, CONTEXT = 1 << 18, 4096
FAN = 16
#: Bytes of text encoded at once, and in one piece for counting.
STEP, PIECE = 500_000, 8_000_000
#: Ids of the second vocabulary are below this, so a pair is one integer.
SHIFT = 16

_RUN = 2000
_WHITE = re.compile(r"\s{%d}" % _RUN)
_BREAK = re.compile(r"(?<=\w) (?=\w)")
_I8 = np.int64


# ---- vocabularies


class Ranks:
    """A byte-level vocabulary of ranks; the text comes with its space. The same
    vocabulary in the form of the tokenizers library encodes texts whose runs of
    white space are too long for the other's patterns."""

    def __init__(self, path: str, same: str):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cuttable = True  # its pattern starts a new token at a space between words
        self.same = same

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return [self.slow(t) if len(t) > _RUN and _WHITE.search(t) else self.coder.encode_ordinary(t) for t in spaced]

    def slow(self, text: str) -> list[int]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        coder = Tokenizer.from_file(self.same)
        coder.encode_special_tokens = True
        return coder.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentencepiece vocabulary, which puts the space in front itself."""

    def __init__(self, path: str):
        self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.coder.get_piece_size()
        names = [self.coder.id_to_piece(i) for i in range(n)]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # a piece that goes on after a space could join what a range must take apart
        self.cuttable = not any("▁" in p.lstrip("▁") for p in names)

    def encode(self, spaced: list[str]) -> list[list[int]]:
        return self.coder.encode([t[1:] for t in spaced], num_threads=1)


@dataclasses.dataclass(frozen=True)
class Pair:
    """Where the two vocabularies are (the first one in both its forms); each
    worker loads them once."""

    a: str
    a_same: str
    b: str

    def load(self) -> tuple[Ranks, Pieces, np.ndarray, np.ndarray]:
        if _loaded.get("pair") != self:
            a, b = Ranks(self.a, self.a_same), Pieces(self.b)
            if len(b.tokens) > 1 << SHIFT:
                raise ValueError("the second vocabulary is too large")
            _loaded.update(pair=self, made=(a, b, *(np.array([len(t) for t in v.tokens], _I8) for v in (a, b))))
        return _loaded["made"]


_loaded: dict[str, object] = {}  # one pair at most


# ---- fragments

_DIGITS = 8  # room for an id below 10 ** 7 and a sign


def _written(ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with its sign behind it, as bytes; and their lengths."""
    size = np.ones(len(ids), _I8)
    for k in range(1, _DIGITS - 1):
        size += ids >= 10**k
    out = np.zeros((len(ids), _DIGITS), np.uint8)
    rest, rows = ids.copy(), np.arange(len(ids))
    for k in range(int(size.max(initial=0))):
        inside = size > k
        at = size - 1 - k
        out[rows[inside], at[inside]] = 48 + rest[inside] % 10
        rest //= 10
    out[rows, size] = signs
    return out[np.arange(_DIGITS) <= size[:, None]], size + 1


class Streams:
    """Token streams that cover the same bytes: links and groups at once."""

    def __init__(self, a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray):
        low = min(a_ends[0], b_ends[0]) if len(a) and len(b) else 0
        high = max(a_ends[-1], b_ends[-1]) if len(a) and len(b) else 0
        mark = np.zeros(int(high - low) + 1, np.uint8)
        mark[a_ends - low] = 1
        mark[b_ends - low] |= 2
        at = np.flatnonzero(mark)
        kind = mark[at] if len(a) else np.zeros(0, np.uint8)
        in_a, in_b = kind & 1, kind >> 1
        self.ends, self.common = at + low, kind == 3
        # between two ends lies one token of each stream: one link
        link_a, link_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        self.pairs = (a[link_a] << SHIFT) | b[link_b] if len(a) else np.zeros(0, _I8)
        group = np.cumsum(self.common) - self.common
        self.a, self.b = a, b
        self.group_a, self.group_b = group[in_a > 0], group[in_b > 0]

    def text(self) -> tuple[np.ndarray, np.ndarray]:
        """The groups as bytes ``a1,a2|b1;``..., and where each group ends."""
        n = int(self.common.sum())
        per_a, per_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        upto_a, upto_b = np.cumsum(per_a), np.cumsum(per_b)
        place_a = np.arange(len(self.a)) + (upto_b - per_b)[self.group_a]
        place_b = np.arange(len(self.b)) + upto_a[self.group_b]
        ids, signs = np.empty(len(self.a) + len(self.b), _I8), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        signs[upto_a + upto_b - per_b - 1] = ord("|")
        signs[upto_a + upto_b - 1] = ord(";")
        data, size = _written(ids, signs)
        return data, np.cumsum(size)[upto_a + upto_b - 1]


@dataclasses.dataclass
class Fragment:
    """What a byte range says; ``prefix`` and ``suffix`` are tokens and their
    ends in the document, of both streams."""

    ok: bool
    n_a: int
    n_b: int
    closed: bool  # whether there is a common end
    prefix: list[np.ndarray]
    groups: bytes  # the closed groups after the prefix, each with its ";"
    n_groups: int
    pairs: np.ndarray  # distinct linked pairs of the closed groups
    times: np.ndarray
    suffix: list[np.ndarray]


def _none() -> list[np.ndarray]:
    return [np.zeros(0, _I8) for _ in range(4)]


def _sum(pairs: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate(pairs), return_inverse=True)
    return keys, np.bincount(back, np.concatenate(times), len(keys)).astype(_I8)


def fragment(a: np.ndarray, a_ends: np.ndarray, b: np.ndarray, b_ends: np.ndarray, ok: bool = True) -> Fragment:
    """The fragment of the tokens that end in a range."""
    common = np.intersect1d(a_ends, b_ends, assume_unique=True)
    if not len(common):
        return Fragment(ok, len(a), len(b), False, [a, a_ends, b, b_ends], b"", 0, np.zeros(0, _I8), np.zeros(0, _I8), _none())
    cut = [[np.searchsorted(e, common[0], "right"), np.searchsorted(e, common[-1], "right")] for e in (a_ends, b_ends)]
    prefix, closed, suffix = ([x[s] for x, s in zip((a, a_ends, b, b_ends), (sa, sa, sb, sb), strict=True)] for sa, sb in zip(*([slice(0, i), slice(i, j), slice(j, None)] for i, j in cut), strict=True))
    if not len(closed[0]):
        return Fragment(ok, len(a), len(b), True, prefix, b"", 0, np.zeros(0, _I8), np.zeros(0, _I8), suffix)
    found = Streams(*closed)
    pairs, times = np.unique(found.pairs, return_counts=True)
    return Fragment(ok, len(a), len(b), True, prefix, found.text()[0].tobytes(), int(found.common.sum()), pairs, times.astype(_I8), suffix)


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    ok, n_a, n_b = x.ok and y.ok, x.n_a + y.n_a, x.n_b + y.n_b
    if not x.closed:
        return Fragment(ok, n_a, n_b, y.closed, _chain(x.prefix, y.prefix), y.groups, y.n_groups, y.pairs, y.times, y.suffix)
    between = _chain(x.suffix, y.prefix)
    if not y.closed:
        return Fragment(ok, n_a, n_b, True, x.prefix, x.groups, x.n_groups, x.pairs, x.times, between)
    middle = Streams(*between)
    pairs, times = _sum([x.pairs, middle.pairs, y.pairs], [x.times, np.ones(len(middle.pairs), _I8), y.times])
    return Fragment(ok, n_a, n_b, True, x.prefix, x.groups + middle.text()[0].tobytes() + y.groups, x.n_groups + 1 + y.n_groups, pairs, times, y.suffix)


def _chain(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    return [np.concatenate(pair) for pair in zip(x, y, strict=True)]


def finish(whole: Fragment) -> Fragment:
    """The fragment of a whole document, with its prefix as the first group."""
    start = Fragment(True, 0, 0, True, _none(), b"", 0, np.zeros(0, _I8), np.zeros(0, _I8), _none())
    done = compose(start, whole)
    if done.ok and len(done.suffix[0]) + len(done.suffix[2]):
        raise ValueError("tokens after the last common end")
    return done


def ranges(text: bytes, size: int, context: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(first byte, end byte, first byte read, text read) of the ranges of a text
    that starts with a space."""
    data = np.frombuffer(text, np.uint8)
    places = np.flatnonzero((data & 0xC0) != 0x80)[[m.start() for m in _BREAK.finditer(text.decode())]] if len(text) > size else []
    places = np.concatenate(([0], np.asarray(places, _I8), [len(text)]))
    low = 0
    while low < len(text):
        high = min(low + size, len(text))
        start, end = int(places[np.searchsorted(places, low, "right") - 1]), int(places[np.searchsorted(places, high, "left")])
        if end - high > context:
            high = end
        yield low, high, start, text[start:end]
        low = high


# ---- in tasks


def _encoded(pair: Pair, texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], list[bool]]:
    """Ids of both vocabularies for texts with their space, and whether they give
    back the text."""
    a, b, _, _ = pair.load()
    strings = [t.decode() for t in texts]
    found = [a.encode(strings), b.encode(strings)]
    ok = [t != b"" and b"".join([a.tokens[i] for i in x]) == t and b"".join([b.tokens[i] for i in y]) == t for x, y, t in zip(*found, texts, strict=True)]
    return [np.array(x, _I8) for x in found[0]], [np.array(y, _I8) for y in found[1]], ok


_PACKED = "ok boolean, n_a long, n_b long, closed boolean, prefix array<binary>, groups binary, n_groups long, pairs binary, times binary, suffix array<binary>"


def _packed(f: Fragment) -> dict:
    row = dict(vars(f))
    for c in ("prefix", "suffix"):
        row[c] = [x.astype("<i8").tobytes() for x in row[c]]
    return row | {"pairs": f.pairs.astype("<i8").tobytes(), "times": f.times.astype("<i8").tobytes()}


def _unpacked(row: dict) -> Fragment:
    row = {k: row[k] for k in (f.name for f in dataclasses.fields(Fragment))}
    for c in ("prefix", "suffix"):
        row[c] = [np.frombuffer(x, "<i8") for x in row[c]]
    return Fragment(**row | {"pairs": np.frombuffer(row["pairs"], "<i8"), "times": np.frombuffer(row["times"], "<i8")})


def _delta(pairs: np.ndarray) -> bytes:
    """Ascending pairs, small numbers for the writer to compress."""
    return np.diff(pairs, prepend=0).astype("<u4").tobytes()


def _pairs(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4").astype(_I8))


#: Rows of a piece: its documents, the ranges of its long ones, and its distinct
#: pairs with the number of documents that hold them.
_SHAPE = "kind string, piece string, doc string, no long, low long, high long, first long, data binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
_FIELDS = [x.split()[0] for x in _SHAPE.split(", ")]


class _Rows:
    """Rows of one shape with mostly empty columns, as a record batch with the key."""

    def __init__(self, key_type: pa.DataType):
        self.rows: list[dict] = []
        types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
        self.shape = pa.schema([("key", key_type), *((n, types[x.split()[1]]) for n, x in zip(_FIELDS, _SHAPE.split(", "), strict=True))])

    def add(self, kind: str, piece: str, **values: object) -> None:
        self.rows.append({"kind": kind, "piece": piece, **values})

    def take(self) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_pylist(self.rows, self.shape)
        self.rows = []
        return batch


class _Piece:
    """Distinct pairs of the documents of a piece of the corpus."""

    def __init__(self) -> None:
        self.name, self.size = uuid.uuid4().hex, 0
        self.pairs, self.docs = np.zeros(0, _I8), np.zeros(0, _I8)

    def add(self, pairs: np.ndarray, docs: np.ndarray, size: int) -> None:
        self.pairs, self.docs = _sum([self.pairs, pairs], [self.docs, docs])
        self.size += size


def _many(pair: Pair, texts: list[bytes]) -> Iterator[dict]:
    """For whole documents: counts, hash, pairs and how often each is linked."""
    a, b, ok = _encoded(pair, texts)
    _, _, len_a, len_b = pair.load()
    used = [i for i, x in enumerate(ok) if x]
    nothing = {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "pairs": b"", "times": b"", "found": np.zeros(0, _I8)}
    if not used:
        yield from (dict(nothing) for _ in texts)
        return
    ids = [np.concatenate([x[i] for i in used]) for x in (a, b)]
    # documents lie one after the other, so the end of each is a common end
    found = Streams(ids[0], np.cumsum(len_a[ids[0]]), ids[1], np.cumsum(len_b[ids[1]]))
    ends = np.cumsum([len(texts[i]) for i in used])
    links = np.searchsorted(found.ends, ends, "right")
    groups = np.cumsum(found.common)[links - 1]
    data, group_ends = found.text()
    stops = group_ends[groups - 1].tolist()
    doc = np.repeat(np.arange(len(used)), np.diff(links, prepend=0))
    keys, times = np.unique((doc << 40) | found.pairs, return_counts=True)
    pairs, bounds = keys & ((1 << 40) - 1), np.searchsorted(keys, np.arange(len(used) + 1) << 40).tolist()
    n_links, n_groups = np.diff(links, prepend=0).tolist(), np.diff(groups, prepend=0).tolist()
    number = iter(range(len(used)))
    for i in range(len(texts)):
        if not ok[i]:
            yield dict(nothing)
            continue
        k = next(number)
        some = slice(bounds[k], bounds[k + 1])
        sha = hashlib.sha256(data[(stops[k - 1] if k else 0) : stops[k] - 1].tobytes()).hexdigest()
        yield {"n_a": len(a[i]), "n_b": len(b[i]), "n_groups": n_groups[k], "n_links": n_links[k], "groups_sha256": sha, "pairs": _delta(pairs[some]), "times": times[some].astype("<u4").tobytes(), "found": pairs[some]}


def _first(pair: Pair, size: int, context: int, key_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, _, _ = pair.load()
        piece, rows = _Piece(), _Rows(key_type)
        for batch, parts in chunks(batches, "t", STEP):
            keys = batch.column(0).to_pylist()
            texts = [b" " + t if t else b"" for t in parts]
            long = [len(t) > size and a.cuttable and b.cuttable for t in texts]
            short = [i for i, x in enumerate(long) if not x]
            held: list[np.ndarray] = []
            for i, row in zip(short, _many(pair, [texts[i] for i in short]), strict=True):
                held.append(row.pop("found"))
                rows.add("doc", piece.name, key=keys[i], **row)
            if held:
                pairs, docs = np.unique(np.concatenate(held), return_counts=True)
                piece.add(pairs, docs, sum(len(texts[i]) for i in short))
            for i in (i for i, x in enumerate(long) if x):
                doc = uuid.uuid4().hex
                for no, (low, high, first, data) in enumerate(ranges(texts[i], size, context)):
                    rows.add("range", piece.name, key=keys[i], doc=doc, no=no, low=low, high=high, first=first, data=data)
            if piece.size >= PIECE:
                rows.add("pairs", piece.name, pairs=_delta(piece.pairs), times=piece.docs.astype("<u4").tobytes())
                piece = _Piece()
            yield rows.take()
        if len(piece.pairs):
            rows.add("pairs", piece.name, pairs=_delta(piece.pairs), times=piece.docs.astype("<u4").tobytes())
            yield rows.take()

    return run


def _long(cut: DataFrame, pair: Pair, key: str) -> DataFrame:
    """Documents and pairs, as in ``_SHAPE``, of documents cut into ranges."""
    names = ["key", "doc", "no", *[x.split()[0] for x in _PACKED.split(", ")]]
    kind = f"key {key}, doc string, no long, {_PACKED}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, len_a, len_b = pair.load()
        for batch in batches:
            for r in batch.to_pylist():
                (a,), (b,), (ok,) = _encoded(pair, [r["data"]])
                ends = [r["first"] + np.cumsum(n[x]) for n, x in ((len_a, a), (len_b, b))]
                inside = [(e > r["low"]) & (e <= r["high"]) for e in ends]
                found = fragment(a[inside[0]], ends[0][inside[0]], b[inside[1]], ends[1][inside[1]], ok)
                row = {"key": r["key"], "doc": r["doc"], "no": r["no"], **_packed(found)}
                yield pa.RecordBatch.from_pylist([row], _arrow(batch.schema.field("key").type))

    def join(table: pa.Table) -> pa.Table:
        rows = table.sort_by("no").to_pylist()
        found = _unpacked(rows[0])
        for r in rows[1:]:
            found = compose(found, _unpacked(r))
        row = {"key": rows[0]["key"], "doc": rows[0]["doc"], "no": rows[0]["no"] // FAN, **_packed(found)}
        return pa.Table.from_pylist([row], _arrow(table.schema.field("key").type))

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _Rows(batch.schema.field("key").type)
            for r in batch.to_pylist():
                f, piece = finish(_unpacked(r)), r["doc"]
                if not f.ok:
                    rows.add("doc", piece, key=r["key"], n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256="", pairs=b"", times=b"")
                else:
                    sha = hashlib.sha256(f.groups[:-1]).hexdigest()
                    pairs = _delta(f.pairs)
                    rows.add("doc", piece, key=r["key"], n_a=f.n_a, n_b=f.n_b, n_groups=f.n_groups, n_links=int(f.times.sum()), groups_sha256=sha, pairs=pairs, times=f.times.astype("<u4").tobytes())
                    rows.add("pairs", piece, pairs=pairs, times=np.ones(len(f.pairs), "<u4").tobytes())
            yield rows.take()

    last = cut.agg(F.max("no")).first()[0]
    parts = cut.select("key", "doc", "no", "low", "high", "first", "data").repartition(F.col("doc"), F.col("no"))
    df = parts.mapInArrow(encode, kind).select(*names)
    while last:
        df = cut_lineage(df.groupBy("doc", F.floor(F.col("no") / FAN)).applyInArrow(join, kind))
        last //= FAN
    return df.mapInArrow(end, f"key {key}, {_SHAPE}")


def _arrow(key: pa.DataType) -> pa.Schema:
    types = {"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([("key", key), ("doc", pa.string()), ("no", pa.int64()), *((n, types[t]) for n, t in (x.split() for x in _PACKED.split(", ")))])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece, pairs, docs in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            found = _pairs(pairs)
            names = pa.DictionaryArray.from_arrays(np.zeros(len(found), np.int32), [piece]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(found), pa.array(np.frombuffer(docs, "<u4").astype(_I8))], names=["piece", "pair", "docs"])


def aligned(docs: DataFrame, pair: Pair, key: str = "doc_id", text: str = "text", size: int = RANGE, context: int = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """``(documents, pairs)``: per row key, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256; and per pair of ids a, b the documents that hold it
    linked, and whether no other pair of its a has more."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = rows.schema["key"].dataType
    shape = f"key {kind.simpleString()}, {_SHAPE}"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the key's type is that of the batches
            yield from _first(pair, size, context, batch.schema.field("key").type)(_again(batch, batches))
            return

    rows.mapInArrow(first, shape).write.option("compression", "zstd").parquet(f"{folder}/short")
    found = spark.read.schema(shape).parquet(f"{folder}/short")
    cut = found.where("kind = 'range'")
    if not cut.isEmpty():
        _long(cut, pair, kind.simpleString()).write.option("compression", "zstd").parquet(f"{folder}/long")
        found = found.unionByName(spark.read.schema(shape).parquet(f"{folder}/long"))

    held = found.where("kind = 'pairs'").select("piece", "pairs", "times").mapInArrow(_spread, "piece string, pair long, docs long")
    counted = held.groupBy("pair").agg(F.sum("docs").alias("docs"))
    counted = counted.withColumn("a", F.shiftright("pair", SHIFT))
    best = counted.groupBy("a").agg(F.max("docs").alias("most"))
    counted = cut_lineage(counted.join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("pair")
        pairs, n, best = (right.column(c).to_numpy() for c in ("pair", "docs", "best"))
        sums = []
        for some, times in zip(left.column("pairs").to_pylist(), left.column("times").to_pylist(), strict=True):
            at, t = np.searchsorted(pairs, _pairs(some)), np.frombuffer(times, "<u4").astype(_I8)
            sums.append((int((t * best[at]).sum()), int((t * n[at]).sum())) if len(at) else (0, 0))
        left = left.drop_columns(["piece", "pairs", "times"])
        for i, name in enumerate(("n_best", "count_sum")):
            left = left.append_column(name, pa.array([s[i] for s in sums], pa.int64()))
        return left

    result = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    documents = found.where("kind = 'doc'").select(*result, "piece", "pairs", "times")
    back = held.select("piece", "pair").join(counted, "pair")
    out = f"key {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    scored = documents.where("n_links > 0").groupBy("piece").cogroup(back.groupBy("piece")).applyInArrow(score, out)
    none = documents.where("n_links = 0").select(*result, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    per_doc = scored.unionByName(none).select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return per_doc, counted.select(F.shiftright("pair", SHIFT).alias("a"), F.col("pair").bitwiseAND((1 << SHIFT) - 1).alias("b"), "docs", "best")


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def report(docs: DataFrame, pair: Pair, **options: object) -> DataFrame:
    return aligned(docs, pair, **options)[0]
