"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to lower-case words of letters and digits. The words of
the benchmark are numbered, and a text becomes a string with two characters per
word (the same two for all other words), so offsets of matches are word numbers,
which lead back to the original. Two, because a node looks for its child one by
one, and so no node has more than the root of the number of words. Every window of ``WINDOW`` consecutive item words is
a pattern; one scan of a document finds all occurrences of all patterns. A
document word inside any occurrence is hit.

An automaton holds at most two nodes per pattern word. Items go into one
automaton up to ``NODES`` pattern words, which a worker keeps from task to task. A larger benchmark is dealt to several, which one
Python step builds one after the other for every ``HELD`` bytes of documents,
so that a worker has one of them at a time. The benchmark's texts reach the
driver a block at a time and are broadcast; documents are never shuffled.

Defined cases: null or wordless texts have no words and no hits; items without
words are no patterns; items without an id hit words but are no item of
n_items (with ``nameless=False`` they are left out); ids are compared as
strings; a repeated item_id counts once; repeated documents are each scanned;
extra columns are ignored by ``report`` and kept by ``clean``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corpusmill.llm.common import apart, together
from corpusmill.llm.tokens import LOWER, chunks, texts
from corpusmill.llm.worker import only, tidy

WINDOW = 10
#: Pattern words of an automaton (each takes two nodes at most), and bytes of documents for which each of several is built.
NODES, HELD = 500_000, 32_000_000

_FOLD = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters for words that no item has, and where those of the others start,
#: beyond the surrogates.
_UNKNOWN, _FIRST, _SECOND = "\x01\x01", 0x10000, 0x80000

Items = list[tuple[str | None, bytes]]


class Scanner:
    """One automaton with its words."""

    def __init__(self, items: Items, window: int):
        split = [(item, text.translate(_FOLD).split()) for item, text in items]
        words = dict.fromkeys(w for _, ws in split for w in ws)
        base = math.isqrt(len(words)) + 1
        # the two characters are from different ranges, so no match starts inside a word
        self.names = {w: chr(_FIRST + i // base) + chr(_SECOND + i % base) for i, w in enumerate(words)}
        found: dict[str, set[str]] = {}
        for item, ws in split:
            line = "".join([self.names[w] for w in ws])
            for i in range(0, max(2, len(line) - 2 * window + 2) if line else 0, 2):
                found.setdefault(line[i : i + 2 * window], set()).update(() if item is None else (item,))
        self.automaton = ahocorasick.Automaton()
        for pattern, ids in found.items():
            self.automaton.add_word(pattern, (len(pattern) // 2, tuple(sorted(ids))))
        self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit runs of words (first, end), and items found."""
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        if words and len(self.automaton):
            name = self.names.get
            for end, (length, ids) in self.automaton.iter("".join(map(name, words, repeat(_UNKNOWN)))):
                last = end // 2
                first = last + 1 - length
                items.update(ids)
                while runs and runs[-1][1] >= first:
                    first = min(first, runs.pop()[0])
                runs.append((first, last + 1))
        return runs, items


def original(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code point offsets in the text as it was."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", nameless: bool = True, window: int = WINDOW) -> Iterator[Items]:
    """The benchmark's items in lists of about NODES pattern words, fetched one
    at a time; a single item is never cut."""
    kept = benchmark.where(F.col(text).isNotNull() & (F.lit(nameless) | F.col(item).isNotNull())).select(F.col(item).cast("string").alias("item"), F.col(text).alias("t"))
    words = F.regexp_count("t", F.lit(_WORD.pattern))
    nodes = F.when(words <= window, words).otherwise((words - window + 1) * window)
    total = kept.agg(F.sum(nodes)).first()[0] or 0
    n = 1 if total <= NODES else -(-3 * total // (2 * NODES))
    for k in range(n):
        part = kept if n == 1 else kept.where(F.pmod(F.xxhash64("item", "t"), F.lit(n)) == k)
        yield sorted({(r.item, r.t.encode()) for r in part.collect()}, key=lambda x: (x[0] is not None, x[0] or "", x[1]))


_RUNS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scanned(batches: Iterator[pa.RecordBatch], shared: list, window: int, key: str) -> Iterator[pa.RecordBatch]:
    """Batches (row, t) with n_words, runs and items added."""
    many = len(shared) > 1
    for batch, parts in chunks(batches, "t", HELD if many else 1_000_000):
        words = [t.translate(_FOLD).split() for t in parts]
        runs: list[list[tuple[int, int]]] = [[] for _ in parts]
        items: list[set[str]] = [set() for _ in parts]
        for number, block in enumerate(shared):
            scanner = only((key, number), lambda block=block: Scanner(block.value, window))
            for i, w in enumerate(words):
                more, found = scanner.scan(w)
                if more:
                    runs[i] = _union([*runs[i], *more]) if runs[i] else more
                    items[i] |= found
        columns = [
            pa.array([len(w) for w in words], pa.int64()),
            pa.array([[{"a": a, "b": b} for a, b in r] for r in runs], _RUNS),
            pa.array([sorted(x) for x in items], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "n_words", "runs", "items"])


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, nameless: bool = True) -> DataFrame:
    """``row`` (a struct of all other columns of ``docs``), the text ``t``, n_words,
    ``runs`` of hit words (first, end) and ``items`` found, ascending."""
    df = docs.select(apart(docs, text, docs.columns), F.col(text).alias("t"))
    shape = df.limit(0).selectExpr("row", "t", "0L n_words", "array() :: array<struct<a:long,b:long>> runs", "array() :: array<string> items").schema
    shared, digest = [], hashlib.sha256(repr(window).encode())
    for items in blocks(benchmark, item, item_text, nameless, window):
        digest.update(repr(items).encode())
        shared.append(docs.sparkSession.sparkContext.broadcast(items))
    key = digest.hexdigest()
    return df.mapInArrow(tidy(lambda batches: _scanned(batches, shared, window, key), (key, 0)), shape)


def offsets(found: DataFrame) -> DataFrame:
    """``hits`` with ``spans``: the runs of hit words as code point offsets
    (start, end) in the original text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(3).to_pylist()
            made = [original(t.decode(), [(x["a"], x["b"]) for x in r]) if r else [] for t, r in zip(texts(batch.column(1)), old, strict=True)]
            spans = pa.array([[{"a": a, "b": b} for a, b in r] for r in made], _RUNS)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, "spans"])

    shape = StructType([*found.schema, StructField("spans", found.schema["runs"].dataType)])
    return found.mapInArrow(run, shape)


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", nameless: bool = True) -> DataFrame:
    """Per row: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = hits(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark, nameless=nameless)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])
    names = F.array_join(F.array_sort("items"), ",")
    return found.select(
        F.col("row.key").alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.size("runs") > 0).alias("contaminated")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", nameless: bool = True) -> DataFrame:
    """The rows of ``docs`` without any hit, columns unchanged."""
    return hits(docs, benchmark, text, nameless=nameless).where(F.size("runs") == 0).select(*together(text, docs.columns))
