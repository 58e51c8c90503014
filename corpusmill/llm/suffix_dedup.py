"""Removal of repeated 100-byte strings with suffix arrays.

Texts are UTF-8 bytes. A byte goes if a ``K``-byte string covers it that also
starts earlier: in a document with a smaller id, or in the same one before. All
is judged on the input; matches never cross documents.

Strings are dealt out by the core of their minimiser (see ``windows``), so equal ones meet in a
bucket. There the distinct strings of a bucket, each closed by a separator, are
one text, and all texts of a batch are suffix-sorted together by Lyndon grouping
(see ``lyndon``). Suffixes with the same first ``K`` bytes are neighbours; of
each such run the earliest start stays. A string that is one in its bucket needs
no sorting, and of identical strings one is sorted; the later ones go whole.
A bucket of many distinct strings is sorted ``SORTED`` at a time; the earliest
windows of the parts are then settled by their hashes, and what is left of a
salted bucket is settled across buckets.

Defined cases: null and empty texts have no bytes; texts shorter than ``K`` lose
none; a null id counts as the smallest; rows that share id and text are the same
document and don't repeat each other; extra columns are kept by ``cleaned``.
Where a range of removed bytes cuts a character, the bytes that stay are still
exactly those not removed, so the kept part is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import windows
from corpusmill.llm.lyndon import suffix_order
from corpusmill.llm.tokens import chunks, mix, series

K = 100
GRAM = 24
#: Occurrences of a core in one bucket.
LOCAL = 256
#: Distinct strings sorted together; a bucket of more is sorted in parts.
SORTED = 32


def _words(data: bytes, n: int) -> np.ndarray:
    """The eight bytes from each of the first ``n`` places on, as integers."""
    return np.ndarray((n,), "<u8", buffer=data, strides=(1,))


def _symbols(parts: list[bytes]) -> windows.Symbols:
    joined = b"".join(parts)
    n = len(joined)
    eight = _words(joined + bytes(K), n + K - 7)
    c = series(3, 21) | np.uint64(1)
    grams = mix(eight[:n] * c[0] + eight[8 : n + 8] * c[1] + eight[16 : n + 16] * c[2])
    lengths = np.array([len(x) for x in parts], np.int64)

    def cores(places: np.ndarray) -> np.ndarray:
        core = windows.core_length(K, GRAM)
        at = [*range(0, core - 7, 8), core - 8]
        c = series(len(at), 22) | np.uint64(1)
        return mix(sum((eight[places + d] * x for d, x in zip(at, c, strict=True)), np.zeros(len(places), np.uint64)))

    return grams[: max(0, n - GRAM + 1)], windows.window_starts(lengths, K), np.cumsum(lengths) - lengths, lambda a, b: joined[a:b], cores


def _fingerprints(data: bytes, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    eight = _words(data, len(data) - 7)
    at = [*range(0, K - 7, 8), K - 8]
    out = []
    for seed in (31, 32):
        c = series(len(at), seed) | np.uint64(1)
        out.append(mix(sum((eight[places + d] * x for d, x in zip(at[1:], c[1:], strict=True)), eight[places] * c[0])))
    return out[0], out[1]


def _same(data: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the K bytes at places a and b are equal."""
    eight = _words(data, len(data) - 7)
    left = np.arange(len(a))
    for d in [*range(0, K - 7, 8), K - 8]:
        left = left[eight[a[left] + d] == eight[b[left] + d]]
    out = np.zeros(len(a), bool)
    out[left] = True
    return out


def _settle(rows: dict[str, np.ndarray], packed: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    ids, hs, start, n = rows["id"], rows["h"], rows["start"], rows["n"].astype(np.int64)
    hot, g = rows["hot"], rows["g"]
    # identical strings of a bucket: the earliest stands for them
    seen: dict[tuple[int, int, bytes], int] = {}
    string = np.array([seen.setdefault((a, s, p), len(seen)) for a, s, p in zip(g.tolist(), rows["salt"].tolist(), packed, strict=True)])
    by = np.lexsort((hs, start, ids, string))
    lead = by[np.concatenate(([True], string[by][1:] != string[by][:-1]))]  # in the order of strings
    of = lead[string]
    later = np.flatnonzero((ids > ids[of]) | ((ids == ids[of]) & (start > start[of])))
    spans = [(later, np.zeros(len(later), np.int64), n[later] - 1)]

    # texts to sort: the strings of a bucket, at most LOCAL at a time
    bucket = np.concatenate(([True], (g[lead][1:] != g[lead][:-1]) | (rows["salt"][lead][1:] != rows["salt"][lead][:-1])))
    nth = np.arange(len(lead)) - np.maximum.accumulate(np.where(bucket, np.arange(len(lead)), 0))
    text = np.cumsum(bucket | (nth % SORTED == 0)) - 1
    many = np.bincount(text)[text] > 1
    windows_out: list[np.ndarray] = []
    # windows of these strings are not settled by one sorting
    number = np.cumsum(bucket) - 1
    open_ = np.zeros(len(g), bool)
    open_[lead] = hot[lead] | (np.bincount(number)[number] > SORTED)
    kept = [lead[~many & open_[lead]]] if (~many & open_[lead]).any() else []
    solo = [np.repeat(x, n[x]) for x in kept]
    solo_place = [windows.flat_ranges(np.zeros(len(x), np.int64), n[x]) for x in kept]

    if many.any():
        use, text = lead[many], text[many]
        size = np.array([len(packed[i]) for i in use], np.int64)
        last = np.concatenate((text[1:] != text[:-1], [True]))
        blob = b"".join(packed[i] + (b"\0\0" if z else b"\0") for i, z in zip(use, last, strict=True)) + bytes(8)
        first = np.cumsum(size + 1 + last) - (size + 1 + last)
        symbols = np.frombuffer(blob, np.uint8)[:-8].astype(np.int64) + 2
        symbols[first + size] = 1
        ends = (first + size + 1)[last]
        symbols[ends] = 0
        order = suffix_order(symbols, ends)
        row_of, place_of = np.full(len(symbols), -1, np.int64), np.zeros(len(symbols), np.int64)
        at = windows.flat_ranges(first, n[use])
        row_of[at], place_of[at] = np.repeat(use, n[use]), windows.flat_ranges(np.zeros(len(use), np.int64), n[use])
        order = order[row_of[order] >= 0]
        own = np.repeat(np.arange(len(ends)), np.diff(np.concatenate(([0], ends + 1))))[order]
        equal = (own[1:] == own[:-1]) & _same(blob, order[1:], order[:-1])
        run = np.concatenate(([0], np.cumsum(~equal)))
        r, p = row_of[order], place_of[order]
        when = start[r] + p
        by = np.lexsort((when, ids[r], run))
        head = by[np.concatenate(([True], run[by][1:] != run[by][:-1]))][run]
        behind = (ids[r] > ids[r[head]]) | ((ids[r] == ids[r[head]]) & (when > when[head]))
        flag_order = np.lexsort((p, r))
        spans.append(windows.runs_of(behind[flag_order], r[flag_order], p[flag_order]))
        stays = open_[r] & (head == np.arange(len(r)))
        solo.append(r[stays])
        solo_place.append(p[stays])

    if solo and sum(map(len, solo)):
        w, p = np.concatenate(solo), np.concatenate(solo_place)
        rows_, back = np.unique(w, return_inverse=True)
        blob = b"".join(packed[i] for i in rows_) + bytes(8)
        size = np.array([len(packed[i]) for i in rows_], np.int64)
        f1, f2 = _fingerprints(blob, (np.cumsum(size) - size)[back] + p)
        by = np.lexsort((start[w] + p, ids[w], f2, f1))
        same = (f1[by][1:] == f1[by][:-1]) & (f2[by][1:] == f2[by][:-1])
        new = np.concatenate(([True], ~same))
        head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        first = np.empty(len(w), np.int64)
        first[by] = head
        behind = (ids[w] > ids[w[first]]) | ((ids[w] == ids[w[first]]) & (start[w] + p > start[w[first]] + p[first]))
        in_order = np.lexsort((p, w))
        spans.append(windows.runs_of(behind[in_order], w[in_order], p[in_order]))
        left = hot[w] & ~behind
        w, p, f1, f2 = w[left], p[left], f1[left], f2[left]
        windows_out = [ids[w], hs[w], start[w] + p, start[w] + p, f1.view(np.int64), f2.view(np.int64), np.ones(len(w), bool)]
    r, a, z = (np.concatenate(x) for x in zip(*spans, strict=True))
    return [ids[r], hs[r], start[r] + a, start[r] + z + K], windows_out or [np.zeros(0, np.int64)]


def _across(found: DataFrame) -> DataFrame:
    """Windows that are not the earliest of those left by the buckets."""
    first = found.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "start")).alias("first")).where("n > 1")
    both = found.join(first, ["f1", "f2"])
    return both.where(F.struct("id", "start") > F.col("first")).select("id", "h", "start")


METHOD = windows.Method(K, GRAM, LOCAL, _symbols, _settle, _across, first_stays=True)


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), n_bytes, n_removed, ``removed`` (the
    disjoint byte ranges a, b) and ``kept`` (the bytes that stay)."""
    return _cleaned(windows.named(docs, key, text))


def _cleaned(own: DataFrame) -> DataFrame:
    both = own.join(windows.repeats(own, METHOD), ["id", "h"], "left").select("row", "t", "whole", "spans")
    ranges_as = "array<struct<a:long,b:long>>"
    shape = own.select("row", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.array().cast(ranges_as).alias("removed"), F.lit(b"").alias("kept")).schema
    ranges_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in chunks(batches, "t"):
            gone, removed, kept = [], [], []
            for t, whole, ranges in zip(parts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = windows.to_remove(bool(whole), ranges or [], len(t), K)
                cuts = list(zip(a.tolist(), b.tolist(), strict=True))
                gone.append(sum(y - x for x, y in cuts))
                removed.append([{"a": x, "b": y} for x, y in cuts])
                kept.append(b"".join(t[x:y] for x, y in zip([0, *(y for _, y in cuts)], [*(x for x, _ in cuts), len(t)], strict=True)))
            sizes = pa.array([len(t) for t in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(gone, pa.int64()), pa.array(removed, ranges_type), pa.array(kept, pa.binary())], names=["row", "n_bytes", "n_removed", "removed", "kept"])

    return both.mapInArrow(run, shape)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256."""
    slim = docs.select(F.struct(F.col(key).alias("key")).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    own = _cleaned(windows.named(slim, "key", "text").withColumn("row", F.col("row.row")))
    return own.select(F.col("row.key").alias(key), "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
