"""Finding windows (runs of ``k`` symbols) that occur more than once in a corpus.

Equal windows have the same minimiser: the gram with the smallest hash among
the window's grams, the leftmost of equals. Consecutive windows that share one
are a super-k-mer and travel as one packed string. Both substring operators use
this way of partitioning and differ in symbols and in how a bucket is settled.

1. Of the symbols of a window outside its minimiser, half or more lie on one
   side. The minimiser with that half on that side is the window's core, so equal
   windows have the same core, and the windows of a super-k-mer have one of two,
   left or right. Cores are counted (partial sums). A window whose core occurs
   once in the corpus occurs once itself. Which cores occur again is kept in a
   bitmap of fixed size (``REPEAT_BITS``); a collision only ships a string that
   was not needed.
2. Super-k-mers, cut in their left and right windows, go to the bucket of their
   core. A core with more than ``local`` occurrences is dealt over as many salted
   buckets as it takes to have about ``local`` in each; the number is kept in a
   table of fixed size.
3. A bucket settles its windows. One that is whole is thereby done. For a
   salted one, each distinct window leaves one row with its 128-bit hash; these
   meet by hash, so a window in all buckets costs one row per bucket, and a
   window found in several is settled across them.

Documents with the same text are set apart before: one stands for them, and all
windows of the others repeat. Their ids are broadcast if few, else joined.

A document is known by its id and the hash of its text, so repeated rows and
rows that share an id are told apart; equal rows share their spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import small
from corpusmill.llm.tokens import chunks, mix
from corpusmill.session import cut_lineage

REPEAT_BITS = 27
SALT_BITS = 20
_AT = np.uint64((1 << 28) - 1)

#: From texts: grams at each symbol, whether a window starts at each symbol, the
#: first symbol of each text, the function that packs symbols [a, b), and the one
#: that hashes as many symbols as a core has from each of some places.
Symbols = tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[int, int], bytes], Callable[[np.ndarray], np.ndarray]]


@dataclass(frozen=True)
class Method:
    k: int
    gram: int
    local: int
    symbols: Callable[[list[bytes]], Symbols]
    #: rows of whole buckets -> (span rows, rows for windows of salted buckets)
    settle: Callable[[dict[str, np.ndarray], list[bytes]], tuple[list[np.ndarray], list[np.ndarray]]]
    #: settles across salted buckets: from (f1, f2, id, h, start, solo) to (id, h, start)
    across: Callable[[DataFrame], DataFrame]
    #: whether the earliest of several occurrences stays
    first_stays: bool


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:]) if len(values) > span else values[:0]
        span *= 2
    rest = width - span
    return (np.minimum(values[:-rest], values[rest:]) if len(values) > rest else values[:0]) if rest else values


def super_kmers(grams: np.ndarray, starts_here: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each super-k-mer and its minimiser's place."""
    where = np.flatnonzero(starts_here)
    if not len(where):
        return where, where, where
    keys = (grams & ~_AT) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(keys, width)[where] & _AT).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
    return where[edge[:-1]], where[edge[1:] - 1], at[edge[:-1]]


def core_length(k: int, gram: int) -> int:
    return gram + (k - gram + 1) // 2


def pieces(symbols: Symbols, k: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each half of a super-k-mer, and its core's hash."""
    grams, ok, _, _, cores = symbols
    a, z, at = super_kmers(grams, ok, k - gram + 1)
    half = (k - gram + 1) // 2
    middle = at - (k - gram - half)  # from here on windows have half of the rest, or more, to the right
    right, left = np.maximum(a, middle) <= z, a <= np.minimum(z, middle - 1)
    first = np.concatenate((np.maximum(a, middle)[right], a[left]))
    last = np.concatenate((z[right], np.minimum(z, middle - 1)[left]))
    hashes = np.concatenate((cores(at[right]), mix(cores(at[left] - half) + np.uint64(1))))
    order = np.argsort(first)
    return first[order], last[order], hashes[order]


def window_starts(lengths: np.ndarray, k: int) -> np.ndarray:
    """For texts of so many symbols, one after the other: where windows start."""
    ok = np.zeros(int(lengths.sum()) + 1, np.int64)
    first = np.cumsum(lengths) - lengths
    full = lengths >= k
    np.add.at(ok, first[full], 1)
    np.add.at(ok, (first + lengths - k + 1)[full], -1)
    return np.cumsum(ok)[:-1] > 0


def flat_ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] of them), first[1], ..."""
    return np.arange(int(count.sum())) + np.repeat(first - (np.cumsum(count) - count), count)


def named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """row (all columns), id (the smallest long for null), h, t."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(key).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(t).alias("h"), t.alias("t"))


def _repeated(own: DataFrame, method: Method) -> tuple[bytes, bytes]:
    """Bitmap of cores that occur again, and table of salt exponents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in chunks(batches, "t", 1_000_000):
            g, n = np.unique(pieces(method.symbols(parts), method.k, method.gram)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((g >> np.uint64(32)).astype(np.uint32).view(np.int32)), pa.array(n)], names=["g", "n"])

    # 32 bits of a hash tell cores apart well enough for tables of 27 bits
    seen = own.select("t").mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 1")
    seen = cut_lineage(seen)
    bits, words = np.zeros(1 << (REPEAT_BITS - 6), np.uint64), "word"
    slot = F.shiftrightunsigned("g", 32 - REPEAT_BITS)
    found = seen.select(F.shiftright(slot, 6).alias(words), F.expr(f"shiftleft(1L, shiftrightunsigned(g, {32 - REPEAT_BITS}) & 63)").alias("bit"))
    got = found.groupBy(words).agg(F.bit_or("bit").alias("bit")).toArrow()  # 2^21 rows at most
    bits[got.column(0).to_numpy()] = got.column(1).to_numpy().view(np.uint64)
    salts = np.zeros(1 << SALT_BITS, np.uint8)
    often = seen.where(F.col("n") > method.local).select(F.col("g").bitwiseAND((1 << SALT_BITS) - 1).alias("slot"), F.ceil(F.log2(F.col("n") / method.local)).cast("int").alias("e"))
    got = often.groupBy("slot").agg(F.max("e").alias("e")).toArrow()  # 2^20 rows at most
    salts[got.column(0).to_numpy()] = np.minimum(got.column(1).to_numpy(), 30)
    return bits.tobytes(), salts.tobytes()


_SHIPPED = "g long, salt int, hot boolean, id long, h long, start long, n int, packed binary"


def _shipped(own: DataFrame, method: Method) -> DataFrame:
    """Super-k-mers of repeated cores: bucket, document, first window, number of
    windows, packed string."""
    tables = own.sparkSession.sparkContext.broadcast(_repeated(own, method))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, salts = (np.frombuffer(x, t) for x, t in zip(tables.value, (np.uint64, np.uint8), strict=True))
        for batch, parts in chunks(batches, "t", 1_000_000):
            symbols = method.symbols(parts)
            first, pack = symbols[2:4]
            a, z, g = pieces(symbols, method.k, method.gram)
            slot = g >> np.uint64(64 - REPEAT_BITS)
            again = ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
            a, z, g = a[again], z[again], g[again]
            text = np.searchsorted(first, a, "right") - 1
            ids, hs = (batch.column(i).to_numpy()[text] for i in (0, 1))
            e = salts[((g >> np.uint64(32)) & np.uint64((1 << SALT_BITS) - 1)).astype(np.int64)].astype(np.uint64)
            salt = mix(ids.view(np.uint64) * np.uint64(31) + hs.view(np.uint64)) & ((np.uint64(1) << e) - np.uint64(1))
            packed = [pack(x, y) for x, y in zip(a.tolist(), (z + method.k).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g.view(np.int64)),
                    pa.array(salt.astype(np.int32)),
                    pa.array(e > 0),
                    pa.array(ids),
                    pa.array(hs),
                    pa.array(a - first[text]),
                    pa.array((z - a + 1).astype(np.int32)),
                    pa.array(packed, pa.binary()),
                ],
                names=["g", "salt", "hot", "id", "h", "start", "n", "packed"],
            )

    return own.select("id", "h", "t").mapInArrow(cut, _SHIPPED)


_SETTLED = "window boolean, id long, h long, a long, b long, f1 long, f2 long, solo boolean"
#: Packed bytes settled at once.
_PIECE = 3_000_000


def _settled(shipped: DataFrame, method: Method) -> DataFrame:
    """Span rows (id, h, a, b: symbols [a, b) repeat) and window rows of salted
    buckets (id, h, a: start; 128-bit hash; solo: found once in the bucket)."""
    buckets = shipped.repartition("g", "salt").sortWithinPartitions("g", "salt")

    def settle(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(rows).combine_chunks()
        columns = {c: held.column(c).to_numpy() for c in ("g", "salt", "hot", "id", "h", "start", "n")}
        spans, windows = method.settle(columns, held.column("packed").to_pylist())
        for is_window, part in ((False, spans), (True, windows)):
            if len(part[0]):
                n = len(part[0])
                full = [*part, *([np.zeros(n, np.int64)] * 2 + [np.zeros(n, bool)] if not is_window else [])]
                names = ("id", "h", "a", "b", "f1", "f2", "solo")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, is_window)), *map(pa.array, full)], names=["window", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        size = 0
        for batch, _ in chunks(batches, "packed", _PIECE):
            rest.append(batch)
            size += batch.nbytes
            if size < _PIECE:
                continue
            g, hot = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            cut = len(g) if hot[-1] else len(g) - int((g == g[-1]).sum())  # a whole bucket may go on
            if cut:
                yield from settle([*rest[:-1], batch.slice(0, cut)])
                rest, size = ([batch.slice(cut)], batch.slice(cut).nbytes) if cut < len(g) else ([], 0)
        if rest:
            yield from settle(rest)

    return buckets.mapInArrow(run, _SETTLED)


def repeats(own: DataFrame, method: Method) -> DataFrame:
    """From ``named`` documents: (id, h, whole, spans), what to remove of those
    that repeat: all of a text that has a window, or ranges (a, b) of symbols,
    ascending, which may overlap."""
    keyed = own.select("id", "h", F.md5("t").alias("m"))
    same = cut_lineage(keyed.groupBy("m").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    copies = cut_lineage(keyed.join(small(same, 500_000), "m").select("id", "h", (F.col("id") > F.col("first")).alias("later")).distinct())
    later = cut_lineage(copies.where("later").select("id", "h"))
    others = own.join(small(later, 500_000), ["id", "h"], "left_anti")
    settled = cut_lineage(_settled(_shipped(others, method), method))
    whole = settled.where("not window").select("id", "h", "a", "b")
    far = method.across(settled.where("window").select("f1", "f2", "id", "h", F.col("a").alias("start"), "solo"))
    found = whole.union(far.select("id", "h", F.col("start").alias("a"), (F.col("start") + method.k).alias("b")))
    gone = later if method.first_stays else copies.select("id", "h")
    every = found.select("id", "h", F.lit(False).alias("whole"), F.struct("a", "b").alias("s")).union(gone.select("id", "h", F.lit(True), F.lit(None)))
    by_document = every.groupBy("id", "h").agg(F.max("whole").alias("whole"), F.sort_array(F.collect_list("s")).alias("spans"))
    spans = cut_lineage(by_document.mapInArrow(_joined, by_document.schema))
    # texts stay where they are if the ranges of all documents are few
    ranges = spans.agg(F.sum(F.size("spans"))).first()[0] or 0
    return small(spans, 300_000) if ranges <= 1_000_000 else spans


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the overlapping ranges of each row."""
    for batch in batches:
        lists = batch.column(3)
        flat, count = lists.flatten(), np.diff(lists.offsets.to_numpy())
        a, b = (flat.field(i).to_numpy() for i in (0, 1))
        row = np.repeat(np.arange(len(count)), count)
        # rows are kept apart by a stride longer than any text
        stride = int(b.max(initial=0)) + 2
        a, b = merged(a + row * stride, b + row * stride)
        row = a // stride
        ranges = pa.StructArray.from_arrays([pa.array(a - row * stride), pa.array(b - row * stride)], names=["a", "b"])
        offsets = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(count))))).astype(np.int32)
        joined = pa.ListArray.from_arrays(pa.array(offsets), ranges)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], joined], names=batch.schema.names)


def to_remove(whole: bool, spans: list, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges of symbols of a text with ``n`` of them."""
    if whole:
        return (np.array([0]), np.array([n])) if n >= k else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return merged(np.array([r["a"] for r in spans], np.int64), np.array([r["b"] for r in spans], np.int64))


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges covering ranges sorted by start."""
    if not len(a):
        return a, b
    end = np.maximum.accumulate(b)
    edge = np.flatnonzero(np.concatenate(([True], a[1:] > end[:-1])))
    return a[edge], end[np.concatenate((edge[1:] - 1, [len(a) - 1]))]


def runs_of(flag: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of each run of flagged consecutive places."""
    row, place = row[flag], place[flag]
    if not len(row):
        return row, place, place
    edge = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1), [True])))
    return row[edge[:-1]], place[edge[:-1]], place[edge[1:] - 1]
