"""MinHash near-duplicates with odd sketches.

A document is the set of its distinct word shingles; two are linked if 100 *
intersection >= percent * union. Steps:

1. One pass over the texts gives each document's set size, a 128-bit key of its
   set, its band keys (``ROWS`` MinHash values each) and an odd sketch: all
   MinHash values are folded into ``BITS`` bits, each toggling one bit. The
   number of ones in the XOR of two sketches estimates their similarity, the
   more precisely the higher it is. A second such sketch of all shingles gives a
   strict bound: each one in the XOR is a shingle that only one set has.
2. Documents with the same set are one node, named by the smallest doc_id.
3. In each band bucket every node is paired with one pivot only, at first the
   bucket's smallest node. Pairs whose sizes or sketches rule a link out (six
   standard deviations, or the strict bound) go; the others are confirmed on
   their full sets from their texts. Nodes of the same component are settled; the
   rest of a bucket meets a second pivot, the bucket's node with most links.
4. Where a bucket still holds several components, its nodes outside its largest
   component meet the bucket's nodes of other components, under the same
   conditions, inside the join. So a bucket of n near copies costs some 2 n pairs,
   not n * n, and no link between different sets is lost but by banding itself,
   which misses a linked pair with probability ``MISS`` at most.
5. Connected components give the smallest doc_id reachable.

Defined cases: null, empty or wordless text: empty set, linked with nothing;
fewer words than a shingle: the whole sequence is the only shingle. Rows that
share a doc_id count as one document (linked if any of their texts is). A null
doc_id is linked with nothing and has no component. Extra columns are ignored
by ``classes`` and kept by ``representatives``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import components, small
from corpusmill.llm.tokens import LOWER, SPACED, chunks, mix, rolling, series, spans, texts, word_hashes
from corpusmill.llm.worker import tidy
from corpusmill.session import cut_lineage

ROWS = 5
BITS = 512
MISS = 1e-7
#: Bits of the sketch of all shingles.
FULL_BITS = 1024
SKETCH = [f"s{i}" for i in range(BITS // 64)]
FULL = [f"f{i}" for i in range(FULL_BITS // 64)]


@dataclass(frozen=True)
class Likeness:
    shingle: int = 5
    percent: int = 80

    @property
    def bands(self) -> int:
        """Enough bands that a pair at the threshold meets in one."""
        return math.ceil(math.log(MISS) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def differing(self) -> int:
        """Most differing sketch bits of a linked pair. XORed sketches of k
        samples at similarity j hold BITS / 2 * (1 - exp(-4 k (1 - j) / BITS))
        ones on average; j is taken six standard deviations low, and three of
        the folding's own are added."""
        k, t = self.bands * ROWS, self.percent / 100
        low = t - 6 * math.sqrt(t * (1 - t) / k)
        ones = BITS / 2 * (1 - math.exp(-4 * k * (1 - low) / BITS))
        return math.ceil(ones + 3 * math.sqrt(ones))


def shingle_sets(parts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data = np.frombuffer(b"\n".join(parts).translate(LOWER) + b"\n", np.uint8)
    starts, ends = spans(data, SPACED)
    hashes = word_hashes(data, starts, ends)
    grams = rolling(hashes, shingle)
    at = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in parts]))
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:  # none, or the whole sequence; its length keeps it apart from longer ones
            out.append(rolling(hashes[a:b], int(b - a), 3 + int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of non-empty sets."""
    k, n = bands * ROWS, len(sets)
    at = np.cumsum([0] + [len(x) for x in sets])
    values, low = np.concatenate(sets), np.empty((k, n), np.uint64)
    flips, odds = series(k, 11), series(k, 12) | np.uint64(1)
    first = 0
    while first < n:  # pieces that stay in the processor's cache
        last = max(first + 1, int(np.searchsorted(at, at[first] + 16_384, "right")) - 1)
        piece, starts = values[at[first] : at[last]], at[first:last] - at[first]
        for i in range(k):
            low[i, first:last] = np.minimum.reduceat((piece ^ flips[i]) * odds[i], starts)
        first = last
    number = np.arange(bands, dtype=np.uint64)[:, None]
    keys = np.zeros((bands, n), np.uint64)
    for i in range(ROWS):
        keys = mix(keys + low[i::ROWS] * np.uint64(0x9E3779B97F4A7C15) + number)
    places = (mix(low + np.arange(k, dtype=np.uint64)[:, None] * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(BITS)).astype(np.int64)
    ones = np.bincount((places + np.arange(n)[None, :] * BITS).ravel(), minlength=n * BITS) & 1
    return keys.T, np.packbits(ones.astype(np.uint8).reshape(n, BITS), axis=1).view(np.uint64)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """Odd sketches of whole sets."""
    n = len(sets)
    place = (np.concatenate(sets) & np.uint64(FULL_BITS - 1)).astype(np.int64) + np.repeat(np.arange(n) * FULL_BITS, [len(x) for x in sets])
    ones = np.bincount(place, minlength=n * FULL_BITS) & 1
    return np.packbits(ones.astype(np.uint8).reshape(n, FULL_BITS), axis=1).view(np.uint64)


def _signed(docs: DataFrame, like: Likeness) -> DataFrame:
    """From (id, text): id, n, set, bands, the words of the sketch."""
    schema = "id long, n long, set binary, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH + FULL)
    shingle, bands = like.shingle, like.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in chunks(batches, "text"):
            sets = shingle_sets(parts, shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            keys, sketches = np.zeros((len(sets), bands), np.int64), np.zeros((len(sets), len(SKETCH + FULL)), np.int64)
            if full:
                found = signatures([sets[i] for i in full], bands)
                keys[full] = found[0].view(np.int64)
                sketches[full] = np.hstack((found[1], parities([sets[i] for i in full]))).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * bands, pa.int32()), pa.array(np.ascontiguousarray(keys).ravel())),
                    *[pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(len(SKETCH + FULL))],
                ],
                names=["id", "n", "set", "bands", *SKETCH, *FULL],
            )

    return docs.mapInArrow(tidy(run), schema)


def _alike(like: Likeness, a: str, b: str) -> Column:
    """Whether sizes and sketches of two sides allow a link. With sets of sizes
    na and nb, a link means 100 * (na + nb - u) >= percent * u, so at most
    (na + nb) * (100 - percent) / (100 + percent) shingles differ."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")

    def ones(words: list[str]) -> Column:
        counts = [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in words]
        return sum(counts[1:], counts[0])

    sizes = 100 * F.least(na, nb) >= like.percent * F.greatest(na, nb)
    return sizes & (ones(SKETCH) <= like.differing) & (ones(FULL) * (100 + like.percent) <= (na + nb) * (100 - like.percent))


def confirmed(pairs: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose full sets are alike enough.

    ``docs`` is (id, text). Only the texts of documents in a pair move: their
    ids are broadcast if few, else joined. Both texts of a pair then lie next to
    each other in a partition sorted by pair."""
    sides = cut_lineage(pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id")))
    wanted = cut_lineage(sides.select("id").distinct())
    slim = cut_lineage(docs.join(small(wanted, 1_000_000), "id", "left_semi"))
    both = slim.join(sides, "id").repartition("a", "b").sortWithinPartitions("a", "b").select("a", "b", "id", "text")
    shingle, percent = like.shingle, like.percent

    def judge(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(rows)
        a, b, ids = (held.column(i).to_numpy() for i in range(3))
        names: dict[tuple[int, bytes], int] = {}
        which = [names.setdefault((i, t), len(names)) for i, t in zip(ids.tolist(), texts(held.column(3)), strict=True)]
        sets = shingle_sets([t for _, t in names], shingle)
        out, edge = [], np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True])))
        for lo, hi in zip(edge[:-1], edge[1:], strict=True):
            own = {which[i] for i in range(lo, hi) if ids[i] == a[lo]}
            other = {which[i] for i in range(lo, hi) if ids[i] == b[lo]}
            for x in own:
                for y in other:
                    common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if common and 100 * common >= percent * (len(sets[x]) + len(sets[y]) - common):
                        out.append((int(a[lo]), int(b[lo])))
        out = sorted(set(out))
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch, _ in chunks(batches, "text", 8_000_000):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            same = (a == a[-1]) & (b == b[-1])
            cut = len(a) - int(same.sum())  # the last pair may go on in the next batch
            if cut:
                yield judge([*rest, batch.slice(0, cut)])
                rest = []
            rest.append(batch.slice(cut))
        if rest:
            yield judge(rest)

    return both.mapInArrow(tidy(run), "a long, b long").distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept."""
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    signed = cut_lineage(_signed(own, like))
    usable = signed.where("n > 0 and id is not null")
    sets = cut_lineage(usable.groupBy("set").agg(F.min("id").alias("rep")))  # cut, so that Spark may split the join by a set that many have
    named = cut_lineage(usable.select("id", "set").join(sets, "set").select("id", "rep", "set"))
    nodes = cut_lineage(usable.join(named.where("id = rep").select("id", "set"), ["id", "set"], "left_semi").drop("set"))
    bands = nodes.select("id", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot < last").drop("last")
    members = cut_lineage(bands.join(shared, "band").distinct())
    sketch = nodes.select("id", "n", *SKETCH, *FULL)

    texts_of = own.where("id is not null")

    def links_to(pivots: DataFrame) -> DataFrame:
        """Links among (id, pivot) pairs."""
        stars = pivots.where("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        fits = stars.join(sketch.alias("x"), F.col("a") == F.col("x.id")).join(sketch.alias("y"), F.col("b") == F.col("y.id")).where(_alike(like, "x", "y"))
        return cut_lineage(confirmed(fits.select("a", "b").distinct(), texts_of, like))

    links = links_to(members)
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    held = members.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = held.groupBy("band").agg((F.min("component") < F.max("component")).alias("several")).where("several").drop("several")
    held = cut_lineage(held.join(several, "band"))
    central = held.join(degree, "id").groupBy("band").agg(F.max_by(F.struct("id", "component"), F.struct("links", "id")).alias("c"))
    second = held.join(central, "band").where(F.col("component") != F.col("c.component")).select("id", F.col("c.id").alias("pivot"))
    links = cut_lineage(links.union(links_to(second)))

    found = components(links)
    held = held.drop("component").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = held.groupBy("band", "component").count().groupBy("band").agg(F.max_by("component", "count").alias("largest"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    open_ = cut_lineage(held.join(mixed.drop("kinds"), "band").join(sketch, "id"))
    x, y = open_.where("component <> largest").alias("x"), open_.alias("y")
    met = (
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.component") != F.col("y.component"))
        & (F.col("x.id") != F.col("x.pivot"))
        & (F.col("y.id") != F.col("y.pivot"))
        & ((F.col("y.component") == F.col("y.largest")) | (F.col("x.id") < F.col("y.id")))
        & _alike(like, "x", "y")
    )
    crossed = x.join(y, met).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    more = confirmed(crossed, texts_of, like)

    linked = named.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    whole = components(links.union(more).union(linked).where("a <> b"))
    found = signed.select("id", "n").join(whole, "id", "left")
    component = F.coalesce("component", "id")
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """The rows of ``docs`` that stay, columns unchanged: of each class the
    document with the smallest key, one row of it (the first text in order)."""
    keep = cut_lineage(classes(docs.where(F.col(key).isNotNull()), key, text, like).where("kept").select(F.col(key).alias("_k")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(key).cast("long").alias("_k"), F.col(text).alias("t"))
    first = Window.partitionBy("_k").orderBy("t")
    stay = rows.where("_k is not null").join(keep, "_k", "left_semi").withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return stay.select("row.*").union(rows.where("_k is null").select("row.*"))
