"""Importance resampling towards a target distribution of hashed n-grams.

A 256-byte table lower-cases A-Z and blanks all other ASCII that is neither
letter nor digit, ``bytes.split`` yields the words, and the CRC-32 of an n-gram
is that of its first words with one more word chained on. Features are counted
in Counters by bucket. Two passes over the texts: the first adds up the buckets
of the corpus and of the target (a task sends one row per bucket), the second
weighs every document by the gains of its buckets. A document's draw is its
weight plus Gumbel noise from a hash of its id, so the highest scores are a
sample without replacement, and reruns agree. Ranks come from sorted range
partitions.

Only bucket counts (``BUCKETS`` rows) pass through the driver.

Defined cases: null, empty or wordless texts have no features and weight 0; a
null id is hashed as an empty one; equal scores rank by id, null ids last, and
repeated rows are ranked each; an empty corpus or target counts as zero
features; extra columns are kept by ``drawn`` and ignored by ``report``.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.ranking import numbered
from corpusmill.llm.tokens import LOWER, chunks
from corpusmill.session import work_folder

BUCKETS = 10_000
#: Words of which a worker remembers the bucket.
REMEMBERED = 200_000

FOLD = bytes(LOWER[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Buckets(dict):
    """Buckets of words; forgets them all when it holds too many."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = zlib.crc32(word) % self.buckets
        return found


def features(text: bytes, known: Buckets, most: int = 1) -> tuple[int, Counter[int]]:
    """Number of words, and how often each bucket is hit by the n-grams of 1 to
    ``most`` words."""
    words = text.translate(FOLD).split()
    found: Counter[int] = Counter()
    for word, n in Counter(words).items():
        found[known[word]] += n
    seeds = [zlib.crc32(w) for w in words] if most > 1 else []
    for n in range(2, most + 1):
        seeds = [zlib.crc32(w, zlib.crc32(b" ", seed)) for seed, w in zip(seeds, words[n - 1 :], strict=False)]
        found.update(seed % known.buckets for seed in seeds)
    return len(words), found


def totals(df: DataFrame, text: str = "text", most: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums = Buckets(buckets), np.zeros(buckets, np.int64)
        for _, parts in chunks(batches, "t"):
            found: Counter[int] = Counter()
            for part in parts if most > 1 else [b" ".join(parts)]:
                found.update(features(part, known, most)[1])
            sums[list(found)] += np.fromiter(found.values(), np.int64, len(found))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(sums[some])], names=["bucket", "n"])

    counted = df.select(F.col(text).alias("t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counted.collect():  # at most one row per bucket
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousand times the log of the smoothed ratio of target to source, floored."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    ratio = [float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n)) for s, t in zip(source.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def noise(key: object, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """Per row: key, n_words, n_features, weight, score."""
    gain = gains(totals(docs, text, most, buckets), totals(target, target_text, most, buckets)).tolist()
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, by_bucket = Buckets(buckets), shared.value
        for batch, parts in chunks(batches, "t"):
            found = [features(p, known, most) for p in parts]
            weight = [sum(by_bucket[b] * n for b, n in c.items()) for _, c in found]
            score = [w + noise(k, seed) for w, k in zip(weight, batch.column(0).to_pylist(), strict=True)]
            columns = ([n for n, _ in found], [c.total() for _, c in found], weight, score)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=["key", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long, score long")


def report(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, key: str = "doc_id", **options: object) -> DataFrame:
    """Per row: key, n_features, weight, score, rank (null if not drawn), n_words.

    Of the rows with ``least_words`` words, ``percent`` of a hundred are drawn."""
    spark, folder = docs.sparkSession, work_folder(docs.sparkSession)
    found = scored(docs, target, key, **options)
    found.write.parquet(folder)
    found = spark.read.schema(found.schema).parquet(folder)
    enough = F.col("n_words") >= least_words
    draws = percent * found.where(enough).count() // 100
    order = [F.when(enough, 0).otherwise(1), F.col("score").desc(), F.col("key").asc_nulls_last()]
    place = F.col("place")
    rank = F.when(enough & (place < draws), place + 1)
    return numbered(found, order, "place").select(F.col("key").alias(key), "n_features", "weight", "score", rank.alias("rank"), "n_words")


def drawn(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, key: str = "doc_id", **options: object) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, columns unchanged."""
    ids = report(docs, target, percent, least_words, key, **options).where("rank is not null").select(F.col(key).alias("_drawn")).distinct()
    return docs.join(ids, docs[key].eqNullSafe(F.col("_drawn")), "left_semi")
