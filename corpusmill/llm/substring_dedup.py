"""Removal of repeated passages by super-k-mer partitioning.

A window is ``K`` consecutive white-space separated words of one document. Every
word covered by a window that occurs anywhere else, in the same document or
another, is removed; all occurrences count, judged on the input.

Consecutive windows sharing a minimiser travel as one packed string of words to
its bucket (see ``windows``). A bucket sorts the 128-bit hashes of its windows'
words and finds those that occur more than once.

Defined cases: null or blank text has no words; a text of fewer than ``K``
words has no window; repeated rows repeat each other's windows and lose them
all; extra columns are kept by ``cleaned``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import windows
from corpusmill.llm.tokens import SPACED, chunks, per_text, rolling, spans, word_hashes

K = 35
GRAM = 4
#: Occurrences of a core that one bucket takes whole.
LOCAL = 2048


def _symbols(parts: list[bytes]) -> windows.Symbols:
    joined = b"\n".join(parts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    starts, ends = spans(data, SPACED)
    hashes = word_hashes(data, starts, ends)
    grams, cores = rolling(hashes, GRAM), rolling(hashes, windows.core_length(K, GRAM), 4)
    first = per_text(starts, parts)
    ok = windows.window_starts(np.diff(first), K)

    def pack(a: int, b: int) -> bytes:
        return joined[starts[a] : ends[b - 1]]

    return grams, ok, first[:-1], pack, lambda places: cores[places]


def _settle(rows: dict[str, np.ndarray], packed: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Windows of the buckets at hand, counted by sorting."""
    g, hot = rows["g"], rows["hot"]
    alone = np.ones(len(g), bool)  # a string by itself in its bucket has nothing to meet
    alone[1:] &= g[1:] != g[:-1]
    alone[:-1] &= g[1:] != g[:-1]
    use = np.flatnonzero(~alone | hot)
    parts = [packed[i] for i in use]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    starts, ends = spans(data, SPACED)
    n = rows["n"][use].astype(np.int64)
    at = windows.flat_ranges(per_text(starts, parts)[:-1], n)
    row, place = np.repeat(use, n), windows.flat_ranges(np.zeros(len(n), np.int64), n)
    f1, f2 = (rolling(word_hashes(data, starts, ends, i), K, 5 + i)[at] for i in (0, 1))
    order = np.lexsort((f2, f1))
    same = (f1[order][1:] == f1[order][:-1]) & (f2[order][1:] == f2[order][:-1])
    again, first = np.zeros(len(order), bool), np.ones(len(order), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    first[order[1:]] &= ~same
    at_row, a, z = windows.runs_of(again, row, place)
    base = rows["start"]
    found = [rows["id"][at_row], rows["h"][at_row], base[at_row] + a, base[at_row] + z + K]
    send = hot[row] & first  # one row per distinct window
    r = row[send]
    start = base[r] + place[send]
    return found, [rows["id"][r], rows["h"][r], start, start, f1[send].view(np.int64), f2[send].view(np.int64), ~again[send]]


def _across(found: DataFrame) -> DataFrame:
    """Windows found once in their bucket but also in another one."""
    twice = found.groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return found.where("solo").join(twice, ["f1", "f2"], "left_semi").select("id", "h", "start")


METHOD = windows.Method(K, GRAM, LOCAL, _symbols, _settle, _across, first_stays=False)


def cleaned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), n_words, n_removed, and ``kept``, the
    words that stay, one space apart."""
    return _cleaned(windows.named(docs, key, text))


def _cleaned(own: DataFrame) -> DataFrame:
    both = own.join(windows.repeats(own, METHOD), ["id", "h"], "left").select("row", "t", "whole", "spans")
    shape = own.select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("t").alias("kept")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts in chunks(batches, "t"):
            total, gone, kept = [], [], []
            for t, whole, ranges in zip(parts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = t.split()
                total.append(len(words))
                if whole is not None:
                    a, b = windows.to_remove(whole, ranges, len(words), K)
                    stay = np.ones(len(words), bool)
                    stay[windows.flat_ranges(a, b - a)] = False
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept"])

    return both.mapInArrow(run, shape)


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256."""
    slim = docs.select(F.struct(F.col(key).alias("key")).alias("row"), F.col(key).alias("key"), F.col(text).alias("text"))
    own = _cleaned(windows.named(slim, "key", "text").withColumn("row", F.col("row.row")))
    return own.select(F.col("row.key").alias(key), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
