"""Words of many texts at once, as numpy arrays.

Texts are joined as UTF-8 with a byte that is no word byte; a word is a run of
word bytes. Hashes are 64-bit sums of per-byte random values times powers of an
odd constant, mixed; the word's length takes part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Space, \t, \n, \x0B, \f, \r part words; all else is in a word.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64 bits."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def series(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(0x9E3779B97F4A7C15))


_BYTES = [series(256, 1), series(256, 2)]
_ODD = [_U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)]


def spans(data: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = word[data]
    edge = np.flatnonzero(np.diff(inside))
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    lens = ends - starts
    if not len(lens):
        return np.zeros(0, _U)
    first = np.cumsum(lens) - lens
    rel = np.arange(int(lens.sum())) - np.repeat(first, lens)
    powers = np.full(int(lens.max()), _ODD[which], _U)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    values = _BYTES[which][data[rel + np.repeat(starts, lens)]] * powers[rel]
    return mix(np.add.reduceat(values, first) + lens.astype(_U) * _U(0x9E3779B97F4A7C15))


def rolling(hashes: np.ndarray, k: int, seed: int = 3) -> np.ndarray:
    """Hash of each run of ``k`` consecutive hashes."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for j, c in enumerate(series(k, seed) | _U(1)):
        total += hashes[j : j + n] * c
    return mix(total)


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8, empty for null."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterable[pa.RecordBatch], text: str, most: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut into pieces of about ``most`` bytes of text (one text at
    least), with their texts."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        at, size, out = 0, 0, []
        for i, x in enumerate(texts(column)):
            out.append(x)
            size += len(x)
            if size >= most:
                yield batch.slice(at, i + 1 - at), out
                at, size, out = i + 1, 0, []
        if out:
            yield batch.slice(at), out


def per_text(starts: np.ndarray, parts: list[bytes]) -> np.ndarray:
    """Index of the first word of each text (and the end), for texts joined by
    one separator byte each."""
    offsets = np.cumsum([0] + [len(x) + 1 for x in parts])
    return np.searchsorted(starts, offsets)
