"""SentencePiece encoding and decoding with a batched Viterbi search in numpy.

A text is cut into words at its spaces (no piece of a usable model spans the end
of a word). Words of equal length form a matrix of characters and advance
together: from each position all substrings are hashed step by step, the hashes
probe the sorted keys of the pieces, and for each position the best of the
pieces that end there is stored with its length as backpointer.

For a unigram model the best is the largest sum of scores. In a BPE model a
piece may follow another only if merging by score would leave the boundary
between them; this is decided for pairs of pieces by taking their merges back,
latest first, so the search finds the segmentation that merging gives, whose
ids are those of the sentencepiece library. Only runs of several spaces, whose
pieces have equal scores, are merged directly.

Characters without a piece become byte pieces, if the model has them, else the
unknown piece. Decoding joins the pieces' bytes and is exact (with byte pieces)
for every text without the sign that stands for the space, U+2581; that one
comes back as a space, as in the library.

A worker keeps the words it encoded last, twice ``CACHE`` and a piece of text at
most.

Defined cases: a null text has null ids and decodes to null; an empty text has
no ids; repeated rows are each encoded; extra columns are kept by ``encoded``,
unless they are named like a result (``ids``), which then wins; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2

from corpusmill.llm.common import apart, together
from corpusmill.llm.tokens import chunks, mix
from corpusmill.llm.worker import only, tidy

CACHE = 120_000
SPACE = "▁"
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LOW = _U((1 << 20) - 1)
_NONE = np.iinfo(np.int64).max
#: Characters of all words of a matrix.
_CELLS = 100_000


class Pieces:
    """A model's pieces, as arrays for the search."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without normalisation of texts are supported")
        kind = model.SentencePiece
        self.prefix = spec.add_dummy_prefix
        self.bpe = model.trainer_spec.model_type == model.trainer_spec.BPE
        names = [p.piece for p in model.pieces]
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == kind.UNKNOWN), 0)
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
        #: what each id decodes to
        self.out = [b"" if p.type == kind.CONTROL else p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for b, i in self.bytes.items():
            self.out[i] = bytes([b])
        usable = {names[i]: i for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        if any(SPACE in n.lstrip(SPACE) for n in usable):
            raise ValueError("pieces that go on after the end of a word are not supported")
        score = {n: model.pieces[i].score for n, i in usable.items()}
        self.score_of = score
        if self.bpe:
            usable = self._merges(usable, score)
        self.ids = usable
        self.longest = max(map(len, usable), default=1)
        order = list(usable)
        keys = np.array([_hash(n) for n in order], _U)
        at = np.argsort(keys)
        self.keys = keys[at]
        self.values = np.array([usable[n] for n in order], np.int64)[at]
        #: low bits of the keys, so that most substrings need no search
        self.low = np.zeros(1 << 20, bool)
        self.low[(self.keys & _LOW).astype(np.int64)] = True
        self.scores = np.full(len(names) + 1, min(score.values(), default=0.0) - 10.0)
        for n, i in usable.items():
            self.scores[i] = score[n]

    def _merges(self, usable: dict[str, int], score: dict[str, float]) -> dict[str, int]:
        """Ranks and last merges of the pieces that merging can reach.

        Rank 0 stands for a character without a piece; characters come next,
        then merged pieces, best score first."""
        singles = [n for n in usable if len(n) == 1]
        merged = sorted((n for n in usable if len(n) > 1), key=lambda n: (-score[n], len(n), n))
        ranked = [*singles, *merged]
        rank = {n: r for r, n in enumerate(ranked, 1)}
        n = len(ranked) + 1
        self.rank_of = np.zeros(max(usable.values(), default=0) + 2, np.int64)
        self.head, self.tail = np.arange(n), np.arange(n)
        reached = dict.fromkeys(singles, True)
        pairs: dict[int, int] = {}
        for name in ranked:
            self.rank_of[usable[name]] = rank[name]
            for cut in range(1, len(name)):
                a, b = name[:cut], name[cut:]
                if a in rank and b in rank:
                    pairs[(rank[a] << 32) | rank[b]] = rank[name]
        for name in merged:
            last = self.merge(name, score, below=rank[name], rank=rank)
            if len(last) == 2 and all(x in reached for x in last):
                reached[name] = True
                self.head[rank[name]], self.tail[rank[name]] = rank[last[0]], rank[last[1]]
        keys = np.array(sorted(pairs), np.int64)
        self.seen_pairs, self.seen = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, bool)
        self.pair_keys, self.pair_ranks = keys, np.array([pairs[k] for k in keys.tolist()], np.int64)
        return {x: usable[x] for x in ranked if x in reached}

    @staticmethod
    def merge(word: str, score: dict[str, float], below: int | None = None, rank: dict[str, int] | None = None) -> list[str]:
        """Merges neighbours by score, the leftmost of equals first."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        queue: list[tuple[float, int, str, str]] = []

        def ask(i: int, j: int) -> None:
            both = parts[i] + parts[j]
            s = score.get(both)
            if s is not None and (below is None or rank[both] < below):
                heappush(queue, (-s, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            ask(i, i + 1)
        while queue:
            _, i, left, right = heappop(queue)
            j = after[i]
            if parts[i] != left or j == len(parts) or parts[j] != right:
                continue  # one of the two was merged since
            parts[i], parts[j], after[i] = left + right, None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
                ask(i, after[j])
            if before[i] >= 0:
                ask(before[i], i)
        return [x for x in parts if x is not None]

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Ids of substrings by their hashes, -1 where there is no such piece."""
        out = np.full(len(keys), -1, np.int64)
        maybe = np.flatnonzero(self.low[(keys & _LOW).astype(np.int64)])
        some = keys[maybe]
        at = np.searchsorted(self.keys, some)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == some
        out[maybe[hit]] = self.values[at[hit]]
        return out

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging leaves the boundary between two pieces (by rank).
        The pairs asked last are kept, one for each slot of a fixed table."""
        asked = (left << 32) | right
        slot = (mix(asked.view(_U)) & _U(len(self.seen) - 1)).astype(np.int64)
        out, new = self.seen[slot], np.flatnonzero(self.seen_pairs[slot] != asked)
        if len(new):
            out[new] = self._apart(asked[new])
            self.seen_pairs[slot[new]], self.seen[slot[new]] = asked[new], out[new]
        return out

    def _apart(self, asked: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(asked, return_inverse=True)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        ok, open_ = np.zeros(len(pairs), bool), np.arange(len(pairs))
        limit = np.full(len(pairs), _NONE)
        while len(open_):
            key = (a << 32) | b
            at = np.searchsorted(self.pair_keys, key)
            at[at == len(self.pair_keys)] = 0
            joined = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE) if len(self.pair_keys) else np.full(len(key), _NONE)
            lost = joined < limit
            # take back the later of the two sides' last merges; where it is a character, the other's
            end_a, start_b = self.tail[a], self.head[b]
            first = a > b
            undo_a = np.where(first, end_a != a, (start_b == b) & (end_a != a))
            undo_b = np.where(first, (end_a == a) & (start_b != b), start_b != b)
            done = ~undo_a & ~undo_b
            ok[open_[done & ~lost]] = True
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, end_a, a), np.where(undo_b, start_b, b)
            go = ~lost & ~done
            a, b, limit, open_ = a[go], b[go], limit[go], open_[go]
        return ok[back]


def _hash(name: str) -> int:
    h = np.zeros(1, _U)
    for c in name:
        h = (h + _U(ord(c) + 1)) * _BASE
    return int(mix(h)[0])


def _viterbi(pieces: Pieces, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of pieces of each word, and all words' pieces (-1: a character
    without one) and their lengths. Words of at most ``width`` characters are
    padded to it."""
    n = len(words)
    data = np.frombuffer("".join([w.ljust(width, "\0") for w in words]).encode("utf-32-le"), np.uint32).reshape(n, width).T.astype(_U) + _U(1)
    # found[i][k]: piece of k + 1 characters from i; all lengths from a place are hashed step by step
    longest = min(pieces.longest, width)
    found = np.full((width, longest, n), -1, np.int64)
    h = np.zeros((width, n), _U)
    for k in range(longest):
        h = (h[: width - k] + data[k:]) * _BASE
        found[: width - k, k] = pieces.probe(mix(h).ravel()).reshape(width - k, n)
    best = np.full((width + 1, n), -np.inf)
    best[0] = 0
    length, last = np.ones((width + 1, n), np.int64), np.full((width + 1, n), -1, np.int64)
    for j in range(1, width + 1):
        # the pieces that end here, for all lengths at once
        size, row = np.nonzero(found[j - 1 - np.arange(min(longest, j)), np.arange(min(longest, j))] >= 0)
        # a character may stand alone, with a piece or without
        size, row = np.concatenate((size[size > 0], np.zeros(n, np.int64))), np.concatenate((row[size > 0], np.arange(n)))
        start = j - size - 1
        piece, before = found[start, size, row], best[start, row]
        ok = before > -np.inf
        if pieces.bpe:
            inner = np.flatnonzero(ok & (start > 0))
            prior = last[start[inner], row[inner]]
            left = pieces.rank_of[prior] * (prior >= 0)
            right = pieces.rank_of[piece[inner]] * (piece[inner] >= 0)
            ok[inner] = pieces.apart(left, right)
        size, row, start, piece = size[ok], row[ok], start[ok], piece[ok]
        value = np.zeros(len(row)) if pieces.bpe else before[ok] + pieces.scores[piece]
        order = np.lexsort((-size, value, row)) if not pieces.bpe else np.argsort(row, kind="stable")
        top = order[np.flatnonzero(np.append(row[order][1:] != row[order][:-1], True))]
        best[j, row[top]], length[j, row[top]], last[j, row[top]] = value[top], size[top] + 1, piece[top]
    # backpointers of all words at once, last piece first
    at = np.array([len(w) for w in words], np.int64)
    alive, steps = np.flatnonzero(at > 0), []
    while len(alive):
        place = at[alive]
        steps.append((alive, last[place, alive], length[place, alive]))
        at[alive] = place - length[place, alive]
        alive = alive[at[alive] > 0]
    word, ids, sizes = (np.concatenate([s[i] for s in reversed(steps)]) if steps else np.zeros(0, np.int64) for i in range(3))
    order = np.argsort(word, kind="stable")
    return np.bincount(word, minlength=n), ids[order], sizes[order]


class Codec:
    """Encodes and decodes with one model."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        #: words of late, and those of before
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, word: str, ids: list[int], ends: list[int]) -> bytes:
        p, out, start = self.pieces, [], 0
        for i, end in zip(ids, ends, strict=True):
            if i >= 0:
                out.append(i)
            elif p.bytes:
                out += [p.bytes[b] for b in word[start:end].encode()]
            elif not out or out[-1] != p.unknown:
                out.append(p.unknown)
            start = end
        return np.array(out, "<i4").tobytes()

    def learn(self, words: list[str]) -> None:
        by_width: dict[int, list[str]] = {}
        for w in words:
            if self.pieces.bpe and SPACE * 2 in w:  # equal scores: merged directly
                parts = self.pieces.merge(w, self.pieces.score_of)
                ends = np.cumsum([len(x) for x in parts]).tolist()
                self.known[w] = self._whole(w, [self.pieces.ids.get(x, -1) for x in parts], ends)
            else:
                n = len(w)
                width = n if n <= 12 else -(-n // 4) * 4 if n <= 32 else 1 << (n - 1).bit_length()
                by_width.setdefault(width, []).append(w)
        for width, group in by_width.items():
            step = max(1, _CELLS // width)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                count, ids, sizes = _viterbi(self.pieces, part, width)
                ends = np.cumsum(count)
                data = ids.astype("<i4").tobytes()
                cuts = (4 * np.concatenate(([0], ends))).tolist()
                self.known.update(zip(part, [data[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
                for r in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), "right")).tolist():
                    a, b = cuts[r] // 4, cuts[r + 1] // 4
                    self.known[part[r]] = self._whole(part[r], ids[a:b].tolist(), np.cumsum(sizes[a:b]).tolist())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [_split((SPACE if self.pieces.prefix and t else "") + t.replace(" ", SPACE)) for t in texts]
        if len(self.known) > CACHE:  # what was asked since the last time stays
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = list({w for words in split for w in words if w not in known})
        known.update({w: old[w] for w in new if w in old})
        self.learn([w for w in new if w not in old])
        return [b"".join([known[w] for w in words]) for words in split]

    def rest(self) -> None:
        """Between tasks only the words of late stay, ``CACHE`` at most."""
        self.old = {}
        if len(self.known) > CACHE:
            self.known = {}

    def decode(self, ids: np.ndarray) -> str:
        out = self.pieces.out
        text = b"".join([out[i] for i in ids.tolist()]).decode(errors="replace")
        return text[1:] if self.pieces.prefix and text.startswith(" ") else text


_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _split(text: str) -> list[str]:
    return _UNITS.findall(text)


def codec(path: str) -> Codec:
    """The worker's codec of a model."""
    return only(("codec", path), lambda: Codec(path))


def _step(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as a step whose worker keeps the codec, but no more than ``CACHE`` words."""
    return tidy(run, ("codec", path), lambda: codec(path).rest())


def _lists(found: list[bytes], given: pa.Array) -> pa.Array:
    """Ids as lists, null where there was no text."""
    offsets = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")), mask=given.is_null())


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``ids``, an array of ints (null for null)."""
    kept = [c for c in docs.columns if c != "ids"]
    wide = docs.select(apart(docs, text, kept), F.col(text).alias("t"))
    shape = StructType([*wide.schema, StructField("ids", ArrayType(IntegerType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, parts in chunks(batches, "t", 1_000_000):
            found = own.encode([p.decode() for p in parts])
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(found, batch.column(1))], names=["row", "t", "ids"])

    return wide.mapInArrow(_step(run, path), shape).select(*together(text, kept), "ids")


def decoded(tokens: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns of ``tokens`` and ``decoded``, the text of the ids."""
    wide = tokens.select(F.struct(*[c for c in tokens.columns if c != "decoded"]).alias("row"), F.col(ids).cast("array<int>").alias("i"))
    shape = StructType([wide.schema["row"], StructField("decoded", StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            column = batch.column(1)
            texts = [None if x is None else own.decode(x.values.to_numpy(zero_copy_only=False)) for x in map(lambda s: s if s.is_valid else None, column)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "decoded"])

    return wide.mapInArrow(_step(run, path), shape).select("row.*", "decoded")


def report(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, ids, and whether the ids decode to the text.
    One Python step does both ways, so a task needs one worker with one model."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    shape = StructType([slim.schema["key"], StructField("ids", ArrayType(IntegerType())), StructField("exact", BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch, parts in chunks(batches, "t", 1_000_000):
            found = own.encode([p.decode() for p in parts])
            same = [own.decode(np.frombuffer(x, "<i4")).encode() == p for x, p in zip(found, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(found, batch.column(1)), pa.array(same)], names=["key", "ids", "exact"])

    found = slim.mapInArrow(_step(run, path), shape)
    return found.select(F.col("key").alias(key), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "exact")
