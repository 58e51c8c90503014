"""Token ids in binary shards, each document compressed with a shared dictionary.

A shard is one binary value; shards are rows of a Parquet table that Spark
writes and reads, so any store Spark can reach will do. Layout of a shard, all
little-endian::

    magic (8) | width (u4) | documents n (u4) | SHA-256 of the dictionary (32)
    | document ids (i8 * n) | token counts (u4 * n) | frame offsets (u8 * (n+1)) | frames

A frame is the zstandard compression of one document's ids (2 or 4 bytes each,
by the vocabulary's size) with the dictionary, so one document can be read
without its neighbours: find its shard by the table's first_id and last_id, its
frame by the offset index. The dictionary is a table next to the shards, and
its hash is checked on reading.

The dictionary is trained on a bounded sample (``SAMPLE`` texts chosen by the
hash of their ids, ``SAMPLE_CHARS`` characters of each); everything else covers
all documents, whole. Texts are sorted by id (range partitions) before they are
encoded, since texts are smaller than ids; the ids before a document are the sum
over the partitions before, its partition's shards before, and its shard's
documents before.

Encoding is that of the tokenizers library. A byte-level vocabulary never joins
over certain places, such as a space between words; texts whose places are all
of the common kinds are parted there by numpy, and every distinct part is
encoded once per worker and looked up by its 64-bit hash. Texts with anything
else in them, and other vocabularies, are encoded whole.

Defined cases: null text counts as empty and has the end id only; a null id is
written as the smallest long, comes first and is read back as null; repeated
rows are written as often as they come, in the order of their texts; an empty
table gives an empty file set; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm.common import small
from corpusmill.llm.tokens import chunks, word_hashes
from corpusmill.llm.windows import flat_ranges
from corpusmill.llm.worker import only, tidy

MAGIC = b"CMIDS\x00\x00\x01"
SAMPLE, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 8_000, 64 * 1024
SHARD_DOCS, SHARD_BYTES = 4096, 4 << 20
LEVEL = 3
NULL_ID = -(2**63)
#: Parts kept by a worker.
CACHE = 600_000
#: Bytes of text encoded at once: the more, the fewer parts are distinct in it.
STEP = 4_000_000


# Kinds of bytes in texts that are parted here. Of other characters
# only the Latin letters from U+00C0 to U+024F are known, in two bytes each.
_LETTER, _DIGIT, _SIGN, _GAP, _LINE, _OTHER = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[0xC3:0xCA] = _LETTER
_KIND[32], _KIND[10] = _GAP, _LINE


# The characters that stand for bytes in a byte-level vocabulary: printable ones for
# themselves, the others from U+0100 on in order.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_NAMES = np.arange(256, dtype="<u4")
_NAMES[[b for b in range(256) if b not in _PLAIN]] = np.arange(256, 512 - len(_PLAIN))
_NAMES[0] = 0  # parts the parts here


def part(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For texts joined by a zero byte: where the parts start in which the
    vocabulary encodes them (the zero bytes are parts too), and places that are
    not understood, so that their texts must be encoded whole."""
    data = np.frombuffer(joined, np.uint8)
    kind = _KIND[data]
    lead = np.flatnonzero(data >= 0xC3)
    lead = lead[lead + 1 < len(data)]
    follow = data[lead + 1]
    good = (data[lead] < 0xCA) & ((data[lead] != 0xC3) | ((follow != 0x97) & (follow != 0xB7))) & ((data[lead] != 0xC9) | (follow < 0x90))
    kind[lead[good] + 1] = _LETTER
    odd = kind == _OTHER
    odd[lead[~good]] = True
    odd &= data != 0
    white = (kind == _GAP) | (kind == _LINE)
    odd[:-1] |= white[:-1] & (white[1:] | (data[1:] == 0))  # only single white space inside a text
    odd[1:] |= (data[1:] == 124) & (data[:-1] == 60)  # may be a special token

    start = np.ones(len(data), bool)
    start[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != _GAP)
    start[white] = True
    start[1:] |= (data[1:] == 0) | (data[:-1] == 0)
    # 's 't 'm 'd 're 've 'll are parts
    quote = np.flatnonzero((data == 39) & start)
    quote = quote[quote + 3 < len(data)]
    a, b = data[quote + 1], data[quote + 2]
    two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
    one = (a == 115) | (a == 116) | (a == 109) | (a == 100)
    for at, n in ((quote[one], 2), (quote[two & ~one], 3)):
        start[at + 1] = False
        start[at + n] |= kind[at + n] == _LETTER
    return np.flatnonzero(start), np.flatnonzero(odd)


class Encoder:
    """Ids of texts as little-endian integers."""

    def __init__(self, path: str, width: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task its core; idle threads would spin
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = width or (2 if len(vocabulary) <= 1 << 16 else 4)
        self.kind = f"<u{self.width}"
        #: bytes of text behind each id (a byte-level piece has a character per byte)
        self.span = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.span[i] = len(piece)
        settings = json.loads(self.tokenizer.to_str())
        splitter = settings.get("pre_tokenizer") or {}
        #: whether the parts are those of this vocabulary
        self.parts = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space") and not settings.get("normalizer")
        if self.parts:
            #: encodes parts: it splits nothing, and keeps no words, as each is asked once
            self.bare = Tokenizer.from_file(path)
            self.bare.pre_tokenizer = self.bare.post_processor = None
            self.bare.model._resize_cache(0)
        #: parts by ascending hash: where their ids start in the pool, how many they
        #: are, and whether they were asked for again
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        self.pool, self.filled = np.zeros(4096, self.kind), 0

    def keep(self, keys: np.ndarray, ids: list[bytes]) -> None:
        """Adds parts under new hashes, ascending."""
        more = np.frombuffer(b"".join(ids), self.kind)
        end = self.filled + len(more)
        while end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.pool[self.filled : end] = more
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // self.width
        at = np.searchsorted(self.keys, keys)
        self.keys, self.size = np.insert(self.keys, at, keys), np.insert(self.size, at, size)
        self.start = np.insert(self.start, at, self.filled + np.cumsum(size, dtype=np.int64) - size)
        self.used = np.insert(self.used, at, False)
        self.filled = end

    def forget(self) -> None:
        """Leaves the parts that were asked for again since the last time, or none
        if these are most of them."""
        stay = np.flatnonzero(self.used)
        if len(stay) > CACHE // 2:
            stay = stay[:0]
        self.pool = self.pool[flat_ranges(self.start[stay], self.size[stay].astype(np.int64))]
        self.filled = len(self.pool)
        if not self.filled:
            self.pool = np.zeros(4096, self.kind)
        self.keys, self.size = self.keys[stay], self.size[stay]
        self.start, self.used = np.cumsum(self.size, dtype=np.int64) - self.size, np.zeros(len(stay), bool)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes among the keys, and whether they are there."""
        at = np.searchsorted(self.keys, hashes)
        inside = at < len(self.keys)
        known = np.zeros(len(hashes), bool)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        return at, known

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in found]

    def cut(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts, which go to the library as they are, in its characters for bytes."""
        named = _NAMES[np.frombuffer(b"\0".join(parts), np.uint8)].tobytes().decode("utf-32-le").split("\0")  # no part holds a zero byte
        ids = np.array(self.bare.encode_batch_fast([named], is_pretokenized=True, add_special_tokens=False)[0].ids, self.kind)
        ends = np.concatenate(([0], np.cumsum(self.span[ids])))
        at = np.searchsorted(ends, np.cumsum([0] + [len(p) for p in parts]))
        data, at = ids.tobytes(), (at * self.width).tolist()
        return [data[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.parts:
            return self.raw([t.decode() for t in texts])
        if len(self.keys) > CACHE:
            self.forget()
        # a text with a zero byte is encoded whole; \x01 stands for its bytes here
        joined = b"\0".join([t if b"\0" not in t else b"\x01" * len(t) for t in texts]) + b"\0"
        starts, odd = part(joined)
        first = np.cumsum([0] + [len(t) + 1 for t in texts])
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(first, odd, "right") - 1] = True
        data = np.frombuffer(joined, np.uint8)
        ends = np.append(starts[1:], len(data))
        used = (data[starts] != 0) & ~np.repeat(whole, np.diff(np.searchsorted(starts, first)))
        starts, ends = starts[used], ends[used]
        hashes, where, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at, known = self.find(hashes)
        self.used[at[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            words = [joined[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)]
            self.keep(hashes[new], self.cut(words))
            at, _ = self.find(hashes)
        number = at[back]
        count = self.size[number].astype(np.int64)
        out = self.pool[flat_ranges(self.start[number], count)]
        bound = np.concatenate(([0], np.cumsum(count)))[np.searchsorted(starts, first)].tolist()
        rest = iter(self.raw([t.decode() for t, w in zip(texts, whole.tolist(), strict=True) if w]))
        return [next(rest) if w else out[a:b].tobytes() for w, a, b in zip(whole.tolist(), bound[:-1], bound[1:], strict=True)]


def _encoder(path: str) -> Encoder:
    return only(("encoder", path), lambda: Encoder(path))


def train(docs: DataFrame, path: str, key: str, text: str, end_id: int) -> bytes:
    """The shared dictionary; empty if the sample is too small to train one."""
    hashed = docs.where(F.length(text) > 0).select(F.xxhash64(F.col(key), F.col(text)).alias("h"), F.substring(text, 1, SAMPLE_CHARS).alias("t"))
    chosen = [r.h for r in hashed.select("h").orderBy("h").limit(SAMPLE).collect()]
    rows = hashed.where(F.col("h").isin(chosen)).orderBy("h", "t").limit(SAMPLE).collect() if chosen else []
    encoder = Encoder(path)
    end = np.array([end_id], f"<u{encoder.width}").tobytes()
    samples = [x + end for x in encoder.encode([r.t.encode() for r in rows])]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # the trainer's own judgement of too few or too short samples
        return b""


def _with(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def pack(ids: list[int], counts: list[int], frames: list[bytes], width: int, digest: bytes) -> bytes:
    offsets = np.cumsum([0] + [len(f) for f in frames]).astype("<u8")
    head = [MAGIC, np.array([width, len(ids)], "<u4").tobytes(), digest]
    return b"".join([*head, np.array(ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes(), offsets.tobytes(), *frames])


class Shard:
    """Reads documents from a shard by their number in it."""

    def __init__(self, blob: bytes, dictionary: bytes):
        if blob[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.width, n = np.frombuffer(blob, "<u4", 2, 8).tolist()
        if blob[16:48] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self.ids = np.frombuffer(blob, "<i8", n, 48)
        self.counts = np.frombuffer(blob, "<u4", n, 48 + 8 * n)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, 48 + 12 * n)
        self.frames, self.first = blob, 48 + 12 * n + 8 * (n + 1)
        self.reader = zstandard.ZstdDecompressor(**_with(dictionary))

    def tokens(self, i: int) -> np.ndarray:
        a, b = (self.first + int(self.offsets[i + d]) for d in (0, 1))
        return np.frombuffer(self.reader.decompress(self.frames[a:b], int(self.counts[i]) * self.width), f"<u{self.width}")


_SHARDS = "part int, shard int, first_id long, last_id long, before long, n_docs long, n_ids long, data binary"


def write(docs: DataFrame, folder: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = 2) -> None:
    """Writes ``folder``/shards and ``folder``/dictionary."""
    spark = docs.sparkSession
    dictionary = train(docs, path, key, text, end_id)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "sha256 string, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    digest = hashlib.sha256(dictionary).digest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        width, end = encoder.width, np.array([end_id], f"<u{encoder.width}").tobytes()
        packer = zstandard.ZstdCompressor(level=LEVEL, **_with(dictionary))
        part, shard, before, size = TaskContext.get().partitionId(), 0, 0, 0
        ids: list[int] = []
        counts: list[int] = []
        frames: list[bytes] = []

        def flush() -> pa.RecordBatch:
            n = sum(counts)
            row = [part, shard, ids[0], ids[-1], before, len(ids), n, pack(ids, counts, frames, width, digest)]
            names = ("part", "shard", "first_id", "last_id", "before", "n_docs", "n_ids", "data")
            kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=list(names))

        for batch, parts in chunks(batches, "t", STEP):
            for i, found in zip(batch.column(0).to_pylist(), encoder.encode(parts), strict=True):
                ids.append(i)
                counts.append((len(found) + len(end)) // width)
                frames.append(packer.compress(found + end))
                size += len(frames[-1])
                if len(ids) >= SHARD_DOCS or size >= SHARD_BYTES:
                    yield flush()
                    shard, before, size = shard + 1, before + sum(counts), 0
                    ids, counts, frames = [], [], []
        if ids:
            yield flush()

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows.repartitionByRange("id").sortWithinPartitions("id", "t").mapInArrow(tidy(run, ("encoder", path)), _SHARDS).write.option("compression", "none").parquet(f"{folder}/shards")


def dictionary_of(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").first()["data"])


def _scan(shards: DataFrame, dictionary: bytes, wanted: set[int] | None) -> DataFrame:
    """(part, id, start in part, n_tokens, crc, ids as u4 bytes if wanted)."""
    full = wanted is not None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = Shard(data, dictionary)
                starts = before + np.cumsum(shard.counts.astype(np.int64)) - shard.counts
                some = [i for i, x in enumerate(shard.ids.tolist()) if not full or x in wanted]
                read = [shard.tokens(i).astype("<u4").tobytes() for i in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part] * len(some), pa.int32()),
                        pa.array([None if x == NULL_ID else x for x in shard.ids[some].tolist()], pa.int64()),
                        pa.array(starts[some], pa.int64()),
                        pa.array([len(x) // 4 for x in read], pa.int64()),
                        pa.array([zlib.crc32(x) for x in read], pa.int64()),
                        pa.array(read if full else [None] * len(some), pa.binary()),
                    ],
                    names=["part", "id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return shards.select("part", "before", "data").mapInArrow(run, "part int, id long, start long, n_tokens long, ids_crc32 long, ids binary")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of the files: id, start, n_tokens, ids_crc32."""
    shards = spark.read.schema(_SHARDS).parquet(f"{folder}/shards")
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # one row per write task
    bases, at = [], 0
    for r in totals:
        bases.append((r.part, at))
        at += r.n
    base = spark.createDataFrame(bases, "part int, base long")
    found = _scan(shards, dictionary_of(spark, folder), None)
    return found.join(small(base), "part").select("id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, folder: str, ids: list[int]) -> DataFrame:
    """Single documents (id, n_tokens, ids): only shards that may hold them are
    read, and only their frames are decompressed."""
    shards = spark.read.schema(_SHARDS).parquet(f"{folder}/shards")
    if not ids:
        return _scan(shards.limit(0), b"", set()).select("id", "n_tokens", "ids")
    near = F.lit(False)
    for i in ids:
        near = near | ((F.col("first_id") <= i) & (F.col("last_id") >= i))
    return _scan(shards.where(near), dictionary_of(spark, folder), set(ids)).select("id", "n_tokens", "ids")
