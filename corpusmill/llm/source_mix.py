"""Mixing sources to target weights by dependent rounding.

A source's target, divided by its size, is the number of copies expected of each
of its documents: a whole number, which all get, and a fraction, which is
rounded. Rounding is pivotal: of two documents with fractional copies one gives
words to the other until one of the two is whole; which of them gives is drawn
so that expectations stay, and the words of the source stay what they were.
Documents are dealt to blocks by a hash, largest first in a block. What is left
of a block goes up a tree, ``FAN`` blocks to one: the document that stayed
fractional and a reserve of small ones. At the root the last large document is
rounded at random and the reserve, whose fractions shift by as many words, takes
up the difference. So a source misses its target by less than a document.

All draws come from generators seeded with the source, block and level, and
blocks are sorted, so reruns agree whatever the partitions.

Sources are numbered by code point (null last) without gathering them, and their
targets are found by raising a common level until no target is above its bound.

Defined cases: null, empty or wordless texts have size 0 and are never taken; a
null source is one source; a source of size 0 has target 0; rows with equal id,
source and size are rounded together and share their copies; null ids are an id
like any other; an empty table gives an empty mix; extra columns are ignored by
``report`` and kept by ``mixed``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import small
from corpusmill.llm.ranking import numbered
from corpusmill.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
#: Documents expected in a block, and blocks that meet in one of the next level.
BLOCK, FAN = 10_000, 32
WORD = r"[^\x20\x09-\x0D]+"
_CLOSE = 1e-9


def _pair(p: np.ndarray, size: np.ndarray, order: np.ndarray, rng: np.random.Generator) -> int | None:
    """Rounds ``p`` in place, walking along ``order``; returns the one that stays
    fractional, if any."""
    draws, held = rng.random(len(order)).tolist(), None
    for at, u in zip(order.tolist(), draws, strict=True):
        if held is None:
            held = at
            continue
        a, b, x, y = float(p[held]), float(p[at]), float(size[held]), float(size[at])
        up, down = min((1 - a) * x, b * y), min(a * x, (1 - b) * y)  # words to the held one, or from it
        moved = up if u * (up + down) < down else -down
        a, b = a + moved / x, b - moved / y
        a, b = (round(v) if abs(v - round(v)) < _CLOSE else v for v in (a, b))
        p[held], p[at] = a, b
        whole_a, whole_b = a in (0, 1), b in (0, 1)
        held = None if whole_a and whole_b else at if whole_a else held
    return held


def settle(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, root: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fractions after rounding, and which documents go up the tree. Documents
    come largest first; the smallest ones that together hold twice the words of
    the largest, half of all at most, are the reserve."""
    p, n = p.copy(), len(p)
    after = np.cumsum(size[::-1])[::-1]  # words of a document and all smaller ones
    first = max(n - n // 2, int(np.searchsorted(-after, -2 * size[0], "right"))) if n else 0
    held = _pair(p, size, np.arange(first), rng)
    up = np.zeros(n, bool)
    if not root:
        up[first:] = True
        if held is not None:
            up[held] = True
        return p, up
    if held is not None and first < n:
        before = p[held]
        p[held] = float(rng.random() < before)
        over = (p[held] - before) * size[held]
        rest = slice(first, n)
        room = np.where(over > 0, p[rest], 1 - p[rest])  # in proportion to it, so no fraction leaves 0 to 1
        words = float((room * size[rest]).sum())
        share = 0.0 if words == 0 else min(1.0, abs(over) / words)
        p[rest] += -np.sign(over) * share * room
        p[rest] = np.where(np.abs(p[rest] - np.round(p[rest])) < _CLOSE, np.round(p[rest]), p[rest])
        held = None
    open_ = [*([held] if held is not None else []), *(first + np.flatnonzero((p[first:] > 0) & (p[first:] < 1))).tolist()]
    last = _pair(p, size, np.array(open_, np.int64), rng)
    if last is not None:
        p[last] = float(p[last] >= 0.5)
    return p, up


_UNITS = "source string, number long, blocks long, block long, size long, p double, up boolean, tie long"


def _level(units: DataFrame, key_type: str, level: int, seed: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        number, block, blocks = (table.column(c)[0].as_py() for c in ("number", "block", "blocks"))
        rng = np.random.default_rng(zlib.crc32(f"{seed}:{level}:{number}:{block}".encode()))
        table = table.sort_by([("size", "descending"), ("tie", "ascending")])
        p, up = settle(table.column("p").to_numpy(), table.column("size").to_numpy().astype(float), rng, blocks == 1)
        names = table.schema.names
        table = table.set_column(names.index("p"), "p", pa.array(p, pa.float64()))
        return table.set_column(names.index("up"), "up", pa.array(up))

    return units.groupBy("number", "block").applyInArrow(run, f"key {key_type}, {_UNITS}")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """``sources(source, source_size)`` with their ``number`` (0, 1, ...) and ``target``."""
    listed = numbered(sources, [F.col("source").asc_nulls_last()], "number")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    listed = cut_lineage(listed.withColumn("weight", weight).withColumn("bound", F.lit(float(most)) * F.col("source_size")))
    total = (listed.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    bounded = F.lit(False)
    while True:  # the level only rises, so each round bounds further sources or is the last
        sums = listed.select(F.sum(F.when(bounded, F.col("bound"))).alias("taken"), F.sum(F.when(~bounded, F.col("weight"))).alias("weight")).first()
        rest, weight = total - (sums["taken"] or 0.0), sums["weight"]
        above = F.lit(rest) * F.col("weight") / F.lit(weight) > F.col("bound") if weight else F.lit(False)
        if listed.where(~bounded & above).isEmpty():
            break
        bounded = F.lit(rest / weight) * F.col("weight") > F.col("bound")
    even = F.lit(rest) * F.col("weight") / F.lit(weight or 1.0)
    return listed.withColumn("target", F.when(bounded, F.col("bound")).otherwise(even)).select("source", "source_size", "number", "target")


def report(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, percent: int = 150, most: int = 2, seed: int = 13) -> DataFrame:
    """Per row: key, size, source_size, target of its source, taken (words), copies."""
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    # rows that nothing tells apart are one row that counts several times
    alike = cut_lineage(rows.groupBy("key", "source", "size").agg(F.count("*").alias("rows")))
    sums = cut_lineage(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).cast("long").alias("source_size"), F.count("*").alias("n")))
    aims = targets(sums.select("source", "source_size"), weights, percent, most)
    aims = cut_lineage(aims.join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    placed = alike.join(small(aims.withColumnRenamed("source", "s")), alike["source"].eqNullSafe(F.col("s"))).drop("s").withColumn("rate", rate)
    base = F.floor(F.col("rate") + _CLOSE)
    share = F.greatest(F.col("rate") - base, F.lit(0.0)) * F.col("rows")
    placed = placed.withColumn("base", base).withColumn("more", F.floor(share + _CLOSE)).withColumn("p", F.greatest(share - F.col("more"), F.lit(0.0)))
    placed = cut_lineage(placed.withColumn("p", F.when((F.col("p") < _CLOSE) | (F.col("size") == 0), 0.0).otherwise(F.col("p"))))

    kind = docs.schema[key].dataType.simpleString()
    tie = F.xxhash64("key", "size")
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    units = placed.where("p > 0").select("key", "source", "number", blocks.alias("blocks"), F.pmod(tie, blocks).alias("block"), "size", "p", F.lit(False).alias("up"), tie.alias("tie"))
    done, level, depth = [], 0, placed.agg(F.max(blocks)).first()[0] or 0
    while depth:
        settled = cut_lineage(_level(units, kind, level, seed))
        done.append(settled.where(~F.col("up")))
        units = settled.where("up").withColumn("block", F.floor(F.col("block") / FAN)).withColumn("blocks", F.ceil(F.col("blocks") / FAN)).withColumn("up", F.lit(False))
        depth, level = (0 if depth == 1 else -(-depth // FAN)), level + 1
    extra = None
    for df in done:
        part = df.where("p > 0.5").select(F.col("key").alias("k"), F.col("number").alias("i"), F.col("size").alias("z"), F.lit(1).alias("extra"))
        extra = part if extra is None else extra.unionByName(part)
    if extra is not None:
        same = placed["key"].eqNullSafe(extra["k"]) & (placed["number"] == extra["i"]) & (placed["size"] == extra["z"])
        placed = placed.join(extra, same, "left").withColumn("more", F.col("more") + F.coalesce("extra", F.lit(0)))
    each = placed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = F.col("base") + (F.col("row") <= F.col("more")).cast("long")
    return each.select(F.col("key").alias(key), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), F.col("source").alias("_source"), F.col("row").alias("_row"))


def mixed(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options: object) -> DataFrame:
    """The rows of the mix, each as often as it is taken, columns unchanged. Of
    rows with equal id, source and size any may be the one that is taken more often."""
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    plan = report(docs, key, source, text, **options)
    plan = plan.groupBy(F.col(key).alias("_k"), "_source", F.col("size").alias("_size")).agg(F.min("copies").alias("_least"), F.sum(F.col("copies")).alias("_all"), F.count("*").alias("_n"))
    same = docs[key].eqNullSafe(F.col("_k")) & docs[source].eqNullSafe(F.col("_source")) & (size == F.col("_size"))
    joined = docs.join(plan, same).withColumn("_more", F.col("_all") - F.col("_least") * F.col("_n"))
    alone = joined.where("_more = 0").withColumn("_copies", F.col("_least"))
    number = F.row_number().over(Window.partitionBy("_k", "_source", "_size").orderBy(F.xxhash64(F.col(text))))
    several = joined.where("_more > 0").withColumn("_copies", F.col("_least") + (number <= F.col("_more")).cast("long"))
    return alone.unionByName(several).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*docs.columns)
