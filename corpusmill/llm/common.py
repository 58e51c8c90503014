"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import cut_lineage

#: One or more of space, \t, \n, \x0B, \f, \r; also what bytes.split() splits on.
WHITE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once although ``body``
    uses it inside lambdas (where Spark would compute it per element)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """White-space separated words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WHITE), lambda w: w != "")


def apart(df: DataFrame, text: str, columns: list[str]) -> Column:
    """All ``columns`` but the text as one struct ``row``, so that a Python step
    takes the text once, under a name of its own."""
    rest = [F.col(c) for c in columns if c != text]
    return F.struct(*(rest or [F.lit(True).alias("_none")])).alias("row")


def together(text: str, columns: list[str], name: str = "t") -> list[Column]:
    """The columns that ``apart`` took apart, in their order."""
    return [F.col(name).alias(c) if c == text else F.col("row")[c].alias(c) for c in columns]


def small(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` (narrow) rows, else
    unmarked, for an ordinary shuffled join. ``df`` should be checkpointed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(id, component)`` per
    node, the component being its smallest id.

    Each round points every node at its smallest neighbour below it, follows
    that pointer once, and contracts the edges; a node with a smaller neighbour
    is gone after its round, so rounds grow with the logarithm of a component.
    A node's neighbours are only ever reduced to their minimum (partial
    aggregate), so a node with millions of links is not gathered anywhere.
    """

    def ordered(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = cut_lineage(ordered(edges))
    ids = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    assigned = ids.select("id", F.col("id").alias("component"))
    while not edges.isEmpty():
        parent = edges.groupBy("a").agg(F.min("b").alias("up"))
        above = parent.select(F.col("a").alias("up"), F.col("up").alias("upper"))
        hop = cut_lineage(parent.join(above, "up", "left").select("a", F.coalesce("upper", "up").alias("up")))

        def moved(df: DataFrame, column: str, hop: DataFrame = hop) -> DataFrame:
            to = hop.select(F.col("a").alias(column), F.col("up").alias("to"))
            return df.join(to, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        edges = cut_lineage(ordered(moved(moved(edges, "a"), "b")))
        assigned = cut_lineage(moved(assigned, "component"))
    return assigned.select("id", "component")
