"""Link-graph crawl by levels.

The breadth-first search of all votings runs at once: each level is a join of
the frontier with the links of its pages and an anti join with what was visited.
A page's links are read once, however many votings link to it; levels carry urls
and orders only, and bodies are joined at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import fixed_values as fv
from corpusmill.functions import json_values as js
from corpusmill.functions import text as tx
from corpusmill.functions import urls
from corpusmill.operators.select import first_per_key, top_per_key
from corpusmill.session import cut_lineage

# A frame of distinct urls -> ``url, body`` for those that exist.
Pages = Callable[[DataFrame], DataFrame]


def from_table(pages: DataFrame) -> Pages:
    """Read pages from a table of ``url, body``."""
    return lambda wanted: pages.join(wanted, "url", "left_semi")


def crawl(
    seeds: DataFrame,
    pages: Pages,
    max_depth: int | None = None,
    max_nodes: int | None = None,
    host: str = fv.VOTE_API_HOST,
    on_missing: str = "raise",
) -> DataFrame:
    """``voting_id, depth, url, label, body`` of every visited page.

    ``seeds``: ``voting_id, position, name, url``. A url is visited once per
    voting, at its smallest depth, and only on the allowed host. Without
    ``max_depth`` the search ends when no new page is linked. With
    ``max_nodes`` a voting stops after that many pages in search order (level,
    then the order of the parent, then that of the link); ``None`` visits all.
    """
    if on_missing not in ("raise", "skip"):
        raise ValueError("on_missing must be raise or skip")
    frontier = seeds.select("voting_id", "url", "name", F.array(F.col("position").cast("long")).alias("order"))
    visited: DataFrame | None = None
    links: DataFrame | None = None  # url, links of the pages read so far
    depth = 0
    while max_depth is None or depth <= max_depth:
        allowed = frontier.filter(urls.is_allowed_api(F.col("url"), host))
        new = first_per_key(allowed, ["voting_id", "url"], [F.asc("order")])
        if visited is not None:
            new = new.join(visited.select("voting_id", "url"), ["voting_id", "url"], "left_anti")
        if max_nodes is not None:
            new = _within_budget(new, visited, max_nodes)
        new = cut_lineage(new)
        if depth and new.isEmpty():
            break
        wanted = new.select("url").distinct()
        unread = wanted if links is None else wanted.join(links, "url", "left_anti")
        read = cut_lineage(pages(unread).select("url", js.extract_links(F.col("body").cast("string")).alias("links")))
        links = read if links is None else links.unionByName(read)
        joined = new.join(links, "url", "left")
        if on_missing == "raise":
            gone = F.raise_error(F.concat(F.lit("page not available: "), F.col("url"))).cast("array<string>")
            joined = joined.withColumn("links", F.when(F.col("links").isNull(), gone).otherwise(F.col("links")))
        else:
            joined = joined.filter(F.col("links").isNotNull())
        level = joined.select("voting_id", F.lit(depth).alias("depth"), "url", tx.file_label(F.col("name"), F.col("url")).alias("label"), "order", "links")
        level = cut_lineage(level)
        seen = level.drop("links", "order")
        visited = seen if visited is None else visited.unionByName(seen)
        children = level.select("voting_id", "order", F.posexplode("links").alias("at", "url"))
        frontier = children.select(
            "voting_id", "url", F.lit("link").alias("name"), F.concat("order", F.array(F.col("at").cast("long"))).alias("order")
        )
        depth += 1
    bodies = pages(visited.select("url").distinct()).select("url", F.col("body").cast("string").alias("body"))
    return visited.join(bodies, "url", "left").select("voting_id", "depth", "url", "label", "body")


def _within_budget(new: DataFrame, visited: DataFrame | None, max_nodes: int) -> DataFrame:
    head = top_per_key(new, ["voting_id"], [F.asc("order"), F.asc("url")], max_nodes, rank="nth")
    if visited is None:
        return head.drop("nth")
    spent = visited.groupBy("voting_id").agg(F.count("*").alias("spent"))
    return head.join(spent, "voting_id", "left").filter(F.col("nth") + F.coalesce("spent", F.lit(0)) <= max_nodes).drop("nth", "spent")
