"""Reachability over the link graph: every page is parsed once in parallel, then levels are walked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.operators.joins import split_join
from quillseek.session import cut_lineage

_COMPACT_EVERY = 8


def crawl(
    edges: DataFrame,
    nodes: DataFrame,
    roots: DataFrame,
    depth: int = 0,
    config: SearchConfig = SearchConfig(),
) -> DataFrame:
    """``(site, location, depth)`` of the pages reached from the roots.

    ``nodes`` are the pages that can be visited and ``edges`` the links that are followed. With
    ``depth`` N only levels below N are visited, the roots being level 0. A page's depth is its
    shortest. One job per level; every level is checkpointed, so lost executors never replay the walk,
    and all sites advance together.
    """
    nodes = nodes.select("site", "location").distinct()
    # Links that lead nowhere are dropped once, and what is left is laid out by source. Every page of a
    # site may link to its home page, so popular targets are joined apart.
    targets = nodes.withColumnRenamed("location", "dst")
    linked = split_join(
        edges.select("site", "src", "dst"), targets, ["site", "dst"], "left_semi", config
    )
    hops = cut_lineage(linked.repartition("site", "src"))
    frontier = cut_lineage(
        roots.select("site", "location")
        .distinct()
        .join(nodes, ["site", "location"], "left_semi")
        .withColumn("depth", F.lit(0))
    )
    visited, level = frontier, 0
    while not frontier.isEmpty() and (depth == 0 or level + 1 < depth):
        level += 1
        reached = (
            hops.join(frontier.select("site", F.col("location").alias("src")), ["site", "src"], "left_semi")
            .select("site", F.col("dst").alias("location"))
            .distinct()
            .join(visited.select("site", "location"), ["site", "location"], "left_anti")
        )
        frontier = cut_lineage(reached.withColumn("depth", F.lit(level)))
        visited = visited.unionByName(frontier)
        if level % _COMPACT_EVERY == 0:
            visited = cut_lineage(visited.repartition("site", "location"))
    return visited


def discovered(edges: DataFrame, visited: DataFrame, roots: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """``(site, location)`` of everything linked from visited pages, fetched or not, plus the roots. A page of very many
    links is joined apart."""
    sources = visited.select("site", F.col("location").alias("src")).distinct()
    found = split_join(edges, sources, ["site", "src"], "left_semi", config).select("site", F.col("dst").alias("location"))
    return found.unionByName(roots.select("site", "location")).distinct()
