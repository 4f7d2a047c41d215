"""Full indexing: choose the pages of every site, extract them, write the next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillseek.config import HOME, SearchConfig
from quillseek.functions.urls import stored_location
from quillseek.operators.crawl import crawl
from quillseek.operators.extraction import INDEXED, KEYS, RECORD, REJECTED, deciding, evaluate_pages
from quillseek.operators.joins import latest
from quillseek.operators.links import link_edges
from quillseek.operators.maintenance import choose_source
from quillseek.session import cut_lineage
from quillseek.sources.index_store import rebuild


def site_roots(pages: DataFrame) -> DataFrame:
    return pages.select("site").distinct().select("site", F.lit(HOME).alias("location"))


def crawled_locations(evaluated: DataFrame, roots: DataFrame, config: SearchConfig) -> DataFrame:
    """``(site, location, depth)`` reached by following links from the roots.

    Only the newest copy of a location counts: its links are followed, and if it is rejected the
    location is no node. Texts take no part in finding it.
    """
    copies = evaluated.select(*KEYS, "seq", "url", "outcome", "nofollow", "links")
    newest = cut_lineage(latest(copies, KEYS, ["seq", "url"]))
    nodes = newest.filter(F.col("outcome") != REJECTED).select("site", "location")
    return crawl(link_edges(newest, config), nodes, roots, config.depth, config)


def full_index(
    pages: DataFrame,
    config: SearchConfig,
    robots: DataFrame | None = None,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Records of a complete rebuild.

    ``listed`` holds the sitemaps' ``(site, path)``. One extraction pass feeds both the link graph and
    the records.
    """
    evaluated = evaluate_pages(pages, config, robots)
    none = pages.select("site", "path").limit(0)
    listed = none if listed is None else listed
    if config.index_method == "sitemap":
        chosen = choose_source(listed, none, config)
    else:
        evaluated = cut_lineage(evaluated)
        roots = site_roots(pages)
        if config.index_method == "auto":  # the others' sitemaps say what to index
            roots = roots.join(listed.select("site").distinct(), "site", "left_anti")
        reached = crawled_locations(evaluated, roots, config)
        chosen = choose_source(
            listed, reached.select("site", F.col("location").alias("path")), config
        )
    keys = chosen.select("site", stored_location(F.col("path")).alias("location")).distinct()
    records = deciding(evaluated.select(*RECORD, "url", "outcome")).filter(F.col("outcome") == INDEXED)
    return records.join(keys, ["site", "location"], "left_semi").select(*RECORD)


def rebuild_index(
    pages: DataFrame,
    root: str,
    config: SearchConfig,
    robots: DataFrame | None = None,
    listed: DataFrame | None = None,
) -> int | None:
    """Rebuild the stored index; None if indexing is disabled or there is nothing to index."""
    if not config.indexing_enabled:
        return None
    return rebuild(full_index(pages, config, robots, listed), root, config)
