"""The link graph of evaluated pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.functions.urls import is_local, location_of, stored_location
from quillseek.operators.eligibility import auto_ignored, excluded
from quillseek.operators.extraction import REJECTED
from quillseek.operators.joins import split_join, unnest


def page_links(evaluated: DataFrame) -> DataFrame:
    """``(site, location, pos, href)`` of every followed link, in page order."""
    return unnest(evaluated, ["site", "location"], F.col("links"), "href", pos=True)


def link_edges(evaluated: DataFrame, config: SearchConfig) -> DataFrame:
    """``(site, src, dst)`` once each. Pages that are rejected or say nofollow have no edges."""
    followed = evaluated.filter((F.col("outcome") != REJECTED) & ~F.col("nofollow"))
    target = location_of(
        F.col("href"), F.col("site"), F.col("src"), config.web_path, config.default_language
    )
    return (
        page_links(followed)
        .withColumnRenamed("location", "src")
        .select("site", "src", stored_location(target).alias("dst"))
        .distinct()
    )


def broken_links(edges: DataFrame, pages: DataFrame, config: SearchConfig) -> DataFrame:
    """Local targets that were not fetched or answered with an error, with the page they are on.

    ``pages`` holds ``(site, location, status)``. The page side is one row per location after a
    partial aggregate, and a target of very many links is joined apart.
    """
    wanted = edges.filter(
        is_local(F.col("dst"), F.col("site"))
        & ~auto_ignored(F.col("dst"))
        & ~excluded(F.col("dst"), config.exclude)
    )
    # The best answer counts where a location was fetched more than once.
    answers = pages.groupBy("site", F.col("location").alias("dst")).agg(
        F.min(F.coalesce(F.col("status"), F.lit(200))).alias("status")
    )
    return (
        split_join(wanted, answers, ["site", "dst"], "left", config)
        .filter(F.col("status").isNull() | (F.col("status") >= 400))
        .select("site", F.col("dst").alias("location"), F.col("src").alias("found_on"), "status")
    )
