"""Which pages may be indexed, and under which scope."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.config import AUTO_IGNORE, DEFAULT_SCOPE, SearchConfig
from quillseek.functions.urls import is_local
from quillseek.operators.joins import is_small, split_join
from quillseek.session import cut_lineage


def auto_ignored(location: Column) -> Column:
    return location.isin(*AUTO_IGNORE)


def exclude_regex(patterns: Sequence[str]) -> str:
    """All exclude patterns as one whole-location match; ``:num`` and ``:any`` are wildcards."""
    each = (p.replace(":num", "[0-9]+").replace(":any", ".+") for p in patterns)
    return "|".join(f"^(?:{p})$" for p in each)


def excluded(location: Column, patterns: Sequence[str]) -> Column:
    return location.rlike(exclude_regex(patterns)) if patterns else F.lit(False)


def scope_regex(preview_path: str) -> str:
    path = re.sub(r"(?<=/)\{[^{}]+\}", ".+", preview_path)
    return re.sub(r"[{}]", lambda m: "\\" + m[0], path)


def scope_of(location: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Scope of the first rule whose path pattern is found in the location; rules keep their order."""
    choice = F
    for scope, path in rules:
        if path and path != "{location}":
            choice = choice.when(location.rlike(scope_regex(path)), F.lit(scope))
    return F.lit(DEFAULT_SCOPE) if choice is F else choice.otherwise(F.lit(DEFAULT_SCOPE))


def early_reason(location: Column, site: Column, config: SearchConfig) -> Column:
    """Why a page is out by its location alone; null if it is not."""
    return (
        F.when(auto_ignored(location), F.lit("ignored"))
        .when(~is_local(location, site), F.lit("not local"))
        .when(excluded(location, config.exclude), F.lit("excluded"))
    )


def robots_blocked(
    pages: DataFrame, robots: DataFrame | None, config: SearchConfig, location: str = "path"
) -> DataFrame:
    """Adds ``blocked``. ``robots`` holds one combined pattern per site, so the join adds no rows."""
    if robots is None or config.ignore_robots:
        return pages.withColumn("blocked", F.lit(False))
    rules = robots.select("site", F.col("regex").alias("robots_regex"))
    hit = F.coalesce(F.rlike(F.col(location), F.col("robots_regex")), F.lit(False))
    joined = split_join(pages, rules, ["site"], "left", config)
    return joined.withColumn("blocked", hit).drop("robots_regex")


def robots_marked(pages: DataFrame, robots: DataFrame | None, config: SearchConfig) -> DataFrame:
    """As ``robots_blocked``, for pages that still carry their HTML: a small set of rules travels with the
    scan, a large one is tested on locations alone, so that HTML only moves if the blocked locations are
    too many to broadcast."""
    if robots is None or config.ignore_robots or is_small(robots, config):
        return robots_blocked(pages, robots, config)
    places = robots_blocked(pages.select("site", "path").distinct(), robots, config)
    blocked = cut_lineage(places.filter("blocked").select("site", "path", F.lit(True).alias("hit")))
    joined = split_join(pages, blocked, ["site", "path"], "left", config)
    return joined.withColumn("blocked", F.coalesce("hit", F.lit(False))).drop("hit")


def indexable(pages: DataFrame, robots: DataFrame | None, config: SearchConfig) -> DataFrame:
    """Rows of ``(site, path, ...)`` that may be indexed."""
    kept = pages.filter(early_reason(F.col("path"), F.col("site"), config).isNull())
    return robots_blocked(kept, robots, config).filter(~F.col("blocked")).drop("blocked")


def gated(changes: DataFrame, config: SearchConfig) -> DataFrame:
    """Changes of the modules that are indexed on save and delete; never the search module itself."""
    kept = changes.filter(F.col("module") != "search")
    if config.index_modules is not None:
        kept = kept.filter(F.col("module").isin(*config.index_modules))
    return kept
