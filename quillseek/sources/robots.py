"""robots.txt files: one row per fetched body."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.functions.robots import combined_regex, disallow_regex, disallowed
from quillseek.operators.joins import latest, unnest


def robots_rules(files: DataFrame, config: SearchConfig) -> DataFrame:
    """``(site, body)`` to one row per applying rule, in file order."""
    patterns = disallowed(F.col("body"), config.user_agent)
    rules = unnest(files, ["site"], patterns, "pattern", pos=True).withColumnRenamed("pos", "rule_no")
    return rules.withColumn("regex", disallow_regex(F.col("pattern")))


def robots_by_site(files: DataFrame, config: SearchConfig, seq: str | None = None) -> DataFrame:
    """One combined pattern per site, from its newest body by ``seq``; without one all its bodies apply."""
    if seq is None:
        bodies = files.groupBy("site").agg(F.array_join(F.sort_array(F.collect_set("body")), "\n").alias("body"))
        return _combined(bodies, config)
    newest = latest(files.select("site", "body", seq), ["site"], [seq])
    return _combined(newest, config)


def _combined(bodies: DataFrame, config: SearchConfig) -> DataFrame:
    return bodies.select(
        "site", combined_regex(disallowed(F.col("body"), config.user_agent)).alias("regex")
    ).filter(F.col("regex").isNotNull())
