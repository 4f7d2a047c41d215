"""The table of searches: normalised, gated by length, and reduced to distinct work."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.config import SearchConfig

_MANY_SITES = 256  # above this a scan is not narrowed to the sites searched

SEARCH = ["site", "q", "mode", "language", "limit", "offset"]


def normalise(q: Column) -> Column:
    """Lower-cased, trimmed, runs of two or more blanks as one space."""
    return F.regexp_replace(F.regexp_replace(F.lower(q), r"^[\s\x00]+|[\s\x00]+$", ""), r"\s{2,}", " ")


def effective_mode(q: Column, mode: Column, config: SearchConfig) -> Column:
    """Full-text modes need a long enough query; everything else is a substring search."""
    mode = F.lower(mode)
    long_enough = F.octet_length(q) >= config.min_length_fulltext
    return F.when(long_enough & mode.isin("match", "match boolean"), mode).otherwise(F.lit("like"))


def prepare(queries: DataFrame, config: SearchConfig) -> DataFrame:
    """``(query_id, site, q, mode, language, limit, offset, raw_q)`` of the queries long enough to run.

    Missing columns take their defaults; a null or empty language means any, as does every language where
    only one is configured.
    """
    defaults = {
        "mode": F.lit(config.query_type),
        "language": F.lit(None).cast("string"),
        "limit": F.lit(config.limit),
        "offset": F.lit(0),
    }
    filled = queries
    for name, value in defaults.items():
        given = F.coalesce(F.col(name), value) if name in queries.columns else value
        filled = filled.withColumn(name, given)
    several = config.languages is None or len(config.languages) > 1
    kept = filled.filter(F.octet_length("q") >= config.min_length_search)
    text = normalise(F.col("q"))
    return kept.select(
        "query_id",
        "site",
        text.alias("q"),
        F.col("q").alias("raw_q"),
        effective_mode(text, F.col("mode"), config).alias("mode"),
        F.when((F.col("language") != "") & F.lit(several), F.col("language")).alias("language"),
        F.col("limit").cast("int").alias("limit"),
        F.col("offset").cast("int").alias("offset"),
    )


@dataclass(frozen=True)
class Batch:
    """What planning needs to know about a batch of searches, read in one aggregate row."""

    rows: int
    bytes: int
    modes: frozenset[str]
    deepest: int  # lowest rank any search shows
    shown: int  # result rows at most
    small: bool  # terms, clauses and grams of the batch fit a broadcast
    shown_small: bool
    sites: tuple[str, ...] | None  # what is searched, unless these are many

    @staticmethod
    def of(prepared: DataFrame, config: SearchConfig) -> Batch:
        depth = F.col("offset").cast("long") + F.col("limit")
        row = prepared.agg(
            F.count(F.lit(1)).alias("rows"),
            F.coalesce(F.sum(F.octet_length("q") + 16), F.lit(0)).alias("bytes"),
            F.collect_set("mode").alias("modes"),  # three values at most
            F.coalesce(F.max(depth), F.lit(0)).alias("deepest"),
            F.coalesce(F.sum(F.col("limit").cast("long")), F.lit(0)).alias("shown"),
        ).first()
        found = prepared.select("site").distinct().limit(_MANY_SITES + 1).collect()
        sites = tuple(sorted(r["site"] for r in found if r["site"] is not None))
        # A query of b bytes has at most b words, clauses or grams, each no longer than b.
        small = row["bytes"] <= min(config.max_broadcast_rows, config.max_broadcast_bytes // 64)
        return Batch(
            row["rows"],
            row["bytes"],
            frozenset(row["modes"]),
            row["deepest"],
            row["shown"],
            small,
            row["shown"] <= config.max_broadcast_rows,
            sites if len(found) <= _MANY_SITES else None,
        )


def searches(prepared: DataFrame) -> DataFrame:
    """Equal queries are answered once: ``search_id`` is the smallest query_id that asks it."""
    return prepared.groupBy(*SEARCH).agg(F.min("query_id").alias("search_id"))
