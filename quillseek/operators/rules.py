"""Exclude and scope rules of many sites as tables: met by equality on a piece of their text before a pattern is tried."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillseek.config import DEFAULT_SCOPE, SearchConfig
from quillseek.operators.joins import is_small, split_join, unnest
from quillseek.session import cut_lineage

_PIECE = 3  # characters that a rule is filed under
_ANY_SITE = ""

# What is a wildcard in each kind of rule.
_EXCLUDE = (":num", ":any")
_SCOPE = r"(?<=/)\{[^{}]+\}"


def exclude_patterns(rules: DataFrame) -> DataFrame:
    """``(site, rule_no, regex, literal)`` of exclude rules ``(site, rule_no, pattern)``: the whole location matches, ``:num`` stands for digits,
    ``:any`` for anything. ``literal`` is the longest stretch that every match holds, empty where the pattern has signs that a regular
    expression reads otherwise."""
    regex = F.replace(F.replace("pattern", F.lit(":num"), F.lit("[0-9]+")), F.lit(":any"), F.lit(".+"))
    plain = F.split(F.replace(F.replace("pattern", F.lit(":num"), F.lit("\n")), F.lit(":any"), F.lit("\n")), "\n")
    return _filed(rules, F.concat(F.lit("^(?:"), regex, F.lit(")$")), plain)


def scope_patterns(rules: DataFrame) -> DataFrame:
    """``(site, rule_no, regex, literal, scope)`` of scope rules ``(site, rule_no, scope, path)``: found anywhere in the location, ``{name}`` after a
    slash stands for anything. Rules without a path, or whose path is ``{location}``, never apply."""
    kept = rules.filter((F.coalesce("path", F.lit("")) != "") & (F.col("path") != "{location}"))
    regex = F.regexp_replace(F.regexp_replace("path", _SCOPE, ".+"), r"([{}])", r"\\$1")
    return _filed(kept, regex, F.split(F.regexp_replace("path", _SCOPE, "\n"), "\n"))


def _filed(rules: DataFrame, regex: Column, stretches: Column) -> DataFrame:
    """A stretch counts as literal if all of it is letters, digits and signs that stand for themselves; a dot parts stretches."""
    stretches = F.split(F.replace(F.array_join(stretches, "\n"), F.lit("."), F.lit("\n")), "\n")
    literal = F.filter(stretches, lambda s: s.rlike(r"^[\p{L}\p{N}/_~ %=&,;:!@-]*$"))
    alone = F.when(F.size(literal) == F.size(stretches), literal).otherwise(F.array(F.lit("")))
    longest = F.get(F.array_sort(alone, lambda a, b: F.length(b) - F.length(a)), F.lit(0))
    return rules.select(F.coalesce("site", F.lit(_ANY_SITE)).alias("site"), "rule_no", regex.alias("regex"), F.coalesce(longest, F.lit("")).alias("literal"), *(c for c in ("scope",) if c in rules.columns))


def _pieces(text: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - _PIECE + 1, F.lit(0)))
    return F.array_distinct(F.transform(F.filter(starts, lambda i: i <= F.length(text) - _PIECE + 1), lambda i: F.substring(text, i, F.lit(_PIECE))))


def rule_matches(pages: DataFrame, patterns: DataFrame, config: SearchConfig, location: str = "path") -> DataFrame:
    """``(site, location, rule_no, ...)`` of every rule that applies to a distinct location: a site's own rules, and those of a null site.

    Each rule is filed under the piece of its literal stretch that the fewest rules of its site hold, so that rules with a
    common beginning do not meet every location. Locations meet rules by equality on pieces; only then is a pattern tried.
    """
    filed = unnest(patterns, ["site", "rule_no"], F.when(F.length("literal") >= _PIECE, _pieces(F.col("literal"))).otherwise(F.array(F.lit(""))), "piece")
    shared = filed.groupBy("site", "piece").agg(F.count(F.lit(1)).alias("rules"))
    rank = F.row_number().over(Window.partitionBy("site", "rule_no").orderBy("rules", "piece"))
    rarest = filed.join(shared, ["site", "piece"]).withColumn("rank", rank).filter("rank = 1").select("site", "rule_no", "piece")
    known = cut_lineage(patterns.drop("literal").join(rarest, ["site", "rule_no"]).withColumnRenamed("site", "of_site"))
    places = pages.select("site", F.col(location).alias("location")).distinct()
    each = unnest(places, ["site", "location"], F.array_union(_pieces(F.col("location")), F.array(F.lit(""))), "piece")
    each = unnest(each, ["site", "location", "piece"], F.array_distinct(F.array(F.coalesce("site", F.lit(_ANY_SITE)), F.lit(_ANY_SITE))), "of_site")
    met = split_join(each, known, ["of_site", "piece"], "inner", config, is_small(known, config))
    return met.filter(F.rlike(F.col("location"), F.col("regex"))).drop("piece", "of_site", "regex")


def _distinct(patterns: DataFrame) -> DataFrame:
    """One rule for each pattern of a site, that of the lowest number: rules made of a site's pages are often alike, and every
    location that meets one meets them all."""
    return patterns.groupBy("site", "regex").agg(
        F.min("rule_no").alias("rule_no"), F.max("literal").alias("literal"), *(F.min_by(c, "rule_no").alias(c) for c in ("scope",) if c in patterns.columns)
    )


def excluded_by(pages: DataFrame, rules: DataFrame, config: SearchConfig, location: str = "path") -> DataFrame:
    """Pages with ``excluded``: whether a rule ``(site, rule_no, pattern)`` of their site, or of a null site, excludes them."""
    hit = rule_matches(pages, _distinct(exclude_patterns(rules)), config, location).select("site", F.col("location").alias(location)).distinct()
    joined = split_join(pages, cut_lineage(hit.withColumn("excluded", F.lit(True))), ["site", location], "left", config)
    return joined.withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def scoped_by(pages: DataFrame, rules: DataFrame, config: SearchConfig, location: str = "path") -> DataFrame:
    """Pages with ``scope``: that of the rule ``(site, rule_no, scope, path)`` with the lowest number that applies, or the default."""
    found = rule_matches(pages, _distinct(scope_patterns(rules)), config, location)
    first = found.groupBy("site", F.col("location").alias(location)).agg(F.min_by("scope", "rule_no").alias("scope"))
    joined = split_join(pages, cut_lineage(first), ["site", location], "left", config)
    return joined.withColumn("scope", F.coalesce("scope", F.lit(DEFAULT_SCOPE)))
