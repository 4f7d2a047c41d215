"""URL filter: rules on hosts and paths, carried over to aliases of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.llm.common import LIMITS, lowered, stored
from quillseek.llm.graph import connected_components
from quillseek.operators.joins import broadcast_if_small, split_join

# The parts of an address that servers commonly redirect away.
_ALIAS_HOSTS = r"^(www|m)\."
_TRACKING = r"(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*"
_SUFFIX = r"(/|\.html?|/index\.html?)$"

_CANONICAL = (
    r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
)
_REFRESH = (
    r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\bcontent\s*=\s*[\"'][^\"'>]*?\burl\s*=\s*([^\"'\s>]+)"
)
_PARTS = r"(?s)^(.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; empty for null or no ``://``."""
    return lowered(F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def normal_form(url: Column) -> Column:
    """The address that common redirects lead to: https, no ``www.`` or ``m.``, no fragment, no tracking
    parameters, no final slash or ``.html``. Null where there is no ``://``."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&", "")
    return F.when(
        url.contains("://"),
        F.concat(
            F.lit("https://"),
            F.regexp_replace(host_of(url), _ALIAS_HOSTS, ""),
            F.regexp_replace(path_of(url), _SUFFIX, ""),
            F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        ),
    )


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` parts resolved; never above the root."""
    parts = F.split(path, "/")
    final = F.element_at(parts, -1).isin(".", "..")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, part: F.when(part == ".", done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.concat(F.array_join(kept, "/"), F.when(final, "/").otherwise(""))


def absolute(target: Column, url: Column) -> Column:
    """A link target as an address, resolved against the page's; null where it has a scheme without ``//``."""
    start = F.concat(F.regexp_extract(url, _PARTS, 1), F.lit("://"), host_of(url))
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", 1), F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", 2)
    query = F.regexp_extract(url, r"(?s)^[^#?]*(\?[^#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, _PARTS, 1), F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | ~url.contains("://"), F.lit(None))
        .when(target.startswith("#"), F.concat(start, path, query, target))
        .when(target.startswith("?"), F.concat(start, path, target))
        .when(target.startswith("/"), F.concat(start, _without_dots(own), rest))
        .otherwise(F.concat(start, _without_dots(F.concat(folder, own)), rest))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """``(src, dst)``: redirects and canonical links of the pages, and the normal form of every address."""
    seen = pages.filter(F.col("url").contains("://"))
    found = seen.select(
        "url",
        F.explode(
            F.array(
                F.regexp_extract(F.coalesce("html", F.lit("")), _CANONICAL, 1),
                F.regexp_extract(F.coalesce("html", F.lit("")), _REFRESH, 1),
            )
        ).alias("target"),
    ).filter("target != ''")
    links = found.select(F.col("url").alias("src"), absolute(F.col("target"), F.col("url")).alias("dst"))
    links = stored(links.filter("dst is not null").distinct(), "alias-links")
    nodes = seen.select("url").union(links.select("dst")).distinct()
    return links.union(nodes.select("url", normal_form(F.col("url")))).filter("src != dst")


def rule_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(url, rule, action)`` of the longest fitting rule for distinct ``urls (url)`` that have one.

    ``rules (action, rule)``; a rule is a host, ``/`` and the start of a path. It is met by equality with
    each suffix of the host, at most one row per label. Of equal rules that allow and block, the one that allows wins.
    """
    labels = F.split(host_of(F.col("url")), r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    parted = rules.select(
        "action",
        "rule",
        F.substring_index("rule", "/", 1).alias("suffix"),
        F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)").alias("start"),
    )
    asked = urls.select("url", path_of(F.col("url")).alias("path"), F.explode(suffixes).alias("suffix"))
    met = asked.join(broadcast_if_small(parted, LIMITS), "suffix").filter(F.col("path").startswith(F.col("start")))
    allowed = F.col("action") == "allow"
    best = F.max_by(F.struct("rule", "action"), F.struct(F.length("rule"), allowed, "rule")).alias("best")
    return met.groupBy("url").agg(best).select("url", "best.*")


def judged_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Every page with host, path, rule, verdict and reason.

    A page's own rule decides, so that an explicit allow holds against every alias. Without one, a page is blocked
    if any alias is: any address of its connected component over redirects, canonical links and normal forms, targets
    outside the table included. An allowed alias neither allows nor shields others. All other pages are allowed. Null and
    unparsable addresses have no aliases. Repeated pages are judged alike, each in its own row. ``rules (action, rule)``.
    """
    edges = stored(alias_edges(pages), "alias-edges")
    parts = connected_components(edges)
    nodes = pages.filter("url is not null").select("url").union(edges.select("dst")).distinct()
    own = stored(rule_verdicts(nodes, rules), "rule-verdicts")
    parts = stored(parts, "alias-parts")
    known = split_join(parts.withColumnRenamed("node", "url"), own, ["url"], "inner", LIMITS)
    spread = known.filter("action = 'block'").select("component").distinct()
    carried = split_join(parts, stored(spread, "alias-blocked"), ["component"], "left_semi", LIMITS).select(F.col("node").alias("url"), F.lit("block").alias("carried"))
    asked = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    asked = split_join(asked, own, ["url"], "left", LIMITS)
    return split_join(asked, carried, ["url"], "left", LIMITS).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", "carried", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("carried").isNotNull(), "alias").otherwise("default").alias("reason"),
    )
