"""Pages to index records: one projection pipeline, no shuffle before copies are resolved."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.functions import html as H
from quillseek.functions.text import clean, decode_entities, format_title, is_blank
from quillseek.functions.urls import is_local, stored_location
from quillseek.operators.eligibility import early_reason, robots_marked, scope_of
from quillseek.operators.joins import latest
from quillseek.sources.pages import DATE

KEYS = ["site", "location"]
FIELDS = ["scope", "title", "content", "excerpt", "language"]
RECORD = [*KEYS, *FIELDS, "seq", "date_added"]

# Outcomes of a page.
INDEXED = "indexed"  # a record is written
SKIPPED = "skipped"  # accepted, but without title or content: an older record stays
REJECTED = "rejected"  # an older record is removed


@lru_cache(maxsize=32)
def _raw_columns(config: SearchConfig) -> tuple[tuple[Column, ...], dict[str, Column]]:
    """Columns read from ``body`` (scripts removed) and ``page`` (comments removed as well).

    They depend on the settings only; building them once keeps planning short.
    """
    body, page = F.col("body"), F.col("page")
    delimiters = [H.parse_field(d) for d in config.delimiters]
    titles = [H.parse_field(t) for t in config.title_tags]
    excerpts = [H.parse_field(t) for t in config.excerpt_tags]
    languages = [H.parse_field(t) for t in config.language_tags]
    plain_title, kept_title = H.first_matched(page, titles), None
    if config.preserve_title_html:
        plain_title, kept_title = F.lit(None).cast("string"), H.first_inner_html(page, titles)
    # All texts in one array of arrays, so that decoding is one expression however many there are.
    first = [plain_title, H.first_matched(page, excerpts), H.first_matched(page, languages)]
    groups = F.array(F.array(*first), *[H.matched(page, d) for d in delimiters])
    decoded = F.transform(groups, lambda group: F.transform(group, decode_entities))
    read = (
        H.robots_meta(body, "noindex").alias("noindex"),
        H.robots_meta(body, "nofollow").alias("nofollow"),
        H.links(body).alias("links"),
        decoded.alias("texts"),
        *([] if kept_title is None else [kept_title.alias("raw_title")]),
    )
    texts = F.col("texts")
    parts = {
        **({"raw_title": texts[0][0]} if kept_title is None else {}),
        "raw_excerpt": texts[0][1],
        "raw_language": texts[0][2],
        "raw_content": H.join_content(
            [texts[i + 1] for i in range(len(delimiters))], config.separator
        ),
    }
    return read, parts


def dated(rows: DataFrame) -> DataFrame:
    """With ``date_added``, null where the rows come without it."""
    return rows if "date_added" in rows.columns else rows.withColumn("date_added", F.lit(None).cast(DATE))


def extract_fields(pages: DataFrame, config: SearchConfig) -> DataFrame:
    """Raw fields, robots flags and links of every page that is not ``blocked``; the HTML ends here."""
    early = F.when(F.col("status") >= 400, F.lit("http error")).otherwise(
        early_reason(F.col("path"), F.col("site"), config)
    )
    read, parts = _raw_columns(config)
    return (
        dated(pages).withColumn("early", early)
        # Pages that are out already cost nothing more: every expression below is null on null.
        .withColumn("body", F.when(F.col("early").isNull() & ~F.col("blocked"), H.strip_scripts(F.col("html"))))
        .withColumn("page", H.strip_comments(F.col("body")))
        .select("site", "path", "url", "status", "seq", "date_added", "early", "blocked", *read)
        .withColumns(parts)
        .drop("texts")
    )


@lru_cache(maxsize=32)
def _record_columns(config: SearchConfig) -> tuple[Column, tuple[Column, ...]]:
    funcs = config.cleaning_funcs
    title = F.col("raw_title")
    if not config.preserve_title_html:
        title = format_title(title, config.title_limit, funcs)
    cleaned = F.transform(F.array("raw_content", "raw_excerpt"), lambda text: clean(text, funcs=funcs))
    # Outcomes depend on the cleaned texts. Passing these through a one-element explode keeps filters on
    # the outcome from being pushed below the extraction, which would compute the texts twice.
    held = F.explode(F.array(F.struct(title.alias("title"), F.col("cleaned")[0].alias("content"))))
    return cleaned, (
        stored_location(F.col("path")).alias("location"),
        scope_of(F.col("path"), config.scope_rules).alias("scope"),
        F.col("cleaned")[1].alias("excerpt"),
        clean(F.col("raw_language"), encode=True, funcs=funcs).alias("language"),
        F.coalesce(
            F.col("early"),
            F.when(F.col("blocked"), F.lit("robots")),
            F.when(F.col("noindex"), F.lit("noindex")),
        ).alias("early"),
        (is_blank(F.col("raw_title")) | is_blank(F.col("raw_content"))).alias("empty"),
        held.alias("held"),
    )


@lru_cache(maxsize=1)
def _outcome_columns() -> dict[str, Column]:
    problem = invalid_reason()
    early = F.col("early")
    return {
        "outcome": F.when(early.isNotNull(), F.lit(REJECTED))
        .when(F.col("empty"), F.lit(SKIPPED))
        .when(problem.isNotNull(), F.lit(REJECTED))
        .otherwise(F.lit(INDEXED)),
        "reason": F.when(early.isNotNull(), early)
        .when(F.col("empty"), F.lit("no title or content"))
        .otherwise(problem),
    }


def evaluate_pages(
    pages: DataFrame, config: SearchConfig, robots: DataFrame | None = None
) -> DataFrame:
    """Every page with its record fields, its outcome and, if there is no record, the reason."""
    raw = extract_fields(robots_marked(pages, robots, config), config)
    cleaned, columns = _record_columns(config)
    return (
        raw.withColumn("cleaned", cleaned)
        .select("site", "path", "url", "status", "seq", "date_added", "nofollow", "links", *columns)
        .select("*", "held.title", "held.content")
        .withColumns(_outcome_columns())
        .drop("held", "early", "empty")
    )


def invalid_reason() -> Column:
    """Why a cleaned record cannot be saved; null if it can."""
    checks = F.when(~is_local(F.col("location"), F.col("site")), F.lit("not local"))
    for name in ("location", "scope", "title", "content"):
        checks = checks.when(F.coalesce(F.col(name), F.lit("")) == "", F.lit(f"{name} required"))
    return checks.otherwise(F.lit(None).cast("string"))


def deciding(evaluated: DataFrame) -> DataFrame:
    """The page that decides each location: the last one that is not skipped."""
    decisive = evaluated.filter(F.col("outcome") != SKIPPED)
    return latest(decisive, KEYS, ["seq", "url"])


def index_records(
    pages: DataFrame, config: SearchConfig, robots: DataFrame | None = None
) -> DataFrame:
    """One record per location."""
    evaluated = evaluate_pages(pages, config, robots).select(*RECORD, "url", "outcome")
    return deciding(evaluated).filter(F.col("outcome") == INDEXED).select(*RECORD)
