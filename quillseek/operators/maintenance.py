"""Keeping the index: upsert, remove, targeted re-index, change feeds, logs.

The index is ``(site, location, scope, title, content, excerpt, language, seq, date_added)`` with one row per
(site, location). ``seq`` orders changes: an older change never replaces a newer one. ``date_added`` is when a
location was first put in. Stored state may also hold rows with ``deleted`` true, which remember at which ``seq`` a
location was removed, and ``anew`` on changes that put a location in again after a removal.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.functions.urls import stored_location
from quillseek.operators.extraction import (
    FIELDS,
    INDEXED,
    KEYS,
    RECORD,
    REJECTED,
    dated,
    deciding,
    evaluate_pages,
    invalid_reason,
)
from quillseek.operators.joins import broadcast_if_small, latest, split_join
from quillseek.session import cut_lineage
from quillseek.sources.pages import DATE


def newest(rows: DataFrame, keys: Sequence[str], gone: Column) -> DataFrame:
    """The row of the highest ``seq`` per key, with ``date_added`` and ``anew``.

    The date is the one of the first row since the key was last ``gone``, so that it stays what it was when the
    record was put in. ``anew`` says that the key was gone at some time: an older date does not hold then.
    """
    rows = dated(rows)
    restart = F.coalesce(F.col("anew"), F.lit(False)) if "anew" in rows.columns else F.lit(False)
    at = F.coalesce("seq", F.lit(-(2**63)))
    rest = [c for c in rows.columns if c not in (*keys, "date_added", "anew")]
    rows = rows.withColumns({"at": at, "gone": gone, "cut": F.when(gone | restart, at)})
    dates = F.min_by("date_added", F.when(~F.col("gone") & F.col("date_added").isNotNull(), F.col("at")))
    found = rows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), "at").alias("last"), F.max("cut").alias("cut"), F.min(F.when(~F.col("gone"), F.col("at"))).alias("start"),
        F.max_by("gone", "at").alias("gone"), dates.alias("date_added"),
    )
    # Keys that were put in, gone and put in again among these rows: their dates count from the last time.
    again = found.filter((F.col("start") < F.col("cut")) & ~F.col("gone")).select(*keys, F.col("cut").alias("since"))
    since = rows.join(again, keys).filter(F.col("at") >= F.col("since")).groupBy(*keys).agg(dates.alias("later"), F.lit(True).alias("redone"))
    date = F.when(F.col("redone"), F.col("later")).when(~F.col("gone"), F.col("date_added")).alias("date_added")
    return found.join(since, keys, "left").select(*keys, *(f"last.{c}" for c in rest), date, F.col("cut").isNotNull().alias("anew"))


_MANY_SITES = 256  # above this a scan is not narrowed to the sites asked for


def upsert(index: DataFrame, records: DataFrame, config: SearchConfig) -> DataFrame:
    """The index with the records put in, the highest ``seq`` per location winning.

    A record keeps the ``date_added`` of the one it replaces, unless the location was removed in between.
    Only the records are grouped, and written down once because three joins read them. The index's keys and orders are
    met once; its wide rows are filtered by an anti join, and move only if the records are too many to broadcast.
    """
    gone = F.col("deleted") if "deleted" in records.columns else F.lit(False)
    columns = index.columns if {"date_added"} & {*index.columns, *records.columns} else None
    last = cut_lineage(newest(records, KEYS, gone))
    arriving = broadcast_if_small(last.select(*KEYS, F.col("seq").alias("new_seq")), config)
    # A row without an order is older than any other.
    order = lambda name: F.coalesce(F.col(name), F.lit(-(2**63)))
    live = F.lit(True) if "deleted" not in index.columns else ~F.col("deleted")
    stored = dated(index).select(*KEYS, "seq", F.when(live, F.col("date_added")).alias("old_date"))
    met = stored.join(arriving, KEYS).select(*KEYS, "old_date", (order("seq") <= order("new_seq")).alias("replaced"))
    met = cut_lineage(met)  # no more rows than arrive
    replaced = met.filter("replaced")
    kept = index.join(broadcast_if_small(replaced.select(*KEYS), config), KEYS, "left_anti")
    fresh = last.join(met.filter("not replaced").select(*KEYS), KEYS, "left_anti").join(replaced.select(*KEYS, "old_date"), KEYS, "left")
    gone = F.col("deleted") if "deleted" in last.columns else F.lit(False)
    date = F.when(gone, F.lit(None)).when(F.col("anew"), F.col("date_added")).otherwise(F.coalesce("old_date", "date_added"))
    fresh = fresh.withColumn("date_added", date).drop("old_date")
    if columns is None:
        return kept.unionByName(fresh.select(*index.columns))
    kept = dated(kept)
    if "anew" in index.columns:
        kept = kept.withColumn("anew", F.coalesce("anew", F.lit(False)))
    return kept.unionByName(fresh.select(*kept.columns))


def carried_dates(records: DataFrame, index: DataFrame) -> DataFrame:
    """Records with the ``date_added`` that the index has of their locations, else their own."""
    old = dated(index).filter(F.col("date_added").isNotNull()).select(*KEYS, F.col("date_added").alias("old_date"))
    rows = dated(records)
    return rows.join(old, KEYS, "left").withColumn("date_added", F.coalesce("old_date", "date_added")).select(*rows.columns)


def remove(
    index: DataFrame, targets: DataFrame, config: SearchConfig, with_scope: bool = False
) -> DataFrame:
    """The index without the targets, matched by location and, if asked, scope."""
    keys = [*KEYS, "scope"] if with_scope else KEYS
    return index.join(broadcast_if_small(targets.select(*keys).distinct(), config), keys, "left_anti")


def clear(index: DataFrame) -> DataFrame:
    return index.limit(0)


def validate(records: DataFrame) -> DataFrame:
    """Records with ``reason``: null where the record can be saved."""
    return records.withColumn("reason", invalid_reason())


def as_changes(evaluated: DataFrame) -> DataFrame:
    """Evaluated pages as state rows: a record where indexed, a deletion where rejected."""
    decided = deciding(evaluated.select(*RECORD, "url", "outcome"))
    gone = F.col("outcome") == REJECTED
    fields = [F.when(~gone, F.col(c)).otherwise(F.lit("")).alias(c) for c in FIELDS]
    date = F.when(~gone, F.col("date_added")).alias("date_added")
    return decided.select(*KEYS, *fields, "seq", date, gone.alias("deleted"), F.lit(False).alias("anew"))


def visible(state: DataFrame) -> DataFrame:
    """What readers see: no deletions."""
    return state.filter(~F.col("deleted")).select(*RECORD)


def as_state(index: DataFrame) -> DataFrame:
    return dated(index).select(*RECORD, F.lit(False).alias("deleted"), F.lit(False).alias("anew"))


def reindex(
    index: DataFrame,
    requested: DataFrame,
    pages: DataFrame,
    config: SearchConfig,
    robots: DataFrame | None = None,
) -> DataFrame:
    """The index after the requested ``(site, path)`` pages are read again.

    Accepted pages are put in, rejected or missing ones removed, pages without title or content leave
    the older record as it is.
    """
    if not config.indexing_enabled:
        return index
    changes = cut_lineage(requested_changes(requested, pages, config, robots))
    # A re-read decides whatever the stored record's order is.
    index, keys = dated(index), broadcast_if_small(changes.select(*KEYS), config)
    replaced = index.join(keys, KEYS, "left_anti")
    old = index.select(*KEYS, "date_added").join(keys, KEYS, "left_semi")
    return replaced.unionByName(carried_dates(visible(changes), old))


def requested_changes(
    requested: DataFrame, pages: DataFrame, config: SearchConfig, robots: DataFrame | None = None
) -> DataFrame:
    """State rows that re-reading the requested ``(site, path)`` pages gives.

    Pages are read once. If the requests are for few sites, their names go into the scan, which then skips the files of
    other sites where pages are stored by site.
    """
    wanted = cut_lineage(requested.select("site", "path").distinct())
    sites = [r["site"] for r in wanted.select("site").distinct().limit(_MANY_SITES + 1).collect()]
    if len(sites) <= _MANY_SITES:
        pages = pages.filter(F.col("site").isin(*(s for s in sites if s is not None)))
    sought = broadcast_if_small(wanted, config)
    read = evaluate_pages(pages.join(sought, ["site", "path"], "left_semi"), config, robots)
    read = cut_lineage(read.select(*RECORD, "url", "outcome"))
    found = as_changes(read)
    places = wanted.select("site", stored_location(F.col("path")).alias("location")).distinct()
    missing = places.join(read.select(*KEYS).distinct(), KEYS, "left_anti").select(
        *KEYS,
        *[F.lit("").alias(c) for c in FIELDS],
        F.lit(0).cast("long").alias("seq"),
        F.lit(None).cast(DATE).alias("date_added"),
        F.lit(True).alias("deleted"),
        F.lit(False).alias("anew"),
    )
    return found.unionByName(missing)


def latest_changes(feed: DataFrame) -> DataFrame:
    """The last change of every (site, path) of a feed ``(seq, module, site, path, op[, date_added])``, with the
    time of the first save since the last delete."""
    rows = dated(feed).select("site", "path", "seq", "op", F.col("date_added").cast(DATE).alias("date_added"))
    return newest(rows, ["site", "path"], F.col("op") == "delete")


def feed_changes(
    feed: DataFrame, pages: DataFrame, config: SearchConfig, robots: DataFrame | None = None
) -> DataFrame:
    """A gated change feed as state rows carrying the feed's ``seq`` and, if it has one, ``date_added``.

    Saves read the page again, deletes remove it. With indexing disabled saves are ignored while
    deletes still apply.
    """
    if not config.indexing_enabled:
        feed = feed.filter(F.col("op") == "delete")
    last = cut_lineage(latest_changes(feed))
    order = last.select(
        "site", stored_location(F.col("path")).alias("location"), F.col("seq").alias("feed_seq"),
        F.col("date_added").alias("feed_date"), F.col("anew").alias("feed_anew"),
    )
    saves = requested_changes(last.filter(F.col("op") == "save"), pages, config, robots)
    date = F.when(~F.col("deleted"), F.coalesce("feed_date", "date_added"))
    read = saves.join(order, KEYS).withColumns({"seq": F.col("feed_seq"), "date_added": date, "anew": F.col("feed_anew")})
    deletes = last.filter(F.col("op") == "delete").select(
        "site",
        stored_location(F.col("path")).alias("location"),
        *[F.lit("").alias(c) for c in FIELDS],
        "seq",
        F.lit(None).cast(DATE).alias("date_added"),
        F.lit(True).alias("deleted"),
        "anew",
    )
    return latest(read.drop("feed_seq", "feed_date", "feed_anew").unionByName(deletes), KEYS, ["seq"])


def choose_source(
    listed: DataFrame, crawled: DataFrame, config: SearchConfig
) -> DataFrame:
    """``(site, path)`` to index. With ``auto`` each site's sitemap is used if it lists anything,
    and the crawled pages otherwise, decided for all sites in one plan."""
    if config.index_method == "sitemap":
        return listed.select("site", "path").distinct()
    if config.index_method == "crawl":
        return crawled.select("site", "path").distinct()
    with_sitemap = listed.select("site").distinct()
    rest = split_join(crawled.select("site", "path"), with_sitemap, ["site"], "left_anti", config)
    return listed.select("site", "path").unionByName(rest).distinct()


def index_log(evaluated: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``(site, location, status, message)``: what indexing the pages did.

    Answers with an error code and records that cannot be saved are errors, saved records are
    ``indexed``, and records the index held of pages that are now rejected are ``removed``.
    """
    evaluated = cut_lineage(
        evaluated.select(*KEYS, "seq", "url", "status", "outcome", "reason")
    )
    error = (F.col("reason") == "http error") | F.col("reason").endswith("required")
    errors = evaluated.filter((F.col("outcome") == REJECTED) & error).select(
        *KEYS,
        F.lit("error").alias("status"),
        F.when(F.col("reason") == "http error", F.concat(F.lit("HTTP Code "), F.col("status").cast("string")))
        .otherwise(F.col("reason"))
        .alias("message"),
    )
    decided = deciding(evaluated)
    saved = decided.filter(F.col("outcome") == INDEXED).select(
        *KEYS, F.lit("indexed").alias("status"), F.lit("").alias("message")
    )
    log = errors.unionByName(saved)
    if index is not None:
        gone = decided.filter(F.col("outcome") == REJECTED).join(
            index.select(*KEYS), KEYS, "left_semi"
        )
        log = log.unionByName(
            gone.select(*KEYS, F.lit("removed").alias("status"), F.lit("").alias("message"))
        )
    return log


def log_report(log: DataFrame, statuses: tuple[str, ...] = ("error", "removed", "indexed")) -> DataFrame:
    """Entries per status, in the order of the report."""
    rank = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status")).cast("int")
    return (
        log.filter(F.col("status").isin(*statuses))
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("entries"))
        .withColumn("position", rank)
        .orderBy("position")
    )


def log_listing(log: DataFrame, statuses: tuple[str, ...] = ("error", "removed", "indexed")) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in statuses]), F.col("status"))
    return log.filter(F.col("status").isin(*statuses)).orderBy(rank, "site", "location")


def find_by_location(index: DataFrame, wanted: DataFrame, config: SearchConfig) -> DataFrame:
    """Records of the wanted (site, location) pairs."""
    keys = broadcast_if_small(wanted.select(*KEYS).distinct(), config)
    return index.join(keys, KEYS, "left_semi")


def record_id(site: Column, location: Column) -> Column:
    """A number that stands for a location wherever it is read: 60 bits of a digest of its key."""
    return F.conv(F.substring(F.md5(F.concat_ws(" ", site, location)), 1, 15), 16, 10).cast("long")


def index_listing(index: DataFrame) -> DataFrame:
    """The index as its administrators list it, in order of location."""
    number = record_id(F.col("site"), F.col("location")).alias("id")
    return dated(index).select(number, "site", "location", "scope", "title", "date_added").orderBy("location", "site")
