"""Index maintenance queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import (
    PAGE_CONFIG,
    PAGE_ROWS_SQL,
    RECORD_COLUMNS,
    TAGGED_SQL,
    pages,
    records_sql,
    table,
    tagged_pages,
)
from quillseek.functions.urls import stored_location
from quillseek.operators.eligibility import gated
from quillseek.operators.extraction import evaluate_pages, index_records
from quillseek.operators.maintenance import (
    as_state,
    choose_source,
    clear,
    feed_changes,
    find_by_location,
    index_listing,
    index_log,
    log_listing,
    log_report,
    reindex,
    remove,
    upsert,
    validate,
    visible,
)
from quillseek.plans.indexing import rebuild_index
from quillseek.session import scratch_path
from quillseek.sources.index_log import append_log, read_log
from quillseek.sources.index_store import append_changes, clear_index, compact, expire, lookup, read_index, rebuild
from quillseek.sources.pages import listed_pages
from quillseek.streaming.changes import index_stream

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str):
    def register(build):
        QUERIES[name] = build
        ORACLE[name] = sql
        return build

    return register



_RECORDS = f"WITH {PAGE_ROWS_SQL}, {records_sql()}"


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return index_records(pages(spark, folder), PAGE_CONFIG)


@query(
    "index_upsert",
    f"""{_RECORDS},
    incoming AS (SELECT * REPLACE ('new' AS scope, seq + CASE WHEN seq % 2 = 0 THEN 10 ELSE -10 END AS seq)
      FROM records WHERE seq % 3 = 0),
    stored AS (SELECT * FROM records WHERE seq % 5 <> 0),
    every AS (SELECT * FROM stored UNION ALL SELECT * REPLACE (date_added + INTERVAL 1 DAY AS date_added) FROM incoming)
    SELECT {RECORD_COLUMNS.replace("date_added", "coalesce(kept, date_added) AS date_added")} FROM every
    LEFT JOIN (SELECT site, location, date_added AS kept FROM stored) USING (site, location)
    QUALIFY row_number() OVER (PARTITION BY site, location ORDER BY seq DESC) = 1""",
)
def index_upsert(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    shifted = F.col("seq") + F.when(F.col("seq") % 2 == 0, 10).otherwise(-10)
    later = F.col("date_added") + F.expr("INTERVAL 1 DAY")
    incoming = records.filter(F.col("seq") % 3 == 0).withColumns(
        {"scope": F.lit("new"), "seq": shifted, "date_added": later}
    )
    # The same change twice: the later one wins.
    copies = incoming.unionByName(incoming.withColumns({"scope": F.lit("old"), "seq": F.col("seq") - 1}))
    return upsert(records.filter(F.col("seq") % 5 != 0), copies, PAGE_CONFIG)


@query("index_remove", f"{_RECORDS} SELECT {RECORD_COLUMNS} FROM records WHERE seq % 4 <> 0")
def index_remove(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    return remove(records, records.filter(F.col("seq") % 4 == 0), PAGE_CONFIG)


@query(
    "index_remove_scope",
    f"{_RECORDS} SELECT {RECORD_COLUMNS} FROM records WHERE NOT (seq % 4 = 0 AND scope = 'english')",
)
def index_remove_scope(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    targets = records.filter(F.col("seq") % 4 == 0).withColumn("scope", F.lit("english"))
    return remove(records, targets, PAGE_CONFIG, with_scope=True)


@query("index_clear", f"{_RECORDS} SELECT {RECORD_COLUMNS} FROM records WHERE false")
def index_clear(spark: SparkSession, folder: str) -> DataFrame:
    """A stored index, cleared and read again."""
    root = scratch_path(spark, "cleared")
    rebuild(_records(spark, folder), root)
    clear_index(spark, root)
    return read_index(spark, root, PAGE_CONFIG)


_TAGGED_RECORDS = f"""WITH {TAGGED_SQL}, live AS (
  SELECT page_id, url, html, site, path FROM tagged WHERE status < 400 AND page_id % 4 <> 0),
{records_sql('live', 'fresh')}, {records_sql('page_rows', 'records')}"""


@query(
    "index_targeted",
    f"""{_TAGGED_RECORDS},
    asked AS (SELECT DISTINCT site, path FROM page_rows WHERE page_id % 3 = 0),
    decided AS (
      SELECT t.site, CASE WHEN t.path = '' THEN 'home' ELSE t.path END AS location, t.page_id
      FROM tagged t JOIN asked a ON a.site = t.site AND a.path = t.path
      QUALIFY row_number() OVER (PARTITION BY t.site, t.path ORDER BY t.page_id DESC) = 1),
    base AS (SELECT * FROM records WHERE seq % 2 = 0)
    SELECT {RECORD_COLUMNS} FROM base b WHERE NOT EXISTS (
      SELECT 1 FROM decided d WHERE d.site = b.site AND d.location = b.location)
    UNION ALL
    SELECT {RECORD_COLUMNS.replace("date_added", "coalesce(kept, date_added) AS date_added")} FROM fresh f
    LEFT JOIN (SELECT site, location, date_added AS kept FROM base) USING (site, location) WHERE EXISTS (
      SELECT 1 FROM decided d WHERE d.site = f.site AND d.location = f.location AND d.page_id = f.seq)""",
)
def index_targeted(spark: SparkSession, folder: str) -> DataFrame:
    """A third of the pages listed for re-indexing, some of which now fail or refuse."""
    rows = tagged_pages(spark, folder)
    listing = rows.filter(F.col("seq") % 3 == 0).select(
        "site", F.concat("path", F.lit(",no/such/page,"), "url").alias("pages")
    )
    base = _records(spark, folder).filter(F.col("seq") % 2 == 0)
    return reindex(base, listed_pages(listing, PAGE_CONFIG), rows, PAGE_CONFIG)


@query(
    "index_source_choice",
    f"""WITH {PAGE_ROWS_SQL}, listed AS (SELECT site, path FROM page_rows WHERE page_id % 4 = 0)
    SELECT site, path FROM listed UNION
    SELECT site, path FROM page_rows WHERE site NOT IN (SELECT site FROM listed)""",
)
def index_source_choice(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages(spark, folder).select("site", "path", "seq")
    auto = replace(PAGE_CONFIG, index_method="auto")
    return choose_source(rows.filter(F.col("seq") % 4 == 0), rows, auto)


@query(
    "index_validation",
    f"""{_RECORDS}, marred AS (SELECT seq, site,
      CASE WHEN seq % 7 = 0 THEN 'https://elsewhere.example/' || location ELSE location END AS location,
      CASE WHEN seq % 11 = 0 THEN '' ELSE title END AS title,
      CASE WHEN seq % 13 = 0 THEN NULL ELSE content END AS content FROM records)
    SELECT seq, site, location, CASE WHEN seq % 7 = 0 THEN 'not local' WHEN title = '' THEN 'title required'
      WHEN coalesce(content, '') = '' THEN 'content required' END AS reason FROM marred""",
)
def index_validation(spark: SparkSession, folder: str) -> DataFrame:
    seq = F.col("seq")
    marred = _records(spark, folder).withColumns(
        {
            "location": F.when(seq % 7 == 0, F.concat(F.lit("https://elsewhere.example/"), "location")).otherwise(F.col("location")),
            "title": F.when(seq % 11 == 0, "").otherwise(F.col("title")),
            "content": F.when(seq % 13 == 0, F.lit(None)).otherwise(F.col("content")),
        }
    )
    return validate(marred).select("seq", "site", "location", "reason")


_LOG = f"""{_TAGGED_RECORDS},
decided AS (
  SELECT site, CASE WHEN path = '' THEN 'home' ELSE path END AS location, page_id, status FROM tagged
  QUALIFY row_number() OVER (PARTITION BY site, path ORDER BY page_id DESC) = 1),
log AS (
  SELECT site, CASE WHEN path = '' THEN 'home' ELSE path END AS location, 'error' AS status,
    'HTTP Code 404' AS message FROM tagged WHERE status = 404
  UNION ALL
  SELECT d.site, d.location, 'indexed', '' FROM decided d JOIN fresh f ON f.seq = d.page_id
  UNION ALL
  SELECT d.site, d.location, 'removed', '' FROM decided d JOIN records r ON r.site = d.site AND r.location = d.location
  WHERE d.page_id NOT IN (SELECT seq FROM fresh))"""


@query("index_log", f"{_LOG} SELECT site, location, status, message FROM log")
def index_log_(spark: SparkSession, folder: str) -> DataFrame:
    """The log of indexing the pages again, written and read back in report order."""
    path = scratch_path(spark, "log")
    log = index_log(evaluate_pages(tagged_pages(spark, folder), PAGE_CONFIG), _records(spark, folder))
    append_log(log, path)
    return log_listing(read_log(spark, path))


@query(
    "index_log_counts",
    f"""{_LOG} SELECT status, count(*) AS entries,
    CAST(CASE status WHEN 'error' THEN 1 WHEN 'removed' THEN 2 ELSE 3 END AS INT) AS position FROM log GROUP BY status""",
)
def index_log_counts(spark: SparkSession, folder: str) -> DataFrame:
    evaluated = evaluate_pages(tagged_pages(spark, folder), PAGE_CONFIG)
    return log_report(index_log(evaluated, _records(spark, folder)))


@query(
    "index_compacted",
    f"""{_RECORDS},
    changed AS (SELECT * FROM records WHERE seq % 2 = 1 AND site IN (SELECT site FROM records WHERE seq % 25 = 0))
    SELECT {RECORD_COLUMNS} FROM records WHERE seq % 2 = 0 AND NOT (site IN (SELECT site FROM records WHERE seq % 25 = 0) AND seq % 6 = 0)
    UNION ALL SELECT {RECORD_COLUMNS} FROM changed""",
)
def index_compacted(spark: SparkSession, folder: str) -> DataFrame:
    """Changes of some sites, folded into a stored index and read again; what older versions alone need is removed."""
    root = scratch_path(spark, "compacted")
    records = _records(spark, folder)
    base = records.filter(F.col("seq") % 2 == 0)
    rebuild(base, root)
    some = records.filter(F.col("seq") % 25 == 0).select("site").distinct()
    added = records.filter(F.col("seq") % 2 == 1).join(some, "site", "left_semi")
    gone = base.filter(F.col("seq") % 6 == 0).join(some, "site", "left_semi").withColumn("seq", F.col("seq") + 1)
    append_changes(as_state(added).unionByName(as_state(gone).withColumn("deleted", F.lit(True))), root, 0)
    compact(spark, root, PAGE_CONFIG)
    expire(spark, root, keep=1)
    return read_index(spark, root, PAGE_CONFIG)


@query(
    "stored_lookup",
    f"""{_RECORDS} SELECT {RECORD_COLUMNS} FROM records WHERE (site, location) IN (
      SELECT site, CASE WHEN path = '' THEN 'home' ELSE path END FROM page_rows WHERE page_id IN (SELECT user_id FROM events WHERE event_type = 'signup'))""",
)
def stored_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Records of a stored index by location: only the files of their slices are opened."""
    root = scratch_path(spark, "lookup")
    rebuild(_records(spark, folder), root)
    asked = table(spark, folder, "events").filter(F.col("event_type") == "signup").select(F.col("user_id").alias("seq")).distinct()
    wanted = pages(spark, folder).join(asked, "seq").select("site", stored_location(F.col("path")).alias("location"))
    return lookup(spark, root, wanted, PAGE_CONFIG)


@query("index_rebuild_swap", f"{_RECORDS} SELECT {RECORD_COLUMNS} FROM records")
def index_rebuild_swap(spark: SparkSession, folder: str) -> DataFrame:
    """A partial index is live, a full rebuild replaces it, and an empty rebuild changes nothing."""
    root = scratch_path(spark, "index")
    records = _records(spark, folder)
    rebuild(records.filter(F.col("seq") % 2 == 0), root)
    rebuild(records, root)
    rebuild(clear(records), root)
    return read_index(spark, root, PAGE_CONFIG)


@query(
    "index_from_sitemap",
    f"""{_RECORDS}, listed AS (
      SELECT DISTINCT site, CASE WHEN path = '' THEN 'home' ELSE path END AS location FROM page_rows WHERE page_id % 2 = 0)
    SELECT {RECORD_COLUMNS} FROM records WHERE EXISTS (
      SELECT 1 FROM listed l WHERE l.site = records.site AND l.location = records.location)""",
)
def index_from_sitemap(spark: SparkSession, folder: str) -> DataFrame:
    """A full rebuild of the pages that the sites' sitemaps list."""
    root = scratch_path(spark, "index")
    rows = pages(spark, folder)
    listed = rows.filter(F.col("seq") % 2 == 0).select("site", "path")
    rebuild_index(rows, root, replace(PAGE_CONFIG, index_method="sitemap"), listed=listed)
    return read_index(spark, root, PAGE_CONFIG)


_FEED = f"""{_RECORDS},
feed AS (
  SELECT e.event_id AS seq, e.ts, p.site, CASE WHEN p.path = '' THEN 'home' ELSE p.path END AS location, CASE WHEN e.event_type = 'error' THEN 'delete' ELSE 'save' END AS op
  FROM events e JOIN page_rows p ON p.page_id = e.user_id
  WHERE e.event_type <> 'view'),
cuts AS (SELECT site, location, max(seq) FILTER (op = 'delete') AS cut FROM feed GROUP BY ALL),
firsts AS (SELECT f.site, f.location, arg_min(f.ts, f.seq) AS ts FROM feed f JOIN cuts USING (site, location)
  WHERE f.seq > coalesce(cut, -1) GROUP BY ALL),
last AS (
  SELECT f.site, f.location, f.seq, f.op, cut, firsts.ts FROM feed f JOIN cuts USING (site, location) LEFT JOIN firsts USING (site, location)
  QUALIFY row_number() OVER (PARTITION BY f.site, f.location ORDER BY f.seq DESC) = 1)
SELECT {RECORD_COLUMNS} FROM (
  SELECT r.* REPLACE (-1 AS seq) FROM records r WHERE r.seq % 2 = 0 AND NOT EXISTS (
    SELECT 1 FROM last l WHERE l.site = r.site AND l.location = r.location)
  UNION ALL
  SELECT r.* REPLACE (l.seq AS seq, CASE WHEN cut IS NULL AND r.seq % 2 = 0 THEN date_added ELSE CAST(l.ts AS TIMESTAMP) END AS date_added)
  FROM records r JOIN last l ON l.site = r.site AND l.location = r.location
  WHERE l.op = 'save')"""


def _feed(events: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Events as content changes of the page numbered like their user. Views are changes of the search
    module, which never count."""
    rows = pages(spark, folder).select("site", "path", F.col("seq").alias("user_id"))
    return events.join(rows, "user_id").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", "search").otherwise("blog").alias("module"),
        "site",
        "path",
        F.when(F.col("event_type") == "error", "delete").otherwise("save").alias("op"),
        F.col("ts").cast("timestamp_ntz").alias("date_added"),
    )


def _base(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).filter(F.col("seq") % 2 == 0).withColumn("seq", F.lit(-1).cast("long"))


@query("change_feed_batch", _FEED)
def change_feed_batch(spark: SparkSession, folder: str) -> DataFrame:
    feed = gated(_feed(table(spark, folder, "events"), spark, folder), PAGE_CONFIG)
    changes = feed_changes(feed, pages(spark, folder), PAGE_CONFIG)
    return visible(upsert(as_state(_base(spark, folder)), changes, PAGE_CONFIG))


@query("change_feed_stream", _FEED)
def change_feed_stream(spark: SparkSession, folder: str) -> DataFrame:
    root = scratch_path(spark, "index")
    rebuild(_base(spark, folder), root)
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{folder}/events.parquet*")
    stream = index_stream(_feed(events, spark, folder), pages(spark, folder), root, PAGE_CONFIG, once=True)
    stream.awaitTermination()
    return read_index(spark, root, PAGE_CONFIG)


@query(
    "find_by_location",
    f"""{_RECORDS} SELECT {RECORD_COLUMNS} FROM records WHERE (site, location) IN (
      SELECT site, path FROM page_rows WHERE page_id IN (SELECT user_id FROM events WHERE event_type = 'purchase'))""",
)
def find_by_location_(spark: SparkSession, folder: str) -> DataFrame:
    buyers = table(spark, folder, "events").filter(F.col("event_type") == "purchase")
    wanted = pages(spark, folder).join(buyers.select(F.col("user_id").alias("seq")).distinct(), "seq")
    return find_by_location(
        _records(spark, folder), wanted.select("site", F.col("path").alias("location")), PAGE_CONFIG
    )


@query(
    "index_listing",
    f"""{_RECORDS} SELECT CAST('0x' || substr(md5(site || ' ' || location), 1, 15) AS BIGINT) AS id, site, location, scope, title, date_added
    FROM records""",
)
def index_listing_(spark: SparkSession, folder: str) -> DataFrame:
    return index_listing(_records(spark, folder))


