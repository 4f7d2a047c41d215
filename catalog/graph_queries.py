"""Link graph and sitemap queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import PAGE_CONFIG, PAGE_ROWS_SQL, RECORD_COLUMNS, TAGGED_SQL, pages, records_sql, table
from quillseek.functions.urls import absolute_url, stored_location
from quillseek.operators.crawl import crawl, discovered
from quillseek.operators.extraction import evaluate_pages, index_records
from quillseek.operators.links import broken_links as find_broken
from quillseek.operators.links import link_edges
from quillseek.plans.indexing import full_index
from quillseek.session import scratch_path
from quillseek.sources.sitemaps import read_sitemap_files, sitemap_list, sitemap_locations, write_sitemap

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str):
    def register(build):
        QUERIES[name] = build
        ORACLE[name] = sql
        return build

    return register


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A connected graph with cycles over the page numbers: i links to 2i+1, 2i+2 and i mod 7."""
    site = F.lit("https://graph.example").alias("site")
    ids = table(spark, folder, "pages").select("page_id")
    name = lambda c: F.concat(F.lit("p"), c)
    targets = F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2, F.col("page_id") % 7)
    edges = ids.select(site, name(F.col("page_id")).alias("src"), F.explode(targets).alias("t")).select(
        "site", "src", name(F.col("t")).alias("dst")
    )
    nodes = ids.select(site, name(F.col("page_id")).alias("location"))
    return edges, nodes, nodes.filter(F.col("location") == "p0")


def _crawl_sql(depth: int) -> str:
    return f"""WITH RECURSIVE edges AS (
      SELECT page_id AS src, unnest([page_id * 2 + 1, page_id * 2 + 2, page_id % 7]) AS dst FROM pages),
    reached(id, depth) AS (
      SELECT page_id, 0 FROM pages WHERE page_id = 0
      UNION
      SELECT e.dst, r.depth + 1 FROM reached r JOIN edges e ON e.src = r.id
      JOIN pages p ON p.page_id = e.dst WHERE r.depth + 1 < {depth})
    SELECT 'https://graph.example' AS site, 'p' || id AS location, CAST(min(depth) AS INT) AS depth
    FROM reached GROUP BY id"""


@query("crawl_reachable", _crawl_sql(40))
def crawl_reachable(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes, roots = _graph(spark, folder)
    return crawl(edges, nodes, roots)


@query("crawl_depth_2", _crawl_sql(2))
def crawl_depth_2(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes, roots = _graph(spark, folder)
    return crawl(edges, nodes, roots, depth=2)


@query(
    "crawl_discovered",
    """WITH near AS (SELECT 0 AS id UNION SELECT 1 UNION SELECT 2), edges AS (
      SELECT page_id AS src, unnest([page_id * 2 + 1, page_id * 2 + 2, page_id % 7]) AS dst FROM pages)
    SELECT 'https://graph.example' AS site, 'p' || dst AS location FROM edges
    WHERE src IN (SELECT id FROM near JOIN pages ON page_id = id) UNION
    SELECT 'https://graph.example', 'p0'""",
)
def crawl_discovered(spark: SparkSession, folder: str) -> DataFrame:
    edges, nodes, roots = _graph(spark, folder)
    return discovered(edges, crawl(edges, nodes, roots, depth=2), roots)


_HREFS = """
targets AS (
  SELECT DISTINCT site, CASE WHEN path = '' THEN 'home' ELSE path END AS src,
    trim(split_part(unnest(regexp_extract_all(html, '(?is)<a[^>]*?href="([^"]*)"', 1)), '#', 1), '/') AS dst
  FROM page_rows),
edges AS (SELECT DISTINCT site, src, CASE WHEN dst = '' THEN 'home' ELSE dst END AS dst FROM targets)"""


@query("link_edges", f"WITH {PAGE_ROWS_SQL}, {_HREFS} SELECT site, src, dst FROM edges")
def link_edges_(spark: SparkSession, folder: str) -> DataFrame:
    return link_edges(evaluate_pages(pages(spark, folder), PAGE_CONFIG), PAGE_CONFIG)


@query(
    "discovered_urls",
    f"""WITH {PAGE_ROWS_SQL}, {_HREFS} SELECT site, dst AS location FROM edges
    UNION SELECT site, CASE WHEN path = '' THEN 'home' ELSE path END FROM page_rows""",
)
def discovered_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Everything the pages link to, when each page is a starting point."""
    rows = pages(spark, folder)
    edges = link_edges(evaluate_pages(rows, PAGE_CONFIG), PAGE_CONFIG)
    starts = rows.select("site", stored_location(F.col("path")).alias("location")).distinct()
    return discovered(edges, starts, starts)


@query(
    "broken_links",
    f"""WITH {PAGE_ROWS_SQL}, {_HREFS},
    answers AS (SELECT site, CASE WHEN path = '' THEN 'home' ELSE path END AS location,
      min(CASE WHEN page_id % 2 = 0 THEN 410 ELSE 200 END) AS status FROM page_rows GROUP BY ALL),
    -- a link back to the page itself, so that some targets exist and some of those fail
    more AS (SELECT site, src, dst FROM edges UNION ALL SELECT site, location, location FROM answers)
    SELECT m.site, m.dst AS location, m.src AS found_on, CAST(a.status AS INT) AS status
    FROM more m LEFT JOIN answers a ON a.site = m.site AND a.location = m.dst
    WHERE (a.status IS NULL OR a.status >= 400) AND m.dst NOT IN ('sitemap.xml', 'robots.txt', 'search')
      AND NOT regexp_matches(m.dst, '(?i)^(mailto:|tel:|javascript:|#|https?://)')""",
)
def broken_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages(spark, folder)
    fetched = rows.select(
        "site",
        stored_location(F.col("path")).alias("location"),
        F.when(F.col("seq") % 2 == 0, 410).otherwise(200).alias("status"),
    )
    own = fetched.select("site", F.col("location").alias("src"), F.col("location").alias("dst")).distinct()
    edges = link_edges(evaluate_pages(rows, PAGE_CONFIG), PAGE_CONFIG).unionByName(own)
    return find_broken(edges, fetched, PAGE_CONFIG)


@query(
    "sitemap_read",
    f"""WITH {PAGE_ROWS_SQL} SELECT page_id AS seq, site, pos, CASE WHEN pos = 1 THEN site || '/' ELSE url END AS loc
    FROM page_rows, (SELECT unnest([0, 1, 2]) AS pos)""",
)
def sitemap_read(spark: SparkSession, folder: str) -> DataFrame:
    url = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("'"), F.lit("&#39;"))
    entry = F.concat(F.lit("<url><loc>"), url, F.lit("</loc><changefreq>daily</changefreq></url>\n"))
    root = F.concat(F.lit("<url>\n<loc>"), F.col("site"), F.lit("/</loc></url>"))
    body = F.concat(F.lit('<?xml version="1.0"?><urlset>'), entry, root, entry, F.lit("</urlset>"))
    # One sitemap per page; the page's number rides along as part of the key.
    files = pages(spark, folder).select(F.struct("site", "seq").alias("site"), body.alias("body"))
    return sitemap_locations(files).select("site.seq", "site.site", "pos", "loc")


_SITEMAP_SQL = f"""WITH {PAGE_ROWS_SQL}, {records_sql()},
listed AS (SELECT site, location AS page FROM records WHERE location NOT IN ('home', 'sitemap.xml', '')
  UNION SELECT site, '' FROM records)
SELECT site, page, site || '/' || trim(page, '/') AS loc, 'weekly' AS changefreq FROM listed"""


@query("sitemap_list", _SITEMAP_SQL)
def sitemap_list_(spark: SparkSession, folder: str) -> DataFrame:
    return sitemap_list(index_records(pages(spark, folder), PAGE_CONFIG))


@query("sitemap_files", _SITEMAP_SQL.replace("SELECT site, page, site ||", "SELECT site ||").replace(", 'weekly' AS changefreq", ""))
def sitemap_files(spark: SparkSession, folder: str) -> DataFrame:
    """The sitemap written as XML and read back."""
    path = scratch_path(spark, "sitemap")
    write_sitemap(sitemap_list(index_records(pages(spark, folder), PAGE_CONFIG)), path)
    return read_sitemap_files(spark, path)


# Two sites made of the pages, one to crawl and one with a sitemap. Even pages link to 2i+2 and 2i+4, some of
# these only in outdated copies; some newest copies are errors.
_FULL = f"""WITH RECURSIVE live AS (
  SELECT page_id + 1000000 AS page_id, html, CASE WHEN page_id % 2 = 0 THEN 'https://even.example' ELSE 'https://odd.example' END AS site,
    CASE WHEN page_id = 0 THEN '' ELSE 'p' || page_id END AS path, '' AS url, page_id AS id
  FROM pages WHERE page_id % 16 <> 8),
edges AS (SELECT id AS src, unnest([id * 2 + 2, id * 2 + 4]) AS dst FROM live WHERE id % 2 = 0),
reached(id) AS (
  SELECT 0 UNION SELECT e.dst FROM reached r JOIN edges e ON e.src = r.id JOIN live l ON l.id = e.dst WHERE e.dst % 12 <> 2),
{records_sql('live')}
SELECT {RECORD_COLUMNS} FROM records WHERE (site = 'https://even.example'
  AND location IN (SELECT CASE WHEN id = 0 THEN 'home' ELSE 'p' || id END FROM reached))"""


def _two_sites(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    number = F.col("page_id")
    given = table(spark, folder, "pages").select("page_id", "html")
    copies = given.withColumn("newest", F.explode(F.array(F.lit(0), F.lit(1))))
    link = lambda to: F.concat(F.lit('<a href="/p'), to.cast("string"), F.lit('"></a>'))
    shown = lambda to: F.when((to % 12 == 2) & (F.col("newest") == 1), "").otherwise(link(to))
    links = F.when(number % 2 == 0, F.concat(shown(number * 2 + 2), shown(number * 2 + 4))).otherwise("")
    site = F.when(number % 2 == 0, "https://even.example").otherwise("https://odd.example")
    path = F.when(number == 0, "").otherwise(F.concat(F.lit("p"), number.cast("string")))
    rows = copies.select(
        site.alias("site"),
        path.alias("path"),
        F.concat_ws("/", site, path).alias("url"),
        F.concat("html", links).alias("html"),
        F.when((number % 16 == 8) & (F.col("newest") == 1), 404).otherwise(200).alias("status"),
        (number + F.col("newest") * 1000000).alias("seq"),
        F.timestamp_seconds(1_700_000_000 + (number + F.col("newest") * 1000000) * 60).cast("timestamp_ntz").alias("date_added"),
    )
    listed = rows.filter((F.col("site") == "https://odd.example") & (F.length("path") % 2 == 0)).select("site", "path").distinct()
    return rows, listed


@query("full_index_crawl", _FULL)
def full_index_crawl(spark: SparkSession, folder: str) -> DataFrame:
    """A complete rebuild by following links: the site without a home page has nothing to start from."""
    rows, listed = _two_sites(spark, folder)
    return full_index(rows, PAGE_CONFIG, None, listed)


@query("full_index_auto", f"{_FULL} OR (site = 'https://odd.example' AND length(location) % 2 = 0)")
def full_index_auto(spark: SparkSession, folder: str) -> DataFrame:
    """A complete rebuild in which one site is crawled and the other read from its sitemap."""
    rows, listed = _two_sites(spark, folder)
    return full_index(rows, replace(PAGE_CONFIG, index_method="auto"), None, listed)
