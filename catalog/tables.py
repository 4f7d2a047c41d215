"""Given tables as inputs of the jobs, and the SQL fragments that mirror them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.sources.pages import page_rows, spread

SCOPES = (("french", "fr/{slug}"), ("pages", "{location}"), ("english", "en/{slug}"))
PAGE_CONFIG = SearchConfig(delimiters=("<article>",), scope_rules=SCOPES)
DOC_SITE = "https://docs.example"
DOC_CONFIG = SearchConfig(limit=10, postings_buckets=8)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(frame) if name in ("pages", "documents") else frame


def _added(frame: DataFrame, number: str) -> DataFrame:
    """With a time for each row: a minute for each number."""
    return frame.withColumn("added", F.timestamp_seconds(1_700_000_000 + F.col(number) * 60).cast("timestamp_ntz"))


def pages(spark: SparkSession, folder: str, config: SearchConfig = PAGE_CONFIG) -> DataFrame:
    return page_rows(_added(table(spark, folder, "pages"), "page_id"), config, seq="page_id", added="added")


def tagged_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with a robots meta tag put into some heads, and an error status on some."""
    number = F.col("page_id") % 4
    meta = (
        F.when(number == 0, '<meta name="robots" content="noindex,nofollow">')
        .when(number == 1, "<meta content='NoFollow' name='robots'>")
        .when(number == 2, '<meta name="robots" content="all">')
        .otherwise("")
    )
    raw = (
        table(spark, folder, "pages")
        .withColumn("html", F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), meta)))
        .withColumn("status", F.when(F.col("page_id") % 9 == 0, 404).otherwise(200))
    )
    return page_rows(_added(raw, "page_id"), PAGE_CONFIG, seq="page_id", added="added")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as an index of one site."""
    return _added(table(spark, folder, "documents"), "doc_id").select(
        F.lit(DOC_SITE).alias("site"),
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("location"),
        F.col("source").alias("scope"),
        F.regexp_extract("text", r"^\s*(\S+(?: \S+){0,4})", 1).alias("title"),
        F.col("text").alias("content"),
        F.lit("").alias("excerpt"),
        F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("lang")).alias("language"),
        F.col("doc_id").alias("seq"),
        F.col("added").alias("date_added"),
    )


# SQL fragments ------------------------------------------------------------------------------------

NL = "chr(10)"


def sql_added(number: str) -> str:
    return f"(TIMESTAMP '2023-11-14 22:13:20' + to_minutes({number}))"


def sql_decode(x: str) -> str:
    for name, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def sql_encode(x: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{char}', '{name}')"
    return x


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '(?s)<!--.*?(?:-->|\\z)|<[^\\s>][^>]*(?:>|\\z)', '', 'g')"


def sql_blanks(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '(\\s)\\s+', '\\1', 'g'), '^\\s+|\\s+$', '', 'g')"


def sql_clean(x: str) -> str:
    return sql_blanks(sql_strip(sql_decode(f"coalesce({x}, '')")))


def sql_limit(x: str, limit: int) -> str:
    flat = f"regexp_replace({x}, '\\s+', ' ', 'g')"
    words = f"trim({flat})"
    head = f"trim(regexp_extract({words}, '(?s)^(.{{{limit - 1},}}?)(?: |$)', 1))"
    head = f"(CASE WHEN length({words}) < {limit - 1} THEN {words} ELSE {head} END)"
    return (
        f"(CASE WHEN length({x}) < {limit} THEN {x} WHEN length({flat}) <= {limit} THEN {flat} "
        f"WHEN length({head}) = length({flat}) THEN {head} ELSE {head} || '…' END)"
    )


def sql_inner(page: str, tag: str) -> str:
    return f"regexp_extract({page}, '(?is)<{tag}(?:\\s[^>]*)?>(.*?)(?:</{tag}\\s*>|\\z)', 1)"


def sql_has(page: str, tag: str) -> str:
    return f"regexp_matches({page}, '(?is)<{tag}(?:\\s[^>]*)?>')"


def sql_first(page: str, *tags: str) -> str:
    cases = " ".join(
        f"WHEN {sql_has(page, t)} THEN {sql_decode(sql_strip(sql_inner(page, t)))}" for t in tags
    )
    return f"(CASE {cases} END)"


def sql_paragraph(page: str) -> str:
    """The first paragraph: what follows its tag, cut where another block begins or one around it ends."""
    rest = f"regexp_extract({page}, '(?is)<p(?:\\s[^>]*)?>(.*)$', 1)"
    blocks = "p|div|ul|ol|li|dl|table|pre|form|h[1-6]|hr|article|aside|section|header|footer|nav|main|body|html"
    cut = f"regexp_replace({rest}, '(?is)</?(?:{blocks})[\\s>/].*$', '')"
    return f"(CASE WHEN {sql_has(page, 'p')} THEN {sql_decode(sql_strip(cut))} END)"


PAGE_ROWS_SQL = """
page_sites AS (
  SELECT page_id, split_part(url, '#', 1) AS url, html,
         regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site
  FROM pages),
page_rows AS (
  SELECT page_id, url, html, site,
         replace(trim(replace(url, site || '/', ''), '/'), '?lang=english', '') AS path
  FROM page_sites)"""

TAGGED_SQL = PAGE_ROWS_SQL + """,
tagged AS (
  SELECT page_id, url, site, path,
         CASE WHEN page_id % 9 = 0 THEN 404 ELSE 200 END AS status,
         replace(html, '<head>', '<head>' || CASE page_id % 4
           WHEN 0 THEN '<meta name="robots" content="noindex,nofollow">'
           WHEN 1 THEN '<meta content=''NoFollow'' name=''robots''>'
           WHEN 2 THEN '<meta name="robots" content="all">' ELSE '' END) AS html
  FROM page_rows)"""

SCOPE_SQL = (
    "CASE WHEN regexp_matches(path, 'fr/.+') THEN 'french' "
    "WHEN regexp_matches(path, 'en/.+') THEN 'english' ELSE 'pages' END"
)


def records_sql(rows: str = "page_rows", name: str = "records") -> str:
    """CTEs that turn page rows into one record per location."""
    article = (
        "array_to_string(list_filter(list_transform(regexp_extract_all(page, "
        "'(?is)<article(?:\\s[^>]*)?>(.*?)(?:</article\\s*>|\\z)', 1), "
        f"lambda x: {sql_decode(sql_strip('x'))}), lambda x: x NOT IN ('', '0')), '|')"
    )
    return f"""
{name}_body AS (
  SELECT page_id, url, site, path, CASE WHEN path = '' THEN 'home' ELSE path END AS location,
         regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'),
                        '(?s)<!--.*?-->', '', 'g') AS page
  FROM {rows}),
{name}_raw AS (
  SELECT page_id, url, site, location, {SCOPE_SQL} AS scope,
         {sql_first('page', 'title', 'h1')} AS raw_title, {article} AS raw_content,
         {sql_paragraph('page')} AS raw_excerpt,
         regexp_extract(page, '(?is)<html[^>]*?\\slang\\s*=\\s*"([^"]*)"', 1) AS raw_language
  FROM {name}_body
  WHERE path NOT IN ('sitemap.xml', 'robots.txt', 'search')),
{name}_clean AS (
  SELECT page_id, url, site, location, scope,
         {sql_blanks(sql_strip(sql_encode("coalesce(raw_title, '')")))} AS long_title,
         {sql_clean('raw_content')} AS content, {sql_clean('raw_excerpt')} AS excerpt,
         {sql_blanks('raw_language')} AS language,
         coalesce(raw_title, '') IN ('', '0') OR coalesce(raw_content, '') IN ('', '0') AS empty
  FROM {name}_raw),
{name}_all AS (
  SELECT page_id, url, site, location, scope, {sql_limit('long_title', 100)} AS title, content,
         excerpt, language, page_id AS seq, {sql_added('page_id')} AS date_added, empty,
         long_title = '' OR content = '' AS invalid
  FROM {name}_clean),
{name} AS (
  SELECT site, location, scope, title, content, excerpt, language, seq, date_added FROM (
    SELECT *, row_number() OVER (PARTITION BY site, location ORDER BY page_id DESC, url DESC) AS rn
    FROM {name}_all WHERE NOT empty)
  WHERE rn = 1 AND NOT invalid)"""


RECORD_COLUMNS = "site, location, scope, title, content, excerpt, language, seq, date_added"

DOCS_SQL = f"""
docs AS (
  SELECT '{DOC_SITE}' AS site, 'doc/' || doc_id AS location, source AS scope,
         regexp_extract(text, '^\\s*(\\S+(?: \\S+){{0,4}})', 1) AS title, text AS content, '' AS excerpt,
         CASE WHEN doc_id % 10 = 0 THEN '' ELSE lang END AS language, doc_id AS seq,
         {sql_added('doc_id')} AS date_added
  FROM documents)"""
