"""Ranked search over the documents table, with queries taken from the benchmark passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import DOC_CONFIG, DOC_SITE, DOCS_SQL, documents, sql_limit, table
from quillseek.functions.text import excerpt_source, highlight, snippet
from quillseek.functions.tokens import index_tokens
from quillseek.operators.fulltext import clauses
from quillseek.operators.like_search import gram_counts, write_grams
from quillseek.operators.postings import postings, site_sizes, term_counts, word_positions, write_postings
from quillseek.operators.queries import normalise
from quillseek.operators.topk import band_counts
from quillseek.operators.ranking import result_excerpt
from quillseek.plans.searching import SearchIndex, count, page_meta, search
from quillseek.session import scratch_path

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str):
    def register(build):
        QUERIES[name] = build
        ORACLE[name] = sql
        return build

    return register


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Whole benchmark passages as ``(query_id, site, text, words, t)``: words by blanks, tokens searchable."""
    text = F.col("text")
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"),
        F.lit(DOC_SITE).alias("site"),
        "text",
        F.split(F.btrim(text), r"\s+").alias("words"),
        index_tokens(text, 4, 84).alias("t"),
    )


def _token(n: int):
    return F.coalesce(F.get("t", F.lit(n)), F.lit("zzzz"))


def _like_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).select(
        "query_id",
        "site",
        F.concat(F.lit("  "), F.translate("text", "aeinst", "AEINST"), F.lit(" ")).alias("q"),
        F.lit("like").alias("mode"),
        (F.col("query_id") % 3).cast("int").alias("offset"),
    )


def _wildcard_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).select(
        "query_id",
        "site",
        F.when(F.col("query_id") % 2 == 0, F.regexp_replace("text", r"^(\S+)\s", "$1%"))
        .otherwise(F.regexp_replace("text", r"^(.).", "$1_"))
        .alias("q"),
        F.lit("like").alias("mode"),
    )


def _natural_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).select(
        "query_id",
        "site",
        F.array_join("words", "  ").alias("q"),
        F.lit("match").alias("mode"),
        F.element_at(F.array(F.lit("en"), F.lit("fr"), F.lit("de"), F.lit("")), (F.col("query_id") % 4 + 1).cast("int")).alias("wanted"),
    )


def _boolean_queries(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("query_id") % 4
    prefix = F.substring(_token(0), 1, 3)
    text = (
        F.when(kind == 0, F.concat(F.array_join(F.transform("t", lambda t: F.concat(F.lit("+"), t)), " "), F.lit(" -zzzz")))
        .when(kind == 1, F.concat(prefix, F.lit("* -"), _token(1)))
        .when(kind == 2, F.concat(F.lit('"'), F.array_join("words", " "), F.lit('" of')))
        .otherwise(F.concat(F.lit("+("), F.array_join("t", " "), F.lit(") +("), _token(0), F.lit(" "), _token(1), F.lit(")")))
    )
    return _asked(spark, folder).select("query_id", "site", text.alias("q"), F.lit("match boolean").alias("mode"))


_ASKED = """
asked AS (
  SELECT item_id AS query_id, text, regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS words,
    list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_'']+'), lambda t: length(t) BETWEEN 4 AND 84) AS t
  FROM benchmark)"""


def _t(n: int) -> str:
    return f"coalesce(t[{n + 1}], 'zzzz')"


_LIKE_Q = """lq AS (SELECT query_id, '  ' || translate(text, 'aeinst', 'AEINST') || ' ' AS raw, query_id % 3 AS off FROM asked),
q AS (SELECT query_id, off, regexp_replace(regexp_replace(lower(raw), '^\\s+|\\s+$', '', 'g'), '\\s{2,}', ' ', 'g') AS q
  FROM lq WHERE strlen(raw) >= 3)"""

_WILD_Q = """lq AS (SELECT query_id, CASE WHEN query_id % 2 = 0 THEN regexp_replace(text, '^(\\S+)\\s', '\\1%')
    ELSE regexp_replace(text, '^(.).', '\\1_') END AS raw FROM asked),
q AS (SELECT query_id, 0 AS off, regexp_replace(regexp_replace(lower(raw), '^\\s+|\\s+$', '', 'g'), '\\s{2,}', ' ', 'g') AS q
  FROM lq WHERE strlen(raw) >= 3)"""

_LIKE_MATCHES = """
low AS (SELECT *, lower(location) AS ll, lower(title) AS lt, lower(content) AS lc FROM docs),
matches AS (
  SELECT query_id, off, site, location, title, content, language, excerpt, date_added, rel AS relevance FROM (
    SELECT q.query_id, q.off, d.*, (ll LIKE '%' || q.q || '%' ESCAPE '\\')::INT
      + (lt LIKE '%' || q.q || '%' ESCAPE '\\')::INT + (lc LIKE '%' || q.q || '%' ESCAPE '\\')::INT AS rel
    FROM low d, q)
  WHERE rel > 0)"""

_TOP = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, location) AS rank FROM matches)
SELECT query_id, CAST(rank AS INT) AS rank, site, location, site || '/' || location AS url, title, language,
  CASE WHEN excerpt = '' THEN substr(content, 1, 200) ELSE excerpt END AS excerpt, date_added, CAST(relevance AS DOUBLE) AS relevance
FROM ranked WHERE rank > off AND rank <= off + 10"""


@query("search_like", f"WITH {DOCS_SQL}, {_ASKED}, {_LIKE_Q}, {_LIKE_MATCHES}, {_TOP}")
def search_like(spark: SparkSession, folder: str) -> DataFrame:
    return search(SearchIndex(documents(spark, folder)), _like_queries(spark, folder), DOC_CONFIG)


@query("search_like_wildcard", f"WITH {DOCS_SQL}, {_ASKED}, {_WILD_Q}, {_LIKE_MATCHES}, {_TOP}")
def search_like_wildcard(spark: SparkSession, folder: str) -> DataFrame:
    return search(SearchIndex(documents(spark, folder)), _wildcard_queries(spark, folder), DOC_CONFIG)


@query("search_like_grams", f"WITH {DOCS_SQL}, {_ASKED}, {_LIKE_Q}, {_LIKE_MATCHES}, {_TOP}")
def search_like_grams(spark: SparkSession, folder: str) -> DataFrame:
    """The same searches by way of the gram join that large batches take."""
    from dataclasses import replace

    config = replace(DOC_CONFIG, max_inline_searches=0)
    return search(SearchIndex(documents(spark, folder)), _like_queries(spark, folder), config)


@query("search_like_stored_grams", f"WITH {DOCS_SQL}, {_ASKED}, {_WILD_Q}, {_LIKE_MATCHES}, {_TOP}")
def search_like_stored_grams(spark: SparkSession, folder: str) -> DataFrame:
    """Wildcard searches over grams stored beforehand: the text of a record is read only if it holds a search's grams."""
    records = documents(spark, folder)
    path = scratch_path(spark, "grams")
    write_grams(records, f"{path}/rows", DOC_CONFIG, slices=1)
    grams = spark.read.parquet(f"{path}/rows")
    gram_counts(grams).write.parquet(f"{path}/counts")
    index = SearchIndex(records, grams=grams, gram_counts=spark.read.parquet(f"{path}/counts"))
    return search(index, _wildcard_queries(spark, folder), DOC_CONFIG)


_FULLTEXT = """
words AS (
  SELECT site, location, language, unnest(list_filter(regexp_extract_all(
    lower(location || chr(10) || title || chr(10) || content), '[\\p{L}\\p{N}_'']+'),
    lambda t: length(t) BETWEEN 4 AND 84)) AS term FROM docs),
tf AS (SELECT site, location, language, term, count(*) AS tf FROM words GROUP BY ALL),
norm AS (SELECT location, sum(ln(tf) + 1) AS total, count(*) AS u FROM tf GROUP BY location),
post AS (SELECT site, tf.location, language, term, tf, (ln(tf) + 1) / total * u / (1 + 0.0115 * u) AS weight
  FROM tf JOIN norm ON norm.location = tf.location),
counts AS (SELECT term, count(*) AS records FROM tf GROUP BY term),
size AS (SELECT count(*) AS total FROM docs)"""


def _scores(q: str = "q") -> str:
    return f"""
terms AS (SELECT query_id, term, count(*) AS qf FROM (
  SELECT query_id, unnest(list_filter(regexp_extract_all(q, '[\\p{{L}}\\p{{N}}_'']+'), lambda t: length(t) BETWEEN 4 AND 84)) AS term
  FROM {q}) GROUP BY ALL),
boosts AS (SELECT query_id, terms.term, qf * ln((total - records) / records) AS boost
  FROM terms JOIN counts ON counts.term = terms.term, size WHERE records * 2 < total),
scored AS (SELECT query_id, location, language, round(sum(weight * boost), 6) AS relevance
  FROM post JOIN boosts ON boosts.term = post.term GROUP BY query_id, location, language HAVING sum(weight * boost) > 0)"""


_NATURAL_Q = f"""q AS (SELECT query_id, 0 AS off, ['en', 'fr', 'de', ''][query_id % 4 + 1] AS wanted,
  lower(array_to_string(words, ' ')) AS q FROM asked)"""

_NATURAL = f"WITH {DOCS_SQL}, {_ASKED}, {_NATURAL_Q}, {_FULLTEXT}, {_scores()}"


@query(
    "search_natural",
    f"""{_NATURAL},
    matches AS (SELECT s.query_id, 0 AS off, d.*, s.relevance FROM scored s JOIN docs d ON d.location = s.location), {_TOP}""",
)
def search_natural(spark: SparkSession, folder: str) -> DataFrame:
    queries = _natural_queries(spark, folder).drop("wanted")
    return search(SearchIndex(documents(spark, folder)), queries, DOC_CONFIG)


@query(
    "search_natural_best",
    f"""{_NATURAL},
    matches AS (SELECT s.query_id, 0 AS off, d.*, s.relevance FROM scored s JOIN docs d ON d.location = s.location
      JOIN q ON q.query_id = s.query_id WHERE (wanted = '' OR d.language IN (wanted, ''))), {_TOP}""",
)
def search_natural_best(spark: SparkSession, folder: str) -> DataFrame:
    """The same searches over stored bands of postings, of which only those are read that a shown match can be in."""
    records = documents(spark, folder)
    path = scratch_path(spark, "bands")
    write_postings(postings(records, DOC_CONFIG), f"{path}/rows", DOC_CONFIG, slices=1, bands=True)
    stored = spark.read.parquet(f"{path}/rows")
    band_counts(stored).write.parquet(f"{path}/bands")
    site_sizes(records).write.parquet(f"{path}/sizes")
    bands, sizes = (spark.read.parquet(f"{path}/{name}") for name in ("bands", "sizes"))
    counts = bands.groupBy("site", "term").agg(F.sum("records").alias("records"))
    queries = _natural_queries(spark, folder).withColumnRenamed("wanted", "language")
    return search(SearchIndex(records, stored, counts, sizes, bands=bands), queries, DOC_CONFIG)


@query(
    "search_language",
    f"""{_NATURAL},
    matches AS (SELECT s.query_id, 0 AS off, d.*, s.relevance FROM scored s JOIN docs d ON d.location = s.location
      JOIN q ON q.query_id = s.query_id
      WHERE (wanted = '' OR d.language IN (wanted, ''))), {_TOP}""",
)
def search_language(spark: SparkSession, folder: str) -> DataFrame:
    queries = _natural_queries(spark, folder).withColumnRenamed("wanted", "language")
    return search(SearchIndex(documents(spark, folder)), queries, DOC_CONFIG)


_BOOLEAN_Q = f"""bq AS (SELECT query_id, words, t, CASE query_id % 4
    WHEN 0 THEN array_to_string(list_transform(t, lambda x: '+' || x), ' ') || ' -zzzz'
    WHEN 1 THEN substr({_t(0)}, 1, 3) || '* -' || {_t(1)}
    WHEN 2 THEN '"' || array_to_string(words, ' ') || '" of'
    ELSE '+(' || array_to_string(t, ' ') || ') +(' || {_t(0)} || ' ' || {_t(1)} || ')' END AS raw FROM asked),
q AS (SELECT query_id, 0 AS off, words, t, lower(raw) AS q FROM bq)"""

_BOOLEAN = f"""WITH {DOCS_SQL}, {_ASKED}, {_BOOLEAN_Q}, {_FULLTEXT}, {_scores()},
sets AS (SELECT d.location, coalesce(list(DISTINCT tf.term), []) AS terms FROM docs d LEFT JOIN tf ON tf.location = d.location GROUP BY d.location),
line AS (SELECT location, ' ' || array_to_string(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}_'']+'), ' ') || ' ' || chr(10) ||
  ' ' || array_to_string(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_'']+'), ' ') || ' ' AS line FROM docs),
held AS (
  SELECT q.query_id, s.location FROM q, sets s JOIN line l ON l.location = s.location
  WHERE CASE query_id % 4
    WHEN 0 THEN len(t) > 0 AND list_has_all(terms, t) AND NOT list_contains(terms, 'zzzz')
    WHEN 1 THEN len(list_filter(terms, lambda x: starts_with(x, substr({_t(0)}, 1, 3)))) > 0 AND NOT list_contains(terms, {_t(1)})
    WHEN 2 THEN len(list_filter(regexp_extract_all(q.q, '[\\p{{L}}\\p{{N}}_'']+'), lambda x: length(x) BETWEEN 4 AND 84)) > 0
      AND contains(l.line, ' ' || array_to_string(regexp_extract_all(regexp_extract(q.q, '"([^"]*)"', 1), '[\\p{{L}}\\p{{N}}_'']+'), ' ') || ' ')
    ELSE list_has_any(terms, t) AND (list_contains(terms, {_t(0)}) OR list_contains(terms, {_t(1)})) END)"""


@query(
    "search_boolean",
    f"""{_BOOLEAN},
    matches AS (SELECT h.query_id, 0 AS off, d.*, coalesce(s.relevance, 0) AS relevance FROM held h
      JOIN docs d ON d.location = h.location
      LEFT JOIN scored s ON s.query_id = h.query_id AND s.location = h.location), {_TOP}""",
)
def search_boolean(spark: SparkSession, folder: str) -> DataFrame:
    return search(SearchIndex(documents(spark, folder)), _boolean_queries(spark, folder), DOC_CONFIG)


@query(
    "search_stored_postings",
    f"""{_BOOLEAN},
    matches AS (SELECT h.query_id, 0 AS off, d.*, coalesce(s.relevance, 0) AS relevance FROM held h
      JOIN docs d ON d.location = h.location
      LEFT JOIN scored s ON s.query_id = h.query_id AND s.location = h.location), {_TOP}""",
)
def search_stored_postings(spark: SparkSession, folder: str) -> DataFrame:
    """Boolean searches over postings, positions and counts stored beforehand, as a search service keeps them."""
    records = documents(spark, folder)
    path = scratch_path(spark, "postings")
    write_postings(postings(records, DOC_CONFIG), f"{path}/rows", DOC_CONFIG)
    write_postings(word_positions(records), f"{path}/positions", DOC_CONFIG)
    stored = spark.read.parquet(f"{path}/rows")
    term_counts(stored).write.parquet(f"{path}/counts")
    site_sizes(records).write.parquet(f"{path}/sizes")
    counts, sizes = (spark.read.parquet(f"{path}/{name}") for name in ("counts", "sizes"))
    index = SearchIndex(records, stored, counts, sizes, spark.read.parquet(f"{path}/positions"))
    return search(index, _boolean_queries(spark, folder), DOC_CONFIG)


@query(
    "boolean_clauses",
    f"""WITH {_ASKED}, {_BOOLEAN_Q} SELECT query_id, CAST(len(regexp_extract_all(q, '[+(]|"[^"]*"|[\\p{{L}}\\p{{N}}_'']+'))
      - len(regexp_extract_all(q, '[+]')) AS BIGINT) AS clauses, CAST(len(regexp_extract_all(q, '\\+')) AS BIGINT) AS required,
      CAST(len(regexp_extract_all(q, ' -')) AS BIGINT) AS excluded FROM q""",
)
def boolean_clauses(spark: SparkSession, folder: str) -> DataFrame:
    asked = _boolean_queries(spark, folder).select(
        F.col("query_id").alias("search_id"), "site", normalise(F.col("q")).alias("q"), F.lit(None).cast("string").alias("language")
    )
    return clauses(asked).groupBy(F.col("search_id").alias("query_id")).agg(
        F.count(F.lit(1)).alias("clauses"),
        F.count_if(F.col("kind") == "require").alias("required"),
        F.count_if(F.col("kind") == "exclude").alias("excluded"),
    )


_MIXED_Q = f"""mq AS (SELECT query_id, t, {_t(0)} AS word, CASE query_id % 3 WHEN 0 THEN substr({_t(0)}, 1, 3) ELSE {_t(0)} END AS q FROM asked),
q AS (SELECT query_id, 0 AS off, q, strlen(q) < 4 AS plain FROM mq)"""


@query(
    "search_mixed_modes",
    f"""WITH {DOCS_SQL}, {_ASKED}, {_MIXED_Q}, {_FULLTEXT}, {_scores("(SELECT * FROM q WHERE NOT plain)")},
    low AS (SELECT *, lower(location) AS ll, lower(title) AS lt, lower(content) AS lc FROM docs),
    matches AS (
      SELECT query_id, off, site, location, title, content, language, excerpt, date_added, CAST(rel AS DOUBLE) AS relevance FROM (
        SELECT q.query_id, q.off, d.*, contains(ll, q.q)::INT + contains(lt, q.q)::INT + contains(lc, q.q)::INT AS rel
        FROM low d, q WHERE plain) WHERE rel > 0
      UNION ALL
      SELECT s.query_id, 0, d.site, d.location, d.title, d.content, d.language, d.excerpt, d.date_added, s.relevance
      FROM scored s JOIN docs d ON d.location = s.location), {_TOP}""",
)
def search_mixed_modes(spark: SparkSession, folder: str) -> DataFrame:
    """One batch of full-text searches and of ones too short for full text, which become substring searches."""
    short = F.col("query_id") % 3 == 0
    queries = _asked(spark, folder).select(
        "query_id",
        "site",
        F.when(short, F.substring(_token(0), 1, 3)).otherwise(_token(0)).alias("q"),
        F.lit("match").alias("mode"),
    )
    return search(SearchIndex(documents(spark, folder)), queries, DOC_CONFIG)


@query("index_postings", f"WITH {DOCS_SQL}, {_FULLTEXT} SELECT site, term, location, language, CAST(tf AS INT) AS tf, round(weight, 6) AS weight FROM post")
def index_postings(spark: SparkSession, folder: str) -> DataFrame:
    return postings(documents(spark, folder), DOC_CONFIG).withColumn("weight", F.round("weight", 6))


@query(
    "search_count",
    f"""WITH {DOCS_SQL}, {_ASKED}, {_LIKE_Q}, {_LIKE_MATCHES}, n AS (SELECT query_id, count(*) AS n FROM matches GROUP BY query_id)
    SELECT a.query_id, coalesce(n.n, 0) AS total FROM asked a LEFT JOIN n ON n.query_id = a.query_id""",
)
def search_count(spark: SparkSession, folder: str) -> DataFrame:
    return count(SearchIndex(documents(spark, folder)), _like_queries(spark, folder), DOC_CONFIG)


_SHORT = """sq AS (SELECT query_id, substr(words[1], 1, query_id % 5) AS raw FROM asked),
q AS (SELECT query_id, 0 AS off, lower(raw) AS q FROM sq WHERE strlen(raw) >= 3)"""


@query(
    "search_min_length",
    f"""WITH {DOCS_SQL}, {_ASKED}, {_SHORT}, {_LIKE_MATCHES}, n AS (SELECT query_id, count(*) AS n FROM matches GROUP BY query_id)
    SELECT a.query_id, coalesce(n.n, 0) AS total FROM asked a LEFT JOIN n ON n.query_id = a.query_id""",
)
def search_min_length(spark: SparkSession, folder: str) -> DataFrame:
    """Queries of zero to four characters: those under three bytes find nothing."""
    queries = _asked(spark, folder).select(
        "query_id", "site", F.expr("substring(words[0], 1, cast(query_id % 5 as int))").alias("q"), F.lit("like").alias("mode")
    )
    return count(SearchIndex(documents(spark, folder)), queries, DOC_CONFIG)


@query(
    "search_page_meta",
    f"""WITH {DOCS_SQL}, {_ASKED}, {_LIKE_Q}, {_LIKE_MATCHES}, n AS (SELECT query_id, count(*) AS n FROM matches GROUP BY query_id)
    SELECT a.query_id, coalesce(n.n, 0) AS total, 10 AS per_page, CAST(a.query_id % 3 AS INT) AS "offset",
      CAST(ceil(coalesce(n.n, 0) / 10) AS BIGINT) AS pages
    FROM asked a LEFT JOIN n ON n.query_id = a.query_id""",
)
def search_page_meta(spark: SparkSession, folder: str) -> DataFrame:
    return page_meta(SearchIndex(documents(spark, folder)), _like_queries(spark, folder), DOC_CONFIG)


# Result columns -----------------------------------------------------------------------------------

_NTH = "coalesce(list_filter(regexp_split_to_array(content, '\\s+'), lambda w: w <> '')[{}], 'zzz')"


def _nth_word(n: int):
    words = F.filter(F.split("content", r"\s+"), lambda w: w != "")
    return F.coalesce(F.get(words, F.lit(n - 1)), F.lit("zzz"))


@query(
    "result_highlight",
    f"""WITH {DOCS_SQL}, w AS (SELECT *, {_NTH.format(3)} AS word, substr(content, 1, 200) AS shown FROM docs)
    SELECT location, regexp_replace(title, '(?i)(' || regexp_escape(word) || ')', '<b>\\1</b>', 'g') AS title,
      regexp_replace(shown, '(?i)(' || regexp_escape(word) || ')', '<b>\\1</b>', 'g') AS excerpt FROM w""",
)
def result_highlight(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).withColumn("word", _nth_word(3))
    shown = result_excerpt(F.col("excerpt"), F.col("content"), 200)
    return rows.select(
        "location",
        highlight(F.col("title"), F.col("word"), "<b>", "</b>").alias("title"),
        highlight(shown, F.col("word"), "<b>", "</b>").alias("excerpt"),
    )


def _snippet_sql(text: str, word: str, limit: int = 100) -> str:
    cut = sql_limit("win", limit)
    return f"""
    s AS (SELECT *, {text} AS txt, greatest(strpos(lower({text}), lower({word})) - 1 - 50, 0) AS start FROM w),
    win AS (SELECT *, substr(txt, start + 1) AS win FROM s),
    cut AS (SELECT *, {cut} AS cut FROM win)
    SELECT location, CASE WHEN start = 0 THEN cut ELSE '…' || substr(cut, greatest(strpos(cut, ' '), 1)) END AS snippet FROM cut"""


@query(
    "result_snippet",
    f"""WITH {DOCS_SQL}, w AS (SELECT *, {_NTH.format(60)} AS word FROM docs), {_snippet_sql('content', 'word')}""",
)
def result_snippet(spark: SparkSession, folder: str) -> DataFrame:
    rows = documents(spark, folder).withColumn("word", _nth_word(60))
    return rows.select("location", snippet(F.col("content"), 100, F.col("word")).alias("snippet"))


_EXCERPTS = "CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN substr(content, 1, 300) ELSE substr(content, 1, 60) END"


def _with_excerpts(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("seq") % 3
    own = F.when(number == 0, "").when(number == 1, F.substring("content", 1, 300)).otherwise(F.substring("content", 1, 60))
    return documents(spark, folder).withColumn("excerpt", own)


@query(
    "result_excerpt_choice",
    f"""WITH {DOCS_SQL}, e AS (SELECT * REPLACE ({_EXCERPTS} AS excerpt) FROM docs),
    w AS (SELECT *, {_NTH.format(20)} AS word,
      CASE WHEN excerpt IN ('', '0') OR strlen(excerpt) < 100 THEN content ELSE excerpt END AS chosen FROM e),
    {_snippet_sql('chosen', 'word')}""",
)
def result_excerpt_choice(spark: SparkSession, folder: str) -> DataFrame:
    rows = _with_excerpts(spark, folder).withColumn("word", _nth_word(20))
    chosen = rows.withColumn("chosen", excerpt_source(F.col("excerpt"), F.col("content"), 100))
    return chosen.select("location", snippet(F.col("chosen"), 100, F.col("word")).alias("snippet"))


@query(
    "result_content_excerpt",
    f"""WITH {DOCS_SQL}, w AS (SELECT * FROM docs), cut AS (SELECT location, content AS win FROM w)
    SELECT location, {sql_limit('win', 120)} AS snippet FROM cut""",
)
def result_content_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("location", snippet(F.col("content"), 120).alias("snippet"))


@query(
    "result_fallback_excerpt",
    f"""WITH {DOCS_SQL}, e AS (SELECT * REPLACE ({_EXCERPTS} AS excerpt) FROM docs)
    SELECT location, CASE WHEN excerpt = '' THEN substr(content, 1, 200) ELSE excerpt END AS excerpt FROM e""",
)
def result_fallback_excerpt(spark: SparkSession, folder: str) -> DataFrame:
    shown = result_excerpt(F.col("excerpt"), F.col("content"), 200)
    return _with_excerpts(spark, folder).select("location", shown.alias("excerpt"))
