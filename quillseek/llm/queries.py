"""The registered corpus queries, each applying one operator to its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.llm import ann, collocations, conversations, decontaminate, line_dedup, mixing, pii, pitman_yor, pivots, sharding, simhash, toxicity, url_filter
from quillseek.llm.common import table

# The rules that the URL query judges by.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def line_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dropped_lines(table(spark, sf_dir, "documents"))


def histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    kept = docs.select("doc_id", "text", F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard(kept, sharding.ShardConfig(shards=16)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def one_bit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(table(spark, sf_dir, "documents"), pitman_yor.LanguageConfig(context_bytes=None))


def temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).drop("text")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "action string, rule string")
    return url_filter.judged_pages(table(spark, sf_dir, "pages"), rules)


def simhash_popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "redacted")


def crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.scored_documents(docs, table(spark, sf_dir, "labels")).drop("text")


def persistent_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversations.audit_report(conversations.repair(conversations.damaged(rows), rows))


def quotient_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pivot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.highest_products(table(spark, sf_dir, "embeddings"))[0]


QUERIES = {
    "op1_line_edits": line_edits,
    "op2_histogram_shards": histogram_shards,
    "op3_one_bit_neighbours": one_bit_neighbours,
    "op4_pitman_yor_scores": pitman_yor_scores,
    "op5_temperature_mix": temperature_mix,
    "op6_url_aliases": url_aliases,
    "op7_simhash_popcounts": simhash_popcounts,
    "op8_template_leaks": template_leaks,
    "op9_boosted_pii": boosted_pii,
    "op10_crf_toxicity": crf_toxicity,
    "op11_persistent_audits": persistent_audits,
    "op12_quotient_collocations": quotient_collocations,
    "op13_pivot_products": pivot_products,
}

ORACLE: dict[str, str] = {}

_PARTS = "'(?s)^(.*?)://([^/?#]*)([^?#]*)'"


def _host(url: str) -> str:
    """A-Z alone in lower case."""
    return f"translate(coalesce(regexp_extract({url}, {_PARTS}, 2), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, {_PARTS}, 3), '')"


def _normal(url: str) -> str:
    query = f"regexp_extract({url}, '(?s)^.*?://[^?#]*\\?([^#]*)', 1)"
    query = f"regexp_replace(regexp_replace({query}, '(^|&)(utm_[a-z]+|ref|gclid|fbclid)=[^&]*', '', 'g'), '^&', '')"
    host = f"regexp_replace({_host(url)}, '^(www|m)\\.', '')"
    path = f"regexp_replace({_path(url)}, '(/|\\.html?|/index\\.html?)$', '')"
    return f"'https://' || {host} || {path} || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END"


def _dotless(path: str) -> str:
    """Parts are added one by one; a part ``..`` takes the last one away, but not the root."""
    parts = f"string_split({path}, '/')"
    kept = f"""list_reduce(list_concat([CAST([] AS VARCHAR[])], list_transform({parts}, lambda p: [p])),
      lambda done, p: CASE p[1] WHEN '.' THEN done WHEN '..' THEN done[1:greatest(len(done) - 1, 1)] ELSE list_concat(done, p) END)"""
    return f"array_to_string({kept}, '/') || CASE WHEN {parts}[-1] IN ('.', '..') THEN '/' ELSE '' END"


def _absolute(target: str, url: str) -> str:
    start = f"regexp_extract({url}, {_PARTS}, 1) || '://' || {_host(url)}"
    path = f"CASE WHEN {_path(url)} = '' THEN '/' ELSE {_path(url)} END"
    own, rest = (f"regexp_extract({target}, '(?s)^([^?#]*)(.*)$', {n})" for n in (1, 2))
    folder = f"regexp_extract({path}, '(?s)^(.*/)', 1)"
    return f"""CASE WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {target}
    WHEN starts_with({target}, '//') THEN regexp_extract({url}, {_PARTS}, 1) || ':' || {target}
    WHEN regexp_matches({target}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with({target}, '#') THEN {start} || {path} || regexp_extract({url}, '(?s)^[^#?]*(\\?[^#]*)', 1) || {target}
    WHEN starts_with({target}, '?') THEN {start} || {path} || {target}
    WHEN starts_with({target}, '/') THEN {start} || {_dotless(own)} || {rest}
    ELSE {start} || {_dotless(folder + ' || ' + own)} || {rest} END"""


_TARGETS = """
SELECT url, t.target FROM pages, (SELECT unnest(list_concat(
  list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<link\\b[^>]*>'),
    lambda x: regexp_matches(x, '(?is)\\srel\\s*=\\s*["'']?canonical\\b'))[1:1],
    lambda x: regexp_extract(x, '(?is)\\shref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
  list_transform(list_filter(regexp_extract_all(coalesce(html, ''), '(?is)<meta\\b[^>]*>'),
    lambda x: regexp_matches(x, '(?is)\\shttp-equiv\\s*=\\s*["'']?refresh\\b'))[1:1],
    lambda x: regexp_extract(x, '(?is)\\burl\\s*=\\s*([^"''\\s>]+)', 1)))) AS target) t
WHERE contains(url, '://') AND t.target <> ''"""

_RULE_ROWS = ", ".join(f"('{action}', '{rule}')" for action, rule in RULES)

# Components by recursion.
ORACLE["op6_url_aliases"] = f"""
WITH RECURSIVE rules AS (
  SELECT action, rule, split_part(rule, '/', 1) AS host, substr(rule, length(split_part(rule, '/', 1)) + 1) AS start
  FROM (VALUES {_RULE_ROWS}) v(action, rule)),
found AS ({_TARGETS}),
links AS (
  SELECT DISTINCT url AS src, {_absolute('target', 'url')} AS dst FROM found),
named AS (SELECT url FROM pages WHERE contains(url, '://') UNION SELECT dst FROM links WHERE dst IS NOT NULL),
edges AS (
  SELECT src, dst FROM links WHERE dst IS NOT NULL AND src <> dst
  UNION SELECT url, {_normal('url')} FROM named WHERE contains(url, '://') AND url <> {_normal('url')}),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
reach(node, other) AS (
  SELECT src, src FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON b.src = r.other),
nodes AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT dst FROM edges),
own AS (
  SELECT url, arg_max(rule, {{'n': length(rule), 'a': action = 'allow'}}) AS rule, arg_max(action, {{'n': length(rule), 'a': action = 'allow'}}) AS action FROM (
    SELECT n.url, r.rule, r.action FROM nodes n JOIN rules r
      ON ({_host('n.url')} = r.host OR ends_with({_host('n.url')}, '.' || r.host)) AND starts_with({_path('n.url')}, r.start))
  GROUP BY url),
carried AS (SELECT DISTINCT node AS url, 'block' AS carried FROM reach JOIN own ON own.url = reach.other WHERE action = 'block')
SELECT page_id, {_host('p.url')} AS host, {_path('p.url')} AS path, own.rule, coalesce(own.action, c.carried, 'allow') AS verdict,
  CASE WHEN own.rule IS NOT NULL THEN 'rule' WHEN c.carried IS NOT NULL THEN 'alias' ELSE 'default' END AS reason
FROM pages p LEFT JOIN own ON own.url = p.url LEFT JOIN carried c ON c.url = p.url"""

_LINES = """
lines AS (
  SELECT doc_id, CAST(n - 1 AS INT) AS line_no, line FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
  WHERE trim(line, ' ') <> ''),
firsts AS (
  SELECT line, min({'d': doc_id, 'n': line_no}) AS place, length(line) AS size FROM lines GROUP BY line)"""

# One edit leaves the first half or the second as it is, read one character later in a longer line.
ORACLE["op1_line_edits"] = f"""
WITH {_LINES},
halves AS (SELECT *, size // 2 AS h, (size - 1) // 2 AS g FROM firsts),
pairs AS (
  SELECT a.line, b.line AS other FROM halves a JOIN halves b ON a.size = b.size AND substr(a.line, 1, a.h) = substr(b.line, 1, b.h) AND a.line <> b.line
  UNION SELECT a.line, b.line FROM halves a JOIN halves b ON a.size = b.size AND substr(a.line, a.h + 1) = substr(b.line, b.h + 1) AND a.line <> b.line
  UNION SELECT a.line, b.line FROM halves a JOIN halves b ON a.size - 1 = b.size AND substr(a.line, 1, a.g) = substr(b.line, 1, b.h)
  UNION SELECT a.line, b.line FROM halves a JOIN halves b ON a.size - 1 = b.size AND substr(a.line, a.g + 2) = substr(b.line, b.h + 1)),
apart AS (
  SELECT line, other, coalesce(list_position(list_transform(range(1, length(other) + 1),
    lambda i: substr(line, i, 1) <> substr(other, i, 1)), true), length(other) + 1) AS p FROM pairs),
edits AS (
  SELECT line, other FROM apart
  WHERE substr(line, p + 1) = CASE WHEN length(line) = length(other) THEN substr(other, p + 1) ELSE substr(other, p) END),
links AS (SELECT line, other FROM edits UNION SELECT other, line FROM edits),
near AS (
  SELECT a.line, a.place, min(b.place) AS kept FROM links l JOIN firsts a ON a.line = l.line JOIN firsts b ON b.line = l.other
  WHERE b.place < a.place GROUP BY ALL)
SELECT DISTINCT l.doc_id, l.line_no, f.place.d AS kept_doc_id, f.place.n AS kept_line_no, 0 AS distance
FROM lines l JOIN firsts f ON f.line = l.line WHERE l.doc_id <> f.place.d OR l.line_no <> f.place.n
UNION ALL SELECT place.d, place.n, kept.d, kept.n, 1 FROM near"""

# All pairs of queries and rows, in the same whole numbers.
ORACLE["op13_pivot_products"] = """
WITH kept AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM kept q JOIN kept x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""

ORACLE["op12_quotient_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lines AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS size, unnest(w) AS phrase FROM lines
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM lines
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM lines),
f AS (SELECT lang, size, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
cuts AS (
  SELECT lang, size, phrase, a, w, k, array_to_string(w[:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
  FROM f, (VALUES (1), (2)) cut(k) WHERE size > k AND a >= 10),
valued AS (
  SELECT c.*, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
lowest AS (SELECT * FROM valued QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, array_to_string(w[:2], ' ') AS phrase, a FROM f WHERE size = 3 AND a >= 10
  UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM f WHERE size = 3 AND a >= 10),
held AS (SELECT lang, phrase, max(a) AS longest FROM longer GROUP BY ALL)
SELECT v.lang, row_number() OVER (PARTITION BY v.lang ORDER BY score DESC, a DESC, encode(v.phrase)) AS rank, v.phrase, a, l, r, n, score
FROM lowest v JOIN totals USING (lang) LEFT JOIN held h ON v.size = 2 AND h.lang = v.lang AND h.phrase = v.phrase
WHERE h.longest IS NULL OR 100 * h.longest < 50 * a QUALIFY rank <= 2000"""

# crc32 bit by bit; the program row by row, with whole edit sequences and repaired texts.
ORACLE["op11_persistent_audits"] = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
fated AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT))),
    lambda crc, c: list_reduce(list_concat([xor(crc, c)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS fate FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy FROM fated WHERE fate <> 0),
placed AS (
  SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    lag(substr(role, 1, 1)) OVER w AS previous, regexp_replace(text, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, substr(text, 1, 64), sha256(text), copy)),
faulty AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    substr(role, 1, 1) AS initial, max(i) OVER (PARTITION BY conv_id) AS many FROM placed),
inserts(state, middle, added, lines) AS (VALUES
  (0, 0, 0, CAST([] AS VARCHAR[])), (0, 2, 1, ['user:']), (0, 3, 2, ['user:', 'assistant:']), (1, 1, 0, CAST([] AS VARCHAR[])), (1, 2, 1, ['user:']), (1, 3, 2, ['user:', 'assistant:']),
  (2, 2, 0, CAST([] AS VARCHAR[])), (2, 3, 1, ['assistant:']), (3, 3, 0, CAST([] AS VARCHAR[])), (3, 2, 1, ['user:'])),
edits(middle, after, letter, cost, wanted) AS (
  SELECT s, s, 'D', 2, CAST(NULL AS VARCHAR) FROM range(4) r(s)
  UNION ALL VALUES (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'),
    (0, 2, 'R', 1, NULL), (1, 2, 'R', 1, NULL), (3, 2, 'R', 1, NULL), (2, 3, 'R', 1, NULL)),
moves AS (SELECT state, after, letter, added * 5 + cost AS cost, repeat('I', added) || letter AS letters, wanted, lines FROM inserts JOIN edits USING (middle)),
program(conv_id, i, state, cost, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, 0, {'audit': '', 'lines': CAST([] AS VARCHAR[])} FROM conversations
  UNION ALL
  SELECT p.conv_id, f.i, m.after, min(p.cost + m.cost + CASE WHEN m.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END),
    arg_min({'audit': p.best.audit || m.letters, 'lines': list_concat(p.best.lines, m.lines, CASE m.letter WHEN 'K' THEN [f.role || ':' || f.text]
      WHEN 'R' THEN [CASE m.after WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text] ELSE CAST([] AS VARCHAR[]) END)},
      {'cost': p.cost + m.cost + CASE WHEN m.letter <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END, 'audit': p.best.audit || m.letters})
  FROM program p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1 JOIN moves m ON m.state = p.state
  WHERE (m.letter = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (m.wanted IS NULL OR m.wanted = f.initial)
  GROUP BY p.conv_id, f.i, m.after),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(many) AS many FROM faulty GROUP BY conv_id),
ended AS (
  SELECT p.conv_id, p.cost + last.more AS cost, p.best.audit || last.letters AS audit, list_concat(p.best.lines, last.lines) AS lines
  FROM program p LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM p.conv_id
  JOIN (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 10, 'II', ['user:', 'assistant:']), (2, 5, 'I', ['assistant:']), (3, 0, '', CAST([] AS VARCHAR[]))) last(state, more, letters, lines) ON last.state = p.state
  WHERE p.i = coalesce(f.many, 0)
  QUALIFY row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + last.more, p.best.audit || last.letters) = 1)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(e.cost AS BIGINT) AS cost, e.audit, sha256(array_to_string(e.lines, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id"""
