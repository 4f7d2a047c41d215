"""The plans large inputs rely on: pruned scans, early ranking cuts, split hot keys, checked broadcasts."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.operators import fulltext, like_search
from quillseek.operators.joins import broadcast_if_small, is_small, latest, split_join
from quillseek.operators.links import broken_links
from quillseek.operators.maintenance import index_listing, upsert
from quillseek.operators.postings import postings, write_postings
from quillseek.operators.fulltext import natural_scores
from quillseek.operators.queries import prepare, searches
from quillseek.operators.postings import site_sizes
from quillseek.plans.searching import SearchIndex, search

CONFIG = SearchConfig()
S = "http://s"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def records(spark, n):
    return spark.range(n).select(
        F.lit(S).alias("site"),
        F.concat(F.lit("p/"), F.col("id")).alias("location"),
        F.lit("pages").alias("scope"),
        F.concat(F.lit("Title "), F.col("id") % 7).alias("title"),
        F.concat(F.lit("common words number"), F.col("id"), F.lit(" group"), F.col("id") % 50).alias("content"),
        F.lit("").alias("excerpt"),
        F.lit("en").alias("language"),
        F.col("id").alias("seq"),
    )


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "index")
    records(spark, 4000).write.parquet(path)
    return spark.read.parquet(path)


def test_scan_reads_needed_columns(stored):
    plan = plan_of(index_listing(stored))
    schema = plan.split("ReadSchema: ")[1].split(">")[0]
    assert "title" in schema and "content" not in schema


def test_ranking_cuts_before_the_shuffle(spark, stored):
    queries = spark.createDataFrame([(1, S, "common words", "like")], "query_id int, site string, q string, mode string")
    found = search(SearchIndex(stored), queries, replace(CONFIG, limit=5))
    plan = plan_of(found)
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert [r.rank for r in found.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    hot = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
        F.col("id").alias("seq"),
        F.repeat(F.lit("x"), 50).alias("text"),
    )
    best = latest(hot, ["key"], ["seq"])
    rows = {r.key: r.seq for r in best.collect()}
    assert rows["hot"] == 29997 and len(rows) == 20001
    plan = plan_of(best)
    assert plan.index("partial_max_by") > plan.index("Exchange")


HOT = replace(CONFIG, max_broadcast_rows=100, hot_rows=500, salts=4)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_copies", [1, 300])
def test_split_join_equals_join(spark, how, hot_copies):
    """Keys of a third of all rows, with few or with too many rows on the other side to broadcast."""
    left = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "gone").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("key"),
        F.col("id").alias("n"),
    )
    right = spark.range(3000).filter("id % 2 = 0").select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("m"))
    right = right.unionByName(spark.range(hot_copies).select(F.lit("hot").alias("key"), F.col("id").alias("m")))
    joined = split_join(left, right, ["key"], how, HOT)
    assert "Union" in plan_of(joined)
    plain = left.join(right, ["key"], how)
    assert joined.exceptAll(plain).isEmpty() and plain.exceptAll(joined).isEmpty()


def test_hot_rows_do_not_meet(spark):
    """A third of all links go to one missing page: no shuffle partition of the result is large."""
    edges = spark.range(9000).select(
        F.lit(S).alias("site"),
        F.concat(F.lit("src/"), F.col("id")).alias("src"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p/"), F.col("id"))).alias("dst"),
    )
    fetched = spark.range(9000).select(
        F.lit(S).alias("site"), F.concat(F.lit("p/"), F.col("id")).alias("location"), F.lit(200).alias("status")
    )
    broken = broken_links(edges, fetched, HOT)
    sizes = [r.rows for r in broken.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("rows")).collect()]
    assert sum(sizes) == 3000 and max(sizes) < 600


def test_jobs_agree_on_either_side_of_the_limits(spark, stored):
    queries = spark.range(40).select(
        F.col("id").cast("int").alias("query_id"),
        F.lit(S).alias("site"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("common number"), F.col("id"))).otherwise(F.concat(F.lit("r"), F.col("id"))).alias("q"),
        F.when(F.col("id") % 4 == 0, "match").when(F.col("id") % 4 == 2, "match boolean").otherwise("like").alias("mode"),
    )
    index = SearchIndex(stored.filter("seq < 900"))
    tight = replace(HOT, max_inline_searches=0, max_broadcast_rows=20)
    mine, theirs = (search(index, queries, c) for c in (replace(CONFIG, limit=30), replace(tight, limit=30)))
    assert mine.count() > 300
    assert mine.exceptAll(theirs).isEmpty() and theirs.exceptAll(mine).isEmpty()


def test_broadcast_is_checked(spark):
    frame = spark.range(100).select(F.repeat(F.lit("x"), 100).alias("text"))
    assert is_small(frame, CONFIG)
    assert not is_small(frame, replace(CONFIG, max_broadcast_rows=99))
    assert not is_small(frame, replace(CONFIG, max_broadcast_bytes=5000))
    assert "ResolvedHint" not in broadcast_if_small(frame, replace(CONFIG, max_broadcast_rows=9))._jdf.queryExecution().analyzed().toString()


def test_upsert_leaves_the_index_in_place(spark, stored):
    """A small change set is broadcast: the stored rows are filtered where they are."""
    changes = stored.filter(F.col("seq") < 5).withColumn("seq", F.col("seq") + 100000)
    kept = plan_of(upsert(stored, changes, CONFIG).filter(F.col("seq") < 100000))
    assert "BroadcastHashJoin" in kept


def test_search_reads_only_the_buckets_of_its_words(spark, stored, tmp_path):
    config = replace(CONFIG, postings_buckets=16)
    write_postings(postings(stored, config), str(tmp_path / "p"), config)
    rows = spark.read.parquet(str(tmp_path / "p"))
    queries = spark.createDataFrame([(1, S, "number17", "match")], "query_id int, site string, q string, mode string")
    scores = natural_scores(searches(prepare(queries, config)), rows, site_sizes(stored), True, config)
    assert [r.location for r in scores.collect()] == ["p/17"]
    assert "dynamicpruning" in plan_of(scores)


def test_index_without_words(spark):
    empty = records(spark, 3).withColumns({"title": F.lit("x"), "content": F.lit("..."), "location": F.concat(F.lit("p"), F.col("seq"))})
    assert postings(empty, CONFIG).count() == 0


def test_tiny_scores_are_matches(spark):
    rows = spark.createDataFrame([(S, "word", "p", "en", 1, 0.04)], "site string, term string, location string, language string, tf int, weight double")
    counts = spark.createDataFrame([(S, "word", 4_999_999)], "site string, term string, records long")
    sizes = spark.createDataFrame([(S, 10_000_000)], "site string, total long")
    queries = spark.createDataFrame([(1, S, "word", "match")], "query_id int, site string, q string, mode string")
    found = natural_scores(searches(prepare(queries, CONFIG)), rows, sizes, True, CONFIG, counts).collect()
    assert [(r.location, r.relevance) for r in found] == [("p", 0.0)]


@pytest.mark.parametrize("limit", [1000, 1001, 100_000, 2147483647])
def test_pages_of_any_depth(spark, stored, limit):
    queries = spark.createDataFrame([(1, S, "common words", "like", limit, 3), (2, S, "common", "like", 2, 0)], "query_id int, site string, q string, mode string, limit int, offset int")
    found = search(SearchIndex(stored), queries, CONFIG)
    counts = {r.query_id: (r["count"], r.low, r.high) for r in found.groupBy("query_id").agg(F.count(F.lit(1)).alias("count"), F.min("rank").alias("low"), F.max("rank").alias("high")).collect()}
    shown = min(limit, 3997)
    assert counts == {1: (shown, 4, shown + 3), 2: (2, 1, 2)}


@pytest.mark.parametrize("kind", ["decimal(12,2)", "date", "timestamp", "binary", "string"])
@pytest.mark.parametrize("inline", [0, 256])
def test_query_ids_of_any_type(spark, stored, kind, inline):
    day = F.concat(F.lit("2024-01-"), F.lpad(F.col("id") + 1, 2, "0"))
    number = day.cast(kind) if kind in ("date", "timestamp") else F.col("id").cast("string").cast(kind)
    queries = spark.range(3).select(number.alias("query_id"), F.lit(S).alias("site"), F.concat(F.lit("group"), F.col("id")).alias("q"), F.lit("like").alias("mode"))
    found = search(SearchIndex(stored), queries, replace(CONFIG, max_inline_searches=inline, limit=5))
    assert found.groupBy("query_id").count().count() == 3 and found.schema["query_id"].dataType.simpleString() == kind


def test_searches_read_only_their_sites(spark, stored):
    other = stored.withColumn("site", F.lit("http://other"))
    queries = spark.createDataFrame([(1, S, "common words", "like")], "query_id int, site string, q string, mode string")
    found = search(SearchIndex(stored), queries, CONFIG)
    assert "EqualTo(site,http://s)" in plan_of(found)
    both = search(SearchIndex(stored.union(other)), queries, CONFIG)
    assert {r.site for r in both.collect()} == {S}


def asked_of(spark, rows):
    queries = spark.createDataFrame(rows, "query_id int, site string, q string, mode string")
    return searches(prepare(queries, CONFIG))


def test_large_slices_of_a_bucket_are_parted(spark, stored, tmp_path):
    """A common word fills more files than slices where these are large, and no posting is lost."""
    rows = postings(stored, replace(CONFIG, postings_buckets=2))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    try:
        write_postings(rows.repartition(8), str(tmp_path / "p"), replace(CONFIG, postings_buckets=2), slices=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    kept = spark.read.parquet(str(tmp_path / "p"))
    files = kept.select("term_bucket", F.input_file_name().alias("file")).distinct().groupBy("term_bucket").agg(F.count("file").alias("files")).collect()
    assert max(r["files"] for r in files) > 1
    same = ["site", "term", "location", "language", "tf", "weight"]
    assert kept.select(same).exceptAll(rows.select(same)).isEmpty() and kept.count() == rows.count()


@pytest.mark.parametrize("q", ["common words", "no%r 1%"])
def test_derived_grams_are_a_row_for_each_record(spark, stored, q):
    """Only grams that are asked for, those of a record together; short ones only if asked for."""
    work = like_search._work(asked_of(spark, [(1, S, q, "like"), (2, S, "group7", "like")]), CONFIG)
    asked = {r["gram"] for r in like_search.search_grams(work).collect()}
    found = like_search._asked_grams(stored, work).collect()
    assert len(found) == stored.count()
    text = {r["location"]: "\n".join([r["location"], r["title"], r["content"]]).lower() for r in stored.collect()}
    for row in found:
        assert sorted(row["grams"]) == sorted(g for g in asked if g in text[row["location"]])


def test_derived_postings_are_read_by_column(stored):
    index = SearchIndex(stored).completed(CONFIG)
    assert "Scan parquet" in plan_of(index.postings.select("term")) and "Scan parquet" in plan_of(index.counts)


@pytest.mark.parametrize("q, rows", [("+group1 number1", 2), ("+(group1 number1)", 4)])
def test_a_top_level_word_is_one_row_with_its_score(spark, stored, q, rows):
    """A word's clause carries its score unless it is in a group: one row for each posting met instead of two."""
    work = asked_of(spark, [(1, S, q, "match boolean")])
    posting_rows, sizes = postings(stored, CONFIG), site_sizes(stored)
    clauses = fulltext.usable_clauses(fulltext.clauses(work), CONFIG).withColumn("required", F.lit(0).cast("long"))
    boosts = fulltext.weighted_terms(fulltext.search_terms(work, CONFIG), fulltext.term_counts(posting_rows), sizes, True)
    found = fulltext._word_rows(clauses.filter("form = 'word'"), boosts, posting_rows, True, CONFIG).filter("location = 'p/1'").collect()
    wanted = natural_scores(work, posting_rows, sizes, True, CONFIG).filter("location = 'p/1'").first()["relevance"]
    assert len(found) == rows and sum(r["score"] for r in found) == pytest.approx(wanted, abs=1e-6)
