"""Stored indexes by slice, pages by site, feeds with repeats, and rules as tables."""

import glob
import os
import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.operators.eligibility import exclude_regex, scope_regex
from quillseek.operators.maintenance import as_state, feed_changes, requested_changes, upsert, visible
from quillseek.operators import rules as rules_module
from quillseek.operators.rules import excluded_by, rule_matches, exclude_patterns, scoped_by
from quillseek.sources.index_store import append_changes, compact, expire, lookup, read_index, rebuild, slices_of_site, versions
from quillseek.sources.pages import page_rows, write_pages
from quillseek.streaming.changes import index_stream
from tests.test_index import FEED, S, contents, index_rows, page, pages_of
from tests.test_scale import plan_of

CONFIG = SearchConfig(delimiters=("<article>",))


def many_sites(spark, sites, each, seq=1):
    rows = spark.range(sites * each).select(
        F.concat(F.lit("http://s"), F.col("id") % sites).alias("site"), F.concat(F.lit("p/"), (F.col("id") / sites).cast("int")).alias("location"),
        F.lit("pages").alias("scope"), F.lit("t").alias("title"), F.lit("c").alias("content"), F.lit("").alias("excerpt"), F.lit("").alias("language"), F.lit(seq).cast("long").alias("seq"),
    )
    return rows


def files(root, version):
    return {os.path.relpath(p, f"{root}/version={version}") for p in glob.glob(f"{root}/version={version}/slice=*/*.parquet")}


def test_compaction_writes_what_changed(spark, tmp_path):
    """100 sites; one page of one changes: a slice is written anew, the rest is referred to."""
    root = str(tmp_path / "i")
    rebuild(many_sites(spark, 100, 8), root, CONFIG)
    assert len(files(root, 1)) > 100
    change = many_sites(spark, 100, 8, seq=5).filter("site = 'http://s7' and location = 'p/3'").withColumn("content", F.lit("new"))
    append_changes(as_state(change), root, 0)
    before = {(r.site, r.location): r.content for r in read_index(spark, root, CONFIG).collect()}
    assert compact(spark, root, CONFIG) == 2
    assert len(files(root, 2)) <= 2
    after = {(r.site, r.location): r.content for r in read_index(spark, root, CONFIG).collect()}
    assert after == before and len(after) == 800 and after["http://s7", "p/3"] == "new"
    # A deletion, and a late change that it outlives.
    append_changes(as_state(change).withColumn("deleted", F.lit(True)).withColumn("seq", F.lit(9).cast("long")), root, 1)
    compact(spark, root, CONFIG)
    append_changes(as_state(change.withColumn("seq", F.lit(7).cast("long"))), root, 2)
    assert read_index(spark, root, CONFIG).count() == 799
    assert compact(spark, root, CONFIG) == 4
    last = {(r.site, r.location) for r in read_index(spark, root, CONFIG).collect()}
    assert len(last) == 799
    gone = expire(spark, root, keep=1)
    assert any("batch=0" in g for g in gone) and len(versions(spark, root)) == 1
    assert not files(root, 3) and len(files(root, 1)) > 100
    assert {(r.site, r.location) for r in read_index(spark, root, CONFIG).collect()} == last
    assert compact(spark, root, CONFIG) == 5  # nothing to fold: still a whole version
    assert read_index(spark, root, CONFIG).count() == 799


def test_lookups_and_searches_open_their_slices(spark, tmp_path):
    root = str(tmp_path / "i")
    rebuild(many_sites(spark, 100, 40), root, CONFIG)
    every = read_index(spark, root, CONFIG)
    total = len(every.inputFiles())
    wanted = spark.createDataFrame([(f"http://s{i}", f"p/{i}") for i in range(10)] + [("http://s1", "none")], "site string, location string")
    found = lookup(spark, root, wanted, CONFIG)
    assert {(r.site, r.location) for r in found.collect()} == {(f"http://s{i}", f"p/{i}") for i in range(10)}
    assert len(found.inputFiles()) < total / 5
    some = read_index(spark, root, CONFIG, ["http://s3", "http://s4"])
    assert some.count() == 80 and len(some.inputFiles()) < total / 5
    assert len(slices_of_site("http://s3", CONFIG)) == CONFIG.slice_parts
    append_changes(as_state(index_rows(spark, ["new"], seq=3)), root, 0)
    asked = spark.createDataFrame([(S, "new"), ("http://s5", "p/5")], "site string, location string")
    assert lookup(spark, root, asked, CONFIG).count() == 2


def test_a_change_reads_the_pages_of_its_site(spark, tmp_path):
    raw = spark.range(4000).select(
        F.concat(F.lit("http://s"), F.lpad(F.col("id") % 50, 2, "0")).alias("site"), F.concat(F.lit("http://s"), F.lpad(F.col("id") % 50, 2, "0"), F.lit("/p"), F.col("id")).alias("url"),
        F.lit(page()).alias("html"), F.lit(200).alias("status"), F.col("id").alias("n"),
    )
    write_pages(page_rows(raw, CONFIG, seq="n"), str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    asked = spark.createDataFrame([("http://s07", "p7"), ("http://s07", "missing")], "site string, path string")
    got = {r.location: r.deleted for r in requested_changes(asked, stored, CONFIG).collect()}
    assert got == {"p7": False, "missing": True}
    sought = stored.filter(F.col("site").isin("http://s07"))
    assert "PushedFilters: [" in plan_of(sought) and "EqualTo(site,http://s07)" in plan_of(sought)


def test_repeats_across_batches_are_read_once(spark, tmp_path, monkeypatch):
    """A feed with repeats and late rows in five micro-batches gives what the whole feed gives, and repeats do not reach the pages."""
    import quillseek.streaming.changes as streaming

    rows = pages_of(spark, [(n, page(body=f"new {n}")) for n in "abcd"])
    rng = random.Random(8)
    changes = [(i, "blog", S, rng.choice("abcde"), rng.choice(["save", "delete"])) for i in range(12)]
    feed = changes + rng.sample(changes, 8) + changes[:4]
    rng.shuffle(feed)
    root, source = str(tmp_path / "index"), str(tmp_path / "feed")
    base = index_rows(spark, ["a", "b", "e", "z"])
    rebuild(base, root, CONFIG)
    seen = []
    monkeypatch.setattr(streaming, "feed_changes", lambda batch, *rest: seen.append(batch.count()) or feed_changes(batch, *rest))
    for start in range(0, len(feed), 5):
        spark.createDataFrame(feed[start : start + 5], FEED).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source)
        index_stream(stream, rows, root, CONFIG, once=True, repeats="2 hours").awaitTermination()
    assert sum(seen) == len(changes)
    whole = feed_changes(spark.createDataFrame(changes, FEED), rows, CONFIG)
    assert contents(read_index(spark, root, CONFIG)) == contents(visible(upsert(as_state(base), whole, CONFIG)))


def rule_cases(seed, sites, rules, places):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 5)))
    path = lambda: "/".join([rng.choice(["blog", "shop", word()]), *(word() + str(rng.randint(0, 30)) for _ in range(rng.randint(0, 2)))])
    pages = [(f"http://s{rng.randrange(sites)}", path()) for _ in range(places)] + [("http://s0", ""), ("http://s0", "ab")]
    made = []
    for n in range(rules):
        site, text = (f"http://s{rng.randrange(sites)}" if rng.random() < 0.97 else None), path() if rng.random() < 0.5 else rng.choice(pages)[1]
        made.append((site, n, re.sub("[0-9]+", ":num", text) if rng.random() < 0.5 else re.sub("[^/]*$", ":any", text)))
    return pages, made + [(None, rules, "a.c"), (None, rules + 1, "(blog|shop)"), (None, rules + 2, "")]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_exclude_rules_of_many_sites(spark, broadcast):
    pages, rules = rule_cases(1, 40, 1500, 1200)
    config = replace(CONFIG, max_broadcast_rows=broadcast)
    got = excluded_by(spark.createDataFrame(pages, "site string, path string"), spark.createDataFrame(rules, "site string, rule_no long, pattern string"), config)
    by_site = {}
    for site, _, pattern in rules:
        by_site.setdefault(site, []).append(re.compile(exclude_regex([pattern])))
    expected = sorted((site, path, any(p.search(path) for p in by_site.get(site, []) + by_site[None])) for site, path in pages)
    assert sorted(tuple(r) for r in got.select("site", "path", "excluded").collect()) == expected
    assert any(e[2] for e in expected) and not all(e[2] for e in expected)


def test_scope_rules_of_many_sites(spark):
    pages, rules = rule_cases(2, 30, 900, 900)
    rules = [(site, n, f"scope{n % 7}", p.replace(":num", "{id}").replace(":any", "{slug}")) for site, n, p in rules] + [(None, -1, "never", "{location}"), (None, -2, "never", None)]
    got = scoped_by(spark.createDataFrame(pages, "site string, path string"), spark.createDataFrame(rules, "site string, rule_no long, scope string, path string"), CONFIG)
    patterns = sorted((n, site, scope, re.compile(scope_regex(p))) for site, n, scope, p in rules if p and p != "{location}")
    first = lambda site, path: next((scope for _, s, scope, p in patterns if s in (None, site) and p.search(path)), "pages")
    assert sorted(tuple(r) for r in got.select("site", "path", "scope").collect()) == sorted((s, p, first(s, p)) for s, p in pages)


def test_a_hundred_thousand_rules(spark):
    """Every location meets the few rules that it shares a rare piece with, not the thousands of its site."""
    rules = spark.range(100_000).select(
        F.concat(F.lit("http://s"), F.col("id") % 20).alias("site"), F.col("id").alias("rule_no"), F.concat(F.lit("blog/"), F.md5(F.col("id").cast("string")), F.lit("/:any")).alias("pattern")
    )
    places = spark.range(0, 100_000, 50).select(
        F.concat(F.lit("http://s"), F.col("id") % 20).alias("site"), F.concat(F.lit("blog/"), F.md5(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-F.col("id")).cast("string")), F.lit("/x")).alias("path")
    )
    found = rule_matches(places, exclude_patterns(rules), CONFIG)
    assert found.count() == 1000


def test_rules_alike_meet_a_location_once(spark, monkeypatch):
    """Rules made of a site's pages are mostly the same pattern: matches grow with the locations, not with both."""
    met = []
    monkeypatch.setattr(rules_module, "rule_matches", lambda *args: met.append(rule_matches(*args)) or met[-1])
    pages = spark.range(300).select(F.lit("http://s").alias("site"), F.concat(F.lit("blog/"), "id").alias("path"))
    rules = spark.range(400).select(F.lit("http://s").alias("site"), (900 - F.col("id")).alias("rule_no"), F.concat(F.lit("scope"), "id").alias("scope"), F.lit("blog/{slug}").alias("path"))
    assert {r.scope for r in scoped_by(pages, rules, CONFIG).collect()} == {"scope399"}
    assert excluded_by(pages, rules.select("site", "rule_no", F.lit("blog/:num").alias("pattern")), CONFIG).filter("excluded").count() == 300
    assert [found.count() for found in met] == [300, 300]
