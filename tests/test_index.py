"""Index building, maintenance, change feeds and the link graph."""

import hashlib
import random
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.operators.crawl import crawl
from quillseek.operators.eligibility import gated
from quillseek.operators.extraction import evaluate_pages, index_records
from quillseek.operators.links import broken_links, link_edges
from quillseek.operators.maintenance import (
    as_state,
    choose_source,
    feed_changes,
    index_listing,
    index_log,
    log_report,
    reindex,
    upsert,
    visible,
)
from quillseek.plans.indexing import full_index, rebuild_index
from quillseek.sources.index_store import (
    append_changes,
    clear_index,
    compact,
    read_index,
    read_state,
    rebuild,
    swap_tables,
    versions,
)
from quillseek.sources.pages import listed_pages, page_rows
from quillseek.sources.robots import robots_by_site
from quillseek.sources.sitemaps import sitemap_list, sitemap_locations, sitemap_paths
from quillseek.streaming.changes import index_stream

S = "http://s"
CONFIG = SearchConfig(delimiters=("<article>",))
RAW = "url string, html string, status int, n long"
STATE = "site string, location string, scope string, title string, content string, excerpt string, language string, seq long"


def page(title="T", body="text", head="", links=()):
    anchors = "".join(f'<a href="{x}">x</a>' for x in links)
    return f"<html lang=en><head><title>{title}</title>{head}</head><body>{anchors}<article>{body}</article></body></html>"


def pages_of(spark, rows, config=CONFIG):
    """Rows (path, html) or (path, html, status)."""
    full = [(f"{S}/{r[0]}", r[1], r[2] if len(r) > 2 else 200, i) for i, r in enumerate(rows)]
    return page_rows(spark.createDataFrame(full, RAW), config, seq="n")


def locations(frame):
    return sorted(r.location for r in frame.collect())


def index_rows(spark, names, seq=-1):
    return spark.createDataFrame([(S, n, "pages", "old", "old", "", "en", seq) for n in names], STATE)


def contents(frame):
    return {r.location: r.content for r in frame.collect()}


NOINDEX = '<meta name="robots" content="noindex">'


def test_outcomes(spark):
    rows = [
        ("", page("Home")),
        ("bad", page(head=NOINDEX)),
        ("gone", page(), 404),
        ("empty", page(body="")),
        ("zero", page(body="0")),
        ("blank", page(body="  &nbsp; ".replace("&nbsp;", ""))),
        ("search", page()),
        ("x/1", page()),
        ("private/a", page()),
    ]
    robots = robots_by_site(spark.createDataFrame([(S, "User-agent: *\nDisallow: /private")], "site string, body string"), CONFIG)
    config = replace(CONFIG, exclude=("x/:num",))
    got = {r.location: (r.outcome, r.reason) for r in evaluate_pages(pages_of(spark, rows), config, robots).collect()}
    assert got == {
        "home": ("indexed", None),
        "bad": ("rejected", "noindex"),
        "gone": ("rejected", "http error"),
        "empty": ("skipped", "no title or content"),
        "zero": ("skipped", "no title or content"),
        "blank": ("rejected", "content required"),
        "search": ("rejected", "ignored"),
        "x/1": ("rejected", "excluded"),
        "private/a": ("rejected", "robots"),
    }
    open_config = replace(config, ignore_robots=True)
    assert "private/a" in locations(index_records(pages_of(spark, rows), open_config, robots))


def test_default_fields(spark):
    html = '<html lang="fr"><head><title>T</title><meta name="keywords" content="k"><meta name="description" content="d"></head><div id="main">m<div>n</div></div></html>'
    row = index_records(pages_of(spark, [("a", html)]), SearchConfig()).first()
    assert (row.title, row.content, row.excerpt, row.language, row.scope) == ("T", "mnk", "d", "fr", "pages")


def test_title_html_kept(spark):
    config = replace(CONFIG, title_tags=("h1",), preserve_title_html=True)
    html = "<h1>Species = <i>Abra</i></h1><article>x</article>"
    assert index_records(pages_of(spark, [("a", html)]), config).first().title == "Species = <i>Abra</i>"


def test_last_copy_decides(spark):
    rows = [("a", page(body="one")), ("a/", page(body="two")), ("a#x", page(body="")), ("b", page()), ("b", page(head=NOINDEX))]
    assert contents(index_records(pages_of(spark, rows), CONFIG)) == {"a": "two"}


def test_upsert(spark):
    index = index_rows(spark, ["a", "b", "c"], seq=5)
    new = index_rows(spark, ["b", "d", "c"], seq=6).withColumn("content", F.lit("new"))
    new = new.unionByName(new.withColumn("seq", F.lit(4).cast("long")).withColumn("content", F.lit("late")))
    late = index_rows(spark, ["a"], seq=1).withColumn("content", F.lit("late"))
    for config in (CONFIG, replace(CONFIG, max_broadcast_rows=0)):
        once = upsert(index, new.unionByName(late), config)
        assert contents(once) == {"a": "old", "b": "new", "c": "new", "d": "new"}
        assert once.count() == 4
        assert contents(upsert(once, new.unionByName(late), config)) == contents(once)


def test_reindex(spark):
    rows = pages_of(spark, [("a", page(body="new")), ("b", page(head=NOINDEX)), ("c", page(body="")), ("d", page())])
    listing = spark.createDataFrame([(S, f"a,/b/,{S}/c,missing")], "site string, pages string")
    wanted = listed_pages(listing, CONFIG)
    index = index_rows(spark, ["a", "b", "c", "missing", "other"], seq=99)
    assert contents(reindex(index, wanted, rows, CONFIG)) == {"a": "new", "c": "old", "other": "old"}
    off = replace(CONFIG, indexing_enabled=False)
    assert locations(reindex(index, wanted, rows, off)) == ["a", "b", "c", "missing", "other"]


def test_reindex_everything_equals_full(spark):
    rows = pages_of(spark, [("a", page()), ("b", page(head=NOINDEX)), ("c", page(body="z"))])
    everything = reindex(index_rows(spark, []), rows.select("site", "path"), rows, CONFIG)
    assert contents(everything) == contents(index_records(rows, CONFIG))


FEED = "seq long, module string, site string, path string, op string"


def test_feed(spark):
    rows = pages_of(spark, [("a", page(body="new")), ("b", page(body="new")), ("c", page(head=NOINDEX)), ("d", page(body=""))])
    feed = spark.createDataFrame(
        [
            (1, "blog", S, "a", "delete"), (2, "blog", S, "a", "save"), (3, "blog", S, "b", "save"), (4, "blog", S, "b", "delete"),
            (5, "blog", S, "c", "save"), (6, "blog", S, "d", "save"), (7, "search", S, "e", "delete"), (8, "news", S, "f", "delete"),
        ],
        FEED,
    )
    index = as_state(index_rows(spark, ["b", "c", "d", "e", "f"]))
    apply = lambda c: contents(visible(upsert(index, feed_changes(gated(feed, c), rows, c), c)))
    assert apply(CONFIG) == {"a": "new", "d": "old", "e": "old"}
    assert set(apply(replace(CONFIG, index_modules=("blog",)))) == {"a", "d", "e", "f"}
    # Disabled indexing ignores saves, while deletes still remove.
    assert set(apply(replace(CONFIG, indexing_enabled=False))) == {"c", "d", "e"}


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 5], [2, 4, 6, 8]])
def test_stream_equals_batch(spark, tmp_path, cuts):
    rows = pages_of(spark, [(n, page(body=f"new {n}")) for n in "abcd"])
    rng = random.Random(5)
    changes = [(i, "blog", S, rng.choice("abcde"), rng.choice(["save", "delete"])) for i in range(10)]
    rng.shuffle(changes)  # late changes
    root, source = str(tmp_path / "index"), str(tmp_path / "feed")
    base = index_rows(spark, ["a", "b", "e", "z"])
    rebuild(base, root)
    for start, stop in zip([0, *cuts], [*cuts, 10]):
        spark.createDataFrame(changes[start:stop], FEED).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(source)
        index_stream(feed, rows, root, CONFIG, once=True).awaitTermination()
    whole = feed_changes(spark.createDataFrame(changes, FEED), rows, CONFIG)
    expected = contents(visible(upsert(as_state(base), whole, CONFIG)))
    assert contents(read_index(spark, root, CONFIG)) == expected
    assert compact(spark, root, CONFIG) == 2
    assert contents(read_index(spark, root, CONFIG)) == expected
    # A change older than what the index has seen stays without effect after compaction.
    old = feed_changes(spark.createDataFrame([(-5, "blog", S, n, "save") for n in "abcd"], FEED), rows, CONFIG)
    append_changes(old, root, 50)
    assert contents(read_index(spark, root, CONFIG)) == expected


def test_rebuild(spark, tmp_path):
    root = str(tmp_path / "index")
    assert rebuild(index_rows(spark, ["a"]), root) == 1
    append_changes(as_state(index_rows(spark, ["b"], seq=3)), root, 0)
    assert locations(read_index(spark, root, CONFIG)) == ["a", "b"]
    assert rebuild(index_rows(spark, []), root) is None
    assert locations(read_index(spark, root, CONFIG)) == ["a", "b"]
    assert rebuild(index_rows(spark, ["c"]), root) is not None
    assert locations(read_index(spark, root, CONFIG)) == ["c"]
    append_changes(as_state(index_rows(spark, ["d"], seq=3)), root, 1)
    assert locations(read_state(spark, root, CONFIG)) == ["c", "d"]
    assert len(versions(spark, root)) == 2


def test_swap_tables(spark):
    index_rows(spark, ["a"]).write.saveAsTable("live")
    index_rows(spark, ["b"]).write.saveAsTable("staged")
    index_rows(spark, []).write.saveAsTable("nothing")
    assert not swap_tables(spark, "live", "nothing")
    assert swap_tables(spark, "live", "staged")
    assert locations(spark.table("live")) == ["b"]
    assert not spark.catalog.tableExists("staged") and not spark.catalog.tableExists("live_old")
    spark.sql("DROP TABLE live")
    spark.sql("DROP TABLE nothing")


SITE_PAGES = [
    ("", page("Home", links=["/a", "b#x", "http://other/x", "mailto:m@x", "/bad", "/gone", "/missing"])),
    ("a", page("A", links=["/c", "/"])),
    ("b", page("B", head='<meta name="robots" content="nofollow">', links=["/hidden"])),
    ("c", page("C", body="", links=["d"])),
    ("d", page("D")),
    ("bad", page(head=NOINDEX, links=["/hidden"])),
    ("hidden", page("H")),
    ("gone", page(), 404),
]


def test_full_index_by_source(spark, tmp_path):
    rows = pages_of(spark, SITE_PAGES)
    assert locations(full_index(rows, CONFIG)) == ["a", "b", "d", "home"]
    assert locations(full_index(rows, replace(CONFIG, depth=2))) == ["a", "b", "home"]
    assert locations(full_index(rows, replace(CONFIG, depth=1))) == ["home"]
    files = spark.createDataFrame([(S, f"<urlset><url><loc>{S}/hidden</loc></url><url><loc>{S}/</loc></url><url><loc>{S}/bad</loc></url></urlset>")], "site string, body string")
    listed = sitemap_paths(sitemap_locations(files), CONFIG)
    for method in ("sitemap", "auto"):
        assert locations(full_index(rows, replace(CONFIG, index_method=method), listed=listed)) == ["hidden", "home"]
    assert locations(full_index(rows, replace(CONFIG, index_method="auto"))) == ["a", "b", "d", "home"]
    root = str(tmp_path / "i")
    assert rebuild_index(rows, root, replace(CONFIG, index_method="sitemap")) is None
    assert rebuild_index(rows, root, replace(CONFIG, indexing_enabled=False)) is None
    assert rebuild_index(rows, root, CONFIG) is not None


def test_broken_links(spark):
    rows = pages_of(spark, SITE_PAGES)
    edges = link_edges(evaluate_pages(rows, CONFIG), CONFIG)
    fetched = rows.select("site", F.when(F.col("path") == "", "home").otherwise(F.col("path")).alias("location"), "status")
    got = {(r.location, r.found_on, r.status) for r in broken_links(edges, fetched, CONFIG).collect()}
    assert got == {("gone", "home", 404), ("missing", "home", None)}
    assert ("home", "http://other/x") in {(r.src, r.dst) for r in edges.collect()}


def test_crawl_chain_depths(spark):
    names = list("0123")
    nodes = spark.createDataFrame([(S, n) for n in names], "site string, location string")
    edges = spark.createDataFrame([(S, a, b) for a, b in zip(names, names[1:])] + [(S, "3", "0"), (S, "0", "3")][:1], "site string, src string, dst string")
    roots = nodes.filter("location = '0'")
    walk = lambda d: {r.location: r.depth for r in crawl(edges, nodes, roots, d).collect()}
    assert walk(0) == {"0": 0, "1": 1, "2": 2, "3": 3}
    assert [set(walk(d)) for d in (1, 2, 3)] == [{"0"}, {"0", "1"}, {"0", "1", "2"}]


def test_crawl_random_graph(spark):
    rng = random.Random(2)
    links = [("a" if rng.random() < 0.5 else "b", rng.randrange(60), rng.randrange(60)) for _ in range(140)]
    nodes = spark.createDataFrame([(s, str(n)) for s in "ab" for n in range(60) if n % 9], "site string, location string")
    known = {(r.site, r.location) for r in nodes.collect()}
    edges = spark.createDataFrame([(s, str(x), str(y)) for s, x, y in links], "site string, src string, dst string")
    roots = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "9")], "site string, location string")
    depth = {k: 0 for k in [("a", "1"), ("b", "2")]}
    queue = list(depth)
    while queue:
        site, src = queue.pop(0)
        for s, x, y in links:
            if s == site and str(x) == src and (s, str(y)) in known and (s, str(y)) not in depth:
                depth[(s, str(y))] = depth[(site, src)] + 1
                queue.append((s, str(y)))
    assert {(r.site, r.location): r.depth for r in crawl(edges, nodes, roots).collect()} == depth


def test_sitemap_list(spark):
    got = [(r.page, r.loc, r.changefreq) for r in sitemap_list(index_rows(spark, ["home", "b", "a", "sitemap.xml"])).collect()]
    assert got == [("", f"{S}/", "weekly"), ("a", f"{S}/a", "weekly"), ("b", f"{S}/b", "weekly")]


def test_source_choice(spark):
    pair = "site string, path string"
    listed = spark.createDataFrame([("x", "l1"), ("x", "l1")], pair)
    crawled = spark.createDataFrame([("x", "c1"), ("y", "c2")], pair)
    pick = lambda m: {tuple(r) for r in choose_source(listed, crawled, replace(CONFIG, index_method=m)).collect()}
    assert pick("auto") == {("x", "l1"), ("y", "c2")}
    assert pick("crawl") == {("x", "c1"), ("y", "c2")}
    assert pick("sitemap") == {("x", "l1")}


def test_log(spark):
    rows = pages_of(spark, [("a", page()), ("b", page(head=NOINDEX)), ("c", page(), 500), ("d", page(body="  "))])
    log = index_log(evaluate_pages(rows, CONFIG), index_rows(spark, ["b", "x"]))
    got = {(r.location, r.status, r.message) for r in log.collect()}
    assert got == {("a", "indexed", ""), ("b", "removed", ""), ("c", "error", "HTTP Code 500"), ("d", "error", "content required")}
    assert [(r.status, r.entries) for r in log_report(log).collect()] == [("error", 2), ("removed", 1), ("indexed", 1)]
    assert [r.status for r in log_report(log, ("removed",)).collect()] == ["removed"]


def test_clear_a_stored_index(spark, tmp_path):
    root = str(tmp_path / "cleared")
    rebuild(index_rows(spark, ["a", "b"]), root)
    assert read_index(spark, root, CONFIG).count() == 2
    clear_index(spark, root)
    assert read_index(spark, root, CONFIG).isEmpty()


def test_upsert_of_rows_without_order(spark):
    old = index_rows(spark, ["a"]).withColumn("seq", F.lit(None).cast("long"))
    new = index_rows(spark, ["a", "b"], 5)
    assert locations(upsert(old, new, CONFIG)) == ["a", "b"]
    assert upsert(new, old, CONFIG).filter("seq = 5").count() == 2


DATED = STATE + ", date_added timestamp_ntz"


def dated_rows(spark, rows):
    """Rows (location, seq, day)."""
    return spark.createDataFrame([(S, n, "pages", "t", f"{n} {seq}", "", "en", seq, day) for n, seq, day in rows], DATED)


def days(frame):
    return {r.location: r.date_added and r.date_added.day for r in frame.collect()}


def day(n):
    return datetime(2024, 1, n)


def test_date_added_stays_through_upserts(spark):
    index = dated_rows(spark, [("a", 1, day(1)), ("b", 9, day(2)), ("c", 1, None)])
    new = dated_rows(spark, [("a", 5, day(5)), ("a", 4, day(4)), ("b", 5, day(5)), ("c", 5, day(5)), ("d", 6, day(6)), ("d", 5, day(5))])
    for config in (CONFIG, replace(CONFIG, max_broadcast_rows=0)):
        got = upsert(index, new, config)
        assert days(got) == {"a": 1, "b": 2, "c": 5, "d": 5}
        assert contents(got) == {"a": "a 5", "b": "b 9", "c": "c 5", "d": "d 6"}
    undated = index_rows(spark, ["a"], seq=1)
    assert days(upsert(undated, new, CONFIG)) == {"a": 4, "b": 5, "c": 5, "d": 5}
    assert days(upsert(index, index_rows(spark, ["a", "z"], seq=7), CONFIG)) == {"a": 1, "b": 2, "c": None, "z": None}


@pytest.mark.parametrize("cuts", [[], [1], [2], [3], [1, 2, 3, 4, 5, 6]])
def test_date_added_of_stored_indexes(spark, tmp_path, cuts):
    """Changes in order, cut into batches in any way: a location that was removed and came back has its new date."""
    rows = pages_of(spark, [(n, page(body=f"new {n}")) for n in "abcd"])
    root = str(tmp_path / "index")
    rebuild(dated_rows(spark, [("a", 0, day(1)), ("b", 0, day(1)), ("d", 0, None)]), root)
    feed = [(1, "save", "a", 2), (2, "delete", "b", 3), (3, "save", "c", 4), (4, "save", "b", 5), (5, "save", "c", 6), (6, "save", "b", 7), (7, "save", "d", 8)]
    for n, (start, stop) in enumerate(zip([0, *cuts], [*cuts, 7])):
        part = spark.createDataFrame([(seq, "blog", S, path, op, day(d)) for seq, op, path, d in feed[start:stop]], FEED + ", date_added timestamp_ntz")
        append_changes(feed_changes(part, rows, CONFIG), root, n)
    expected = {"a": 1, "b": 5, "c": 4, "d": 8}
    assert days(read_index(spark, root, CONFIG)) == expected
    compact(spark, root, CONFIG)
    assert days(read_index(spark, root, CONFIG)) == expected
    rebuild(dated_rows(spark, [(n, 50, day(20)) for n in "abcde"]), root)
    assert days(read_index(spark, root, CONFIG)) == {**expected, "e": 20}


def test_versions_of_before_dates(spark, tmp_path):
    """A version written without the column is read with nulls, and has it after its compaction."""
    root = str(tmp_path / "old")
    old = index_rows(spark, ["a", "b"], seq=1).withColumn("deleted", F.lit(False))
    old.write.parquet(f"{root}/version=1")
    open(f"{root}/version=1/_PUBLISHED--1", "w").close()
    assert days(read_index(spark, root, CONFIG)) == {"a": None, "b": None}
    append_changes(as_state(dated_rows(spark, [("b", 3, day(3)), ("c", 3, day(3))])), root, 0)
    compact(spark, root, CONFIG)
    assert days(read_index(spark, root, CONFIG)) == {"a": None, "b": 3, "c": 3}
    assert "date_added" in spark.read.parquet(f"{root}/version=2").columns


def test_listing_and_reindex_show_dates(spark):
    rows = pages_of(spark, [("a", page(body="new")), ("b", page())]).withColumn("date_added", F.lit("2024-01-09").cast("timestamp_ntz"))
    index = dated_rows(spark, [("a", 1, day(1)), ("c", 1, day(2))])
    got = reindex(index, rows.select("site", "path"), rows, CONFIG)
    assert days(got) == {"a": 1, "b": 9, "c": 2}
    listed = index_listing(got).collect()
    assert [(r.location, r.date_added.day) for r in listed] == [("a", 1), ("b", 9), ("c", 2)]
    assert len({r.id for r in listed}) == 3 and listed[0].id == int(hashlib.md5(f"{S} a".encode()).hexdigest()[:15], 16)
    assert "id" in index_listing(index_rows(spark, ["a"])).columns
