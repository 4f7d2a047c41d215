"""Column expressions on hand-traced cases."""

import pytest
from pyspark.sql import functions as F

from quillseek.functions import html as H
from quillseek.functions import text as T
from quillseek.functions import urls as U
from quillseek.functions.robots import disallow_regex, disallowed
from quillseek.functions.tokens import counted, index_tokens
from quillseek.operators.eligibility import excluded, scope_of
from quillseek.operators.like_search import like_pattern
from quillseek.operators.queries import normalise

SITE = "http://localhost"


def one(spark, value, build, kind="string"):
    frame = spark.createDataFrame([(value,)], f"x {kind}")
    return frame.select(build(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "url, parent, expected",
    [
        ("http://localhost/about/", "", "about"),
        ("/x/y/", "", "x/y"),
        ("team", "about/us", "about/team"),
        ("team", "about", "team"),
        ("../x", "a/b", "a/../x"),
        ("?page=2", "a/b", "a/?page=2"),
        ("mailto:a@b.c", "about", "mailto:a@b.c"),
        ("http://other.com/x", "about", "http://other.com/x"),
        ("https://localhost/x", "", "https://localhost/x"),
        ("/x?lang=english", "", "x"),
        ("", "about", ""),
    ],
)
def test_location(spark, url, parent, expected):
    assert one(spark, url, lambda c: U.location_of(c, F.lit(SITE), F.lit(parent))) == expected


def test_location_web_path(spark):
    assert one(spark, "/cms/about", lambda c: U.location_of(c, F.lit(SITE), web_path="/cms/")) == "about"
    assert one(spark, "/cmsx/about", lambda c: U.location_of(c, F.lit(SITE), web_path="cms")) == "cmsx/about"


@pytest.mark.parametrize(
    "url, normal, local",
    [
        ("MAILTO:x", False, False),
        ("tel:1", False, False),
        ("JavaScript:f()", False, False),
        ("#a", False, False),
        ("about", True, True),
        ("", True, True),
        ("http://localhost/x", True, True),
        ("https://localhost/x", True, False),
        ("http://localhost.evil/x", True, False),
    ],
)
def test_link_predicates(spark, url, normal, local):
    assert one(spark, url, U.is_normal) is normal
    assert one(spark, url, lambda c: U.is_local(c, F.lit(SITE))) is local


def test_absolute_and_stored(spark):
    assert one(spark, "/a/b/", lambda c: U.absolute_url(c, F.lit("http://h/"))) == "http://h/a/b"
    assert one(spark, "", U.stored_location) == "home"


@pytest.mark.parametrize(
    "location, out", [("blog/12", True), ("blog/12/x", False), ("blog/a", False), ("docs/a/b", True), ("docs/", False)]
)
def test_exclude(spark, location, out):
    assert one(spark, location, lambda c: excluded(c, ("blog/:num", "docs/:any"))) is out


@pytest.mark.parametrize(
    "rule, location, blocked",
    [
        ("/private", "private/x", True),
        ("/private", "my/private", True),
        ("/private", "public", False),
        ("/*.pdf", "a/b.pdf", True),
        ("/*.pdf$", "a/b.pdf", False),
        ("/a__b", "a__b", True),
        ("/a__b", "axxb", False),
        ("/", "anything", True),
        ("/q?x=(1)", "q?x=(1)", True),
        ("/a\\Eb", "a\\Eb", True),
    ],
)
def test_robots_pattern(spark, rule, location, blocked):
    assert one(spark, rule, lambda c: F.rlike(F.lit(location), disallow_regex(c))) is blocked


def test_robots_body(spark):
    body = (
        "Disallow: /before\nUser-agent: other\nDisallow: /theirs\nUSER-AGENT: *\r\nDisallow: /a # why\r\n"
        "Disallow:\nx-disallow: /b\nAllow: /c\nUser-agent: one\nUser-agent: me\nDisallow:/d disallow: /e\n"
        "User-agent: *\nUser-agent: third\nDisallow: /f"
    )
    assert one(spark, body, lambda c: disallowed(c, "me")) == ["/a", "/b", "/d disallow: /e"]
    assert one(spark, "nothing", lambda c: disallowed(c, "me")) == []


@pytest.mark.parametrize(
    "location, scope", [("blog/a", "blog"), ("my/blog/a", "blog"), ("about", "pages"), ("news/2/x", "news")]
)
def test_scope(spark, location, scope):
    rules = (("pages", "{location}"), ("blog", "blog/{slug}"), ("news", "news/{year}/{slug}"), ("late", "blog/{x}"))
    assert one(spark, location, lambda c: scope_of(c, rules)) == scope


def test_whitespace(spark):
    assert one(spark, "a \n\n b\t\tc  ", T.collapse_blanks) == "a b\tc"


@pytest.mark.parametrize(
    "text, limit, expected",
    [
        ("aaa bbb ccc ddd", 8, "aaa bbb…"),
        ("aaaa bbbb", 8, "aaaa bbbb"),
        ("short", 8, "short"),
        ("a\n\nb  c", 20, "a\n\nb  c"),
        ("aaa  bbb  ccc", 8, "aaa bbb…"),
        ("x" * 30, 8, "x" * 30),
    ],
)
def test_limit(spark, text, limit, expected):
    assert one(spark, text, lambda c: T.limit_chars(c, limit)) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a &amp; b", "a & b"),
        ("&amp;lt;", "&lt;"),
        ("&eacute;&#233;&#xE9;&#x1F600;", "ééé😀"),
        ("&unknown; &amp &;", "&unknown; &amp &;"),
        ("&amp;eacute; &eacute;", "&eacute; é"),
        ("&#38;lt; &#0; &#xD800;", "&lt; &#0; &#xD800;"),
        ("plain", "plain"),
        (None, None),
    ],
)
def test_decode(spark, text, expected):
    assert one(spark, text, T.decode_entities) == expected


def test_clean(spark):
    assert one(spark, "x &lt;b&gt;y&lt;/b&gt; \x07z", T.clean) == "x y z"
    assert one(spark, 'A & "B" &amp; <C', lambda c: T.clean(c, encode=True)) == "A &amp; &quot;B&quot; &amp; &lt;C"
    assert one(spark, None, T.clean) == ""
    assert one(spark, "ab", lambda c: T.clean(c, funcs=(F.upper, F.reverse))) == "BA"
    assert one(spark, "1 < 2 <i>x</i> <b", T.strip_markup) == "1 < 2 x "


@pytest.mark.parametrize(
    "word, variance, expected",
    [
        ("needle", 5, "… a needle inside"),
        ("NEEDLE", 5, "… a needle inside"),
        ("absent", 5, "some long text with a needle inside"),
        (None, 5, "some long text with a needle inside"),
    ],
)
def test_snippet(spark, word, variance, expected):
    text = "some long text with a needle inside"
    word = None if word is None else F.lit(word)
    assert one(spark, text, lambda c: T.snippet(c, 100, word, variance)) == expected


def test_excerpt_source(spark):
    pick = lambda text, limit: one(spark, text, lambda c: T.excerpt_source(c, F.lit("content"), limit))
    assert [pick("", 3), pick("ab", 3), pick("éa", 3), pick("abc", 3), pick(None, 3)] == [
        "content", "content", "éa", "abc", "content",
    ]


def test_highlight(spark):
    mark = lambda text, q: one(spark, text, lambda c: T.highlight(c, F.lit(q), "<", ">"))
    assert mark("Cats and cats", "cats") == "<Cats> and <cats>"
    assert mark("a+b $1", "a+b $1") == "<a+b $1>"
    assert mark("abc", "") == "abc"


PAGE = (
    '<html lang="en"><head><title>A &amp; B</title><meta content="k1, k2" name="keywords"></head>'
    '<body><!-- <h1>no</h1> --><h1>Big <i>T</i></h1><div class="x" id="main">a<div>b</div>c</div><p>one</p><p></p><p>two</p></body></html>'
)


@pytest.mark.parametrize(
    "fields, expected",
    [
        (["<p>"], "one|two"),
        (['<div id="main">'], "abc"),
        (["<div id=main>", "//p"], "abcone|two"),
        (['//meta[@name="keywords"]/@content'], "k1, k2"),
        (['<div id="other">'], ""),
        (["<div>"], "abc|b"),
    ],
)
def test_content(spark, fields, expected):
    parsed = [H.parse_field(f) for f in fields]
    def build(c):
        parts = [F.transform(H.matched(c, f), T.decode_entities) for f in parsed]
        return H.join_content(parts)
    assert one(spark, PAGE, build) == expected


def test_content_separator(spark):
    build = lambda c: H.join_content([H.matched(c, H.parse_field(f)) for f in ("h1", "h6", "p")], " / ")
    assert one(spark, PAGE.replace("<!-- <h1>no</h1> -->", ""), build) == "Big T / one|two"


def test_deep_containers(spark):
    inner = "<div>" * 40 + "x" + "</div>" * 40
    html = f'<div id="main">{inner}</div><div id="main">second</div><div id="main">open <div>'
    assert one(spark, html, lambda c: H.inner_html(c, H.parse_field('<div id="main">'))) == [
        inner, "second", "open <div>",
    ]


@pytest.mark.parametrize(
    "html, tags, expected",
    [
        ("<title></title><h1>T</h1>", ("title", "h1"), ""),
        ("<h1 class=a>T</h1>", ("title", "h1"), "T"),
        ("<p>x</p>", ("title", "h1"), None),
        ("<h1>open", ("h1",), "open"),
        ('<html class="a" lang=\'fr\'>', ("html[@lang]/@lang",), "fr"),
        ("<html>", ("html[@lang]/@lang",), None),
        ("<section>a<section>b</section>c</section>", ("section",), "abc"),
        ("<p>x</p>", ("section",), None),
    ],
)
def test_first_text(spark, html, tags, expected):
    assert one(spark, html, lambda c: H.first_text(c, [H.parse_field(t) for t in tags])) == expected


def test_inner_html(spark):
    assert one(spark, PAGE, lambda c: H.first_inner_html(H.strip_comments(c), [H.parse_field("h1")])) == "Big <i>T</i>"


@pytest.mark.parametrize(
    "head, noindex, nofollow",
    [
        ('<meta name="robots" content="noindex,nofollow">', True, True),
        ("<meta content='NOINDEX' name='robots'>", True, False),
        ('<meta name="robots" content="all">', False, False),
        ('<meta name="other" content="noindex">', False, False),
    ],
)
def test_robots_meta(spark, head, noindex, nofollow):
    html = f"<html><head lang=x>{head}</head><body><meta name='robots' content='none'></body></html>"
    assert one(spark, html, lambda c: H.robots_meta(c, "noindex")) is noindex
    assert one(spark, html, lambda c: H.robots_meta(c, "nofollow")) is nofollow


def test_links(spark):
    html = (
        '<a href="/a#x">1</a><A class=b HREF=\'b\'>2</A><a rel="nofollow" href="/c">3</a><a href=/d>4</a>'
        '<area href="/e"><a href="#top">5</a><a rel="me noopener" href="/f">6</a><a nofollow="yes" href="/g">7</a>'
    )
    assert one(spark, html, H.links) == ["/a", "b", "/e", "", "/f"]


def test_scripts(spark):
    assert one(spark, "a<SCRIPT x>if (a<b) '</p>'</script >b<script>c</script>", H.strip_scripts) == "ab"


def test_tokens(spark):
    assert one(spark, "Über-Cat's cats_1 THE the é", lambda c: index_tokens(c, 3, 84, ("the",))) == ["über", "cat's", "cats_1"]
    text = "the " * 20000 + "a_b " * 10
    rows = one(spark, text, lambda c: counted(index_tokens(c, 1, 84)))
    assert [(r.term, r.tf) for r in rows] == [("a_b", 10), ("the", 20000)]


@pytest.mark.parametrize("q, expected", [(" CATS ", "cats"), ("a \t b\n", "a b"), ("a\tb", "a\tb")])
def test_normalise(spark, q, expected):
    assert one(spark, q, normalise) == expected


@pytest.mark.parametrize(
    "q, text, hit",
    [("c_ts", "cats", True), ("c%s", "cats", True), ("c\\_ts", "cats", False), ("c\\_ts", "c_ts", True),
     ("a\\d", "a\\d", True), ("a\\\\d", "a\\d", True), ("a\\", "a\\", True), ("100%", "1000", True)],
)
def test_like_pattern(spark, q, text, hit):
    assert one(spark, q, lambda c: F.like(F.lit(text), like_pattern(c))) is hit


@pytest.mark.parametrize(
    "html, field, expected",
    [
        ("<p>first<p>second<b>x</b><p>third<ul><li>a<li>b</ul>tail", "p", ["first", "second<b>x</b>", "third"]),
        ("<div><p>in</div>after<p>x<table>", "p", ["in", "x"]),
        ("<ul><li>a<li>b<ul><li>n1<li>n2</ul>c<li>d</ul>tail", "li", ["a", "b<ul><li>n1<li>n2</ul>c", "n1", "n2", "d"]),
        ("<li>x</li>y<li>z", "li", ["x", "z"]),
        ("<table><tr><td>1<td>2<table><tr><td>in</table>x<tr><td>3</table>", "td", ["1", "2<table><tr><td>in</table>x", "in", "3"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", "dt", ["a", "c"]),
        ("</div><div>a<div>b</div></div><div>open<div>q", "div", ["a<div>b</div>", "b", "open<div>q", "q"]),
    ],
)
def test_elements_without_end_tags(spark, html, field, expected):
    assert one(spark, html, lambda c: H.inner_html(c, H.parse_field(field))) == expected


def test_many_containers_are_read_in_one_pass(spark):
    import time

    def seconds(n):
        html = '<div id="main">' + "<div>some text</div>" * n + "</div>"
        start = time.time()
        found = one(spark, html, lambda c: H.inner_html(c, H.parse_field('<div id="main">')))
        assert len(found) == 1 and len(found[0]) == n * len("<div>some text</div>")
        return time.time() - start

    seconds(100)
    small, large = seconds(5000), seconds(40000)
    assert large < 16 * small + 5


@pytest.mark.parametrize("text, expected", [("&#00000065;&#x00000041;", "AA"), ("&#0000000;", "&#0000000;"), ("&#99999999;", "&#99999999;")])
def test_references_with_leading_zeros(spark, text, expected):
    assert one(spark, text, T.decode_entities) == expected
