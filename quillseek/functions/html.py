"""Reading fields out of HTML with column expressions only.

A field is named by a tag (``h1``), a node string (``<div id="main">``) or a short path
(``//meta[@name="keywords"]/@content``). Tags that cannot contain themselves are read with one
regular expression. Containers that can (``div``, ``article``) are read the same way, and only on rows
where the first closing tag is not the right one are the page's tags of that name counted, in one pass.
Elements whose end tag may be left out end where the next one or the element around them does.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillseek.functions.text import decode_entities, is_blank, let, strip_markup

# Elements that HTML closes before another of the same name may start.
FLAT_TAGS = ("title", "h1", "h2", "h3", "h4", "h5", "h6", "p", "a", "button", "head", "body", "html", "main")

# Elements whose end tag may be left out, with the tags that then end them and the elements
# around them; and the tags that end a paragraph.
_OPTIONAL_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "thead", "tbody", "tfoot"), ("table",)),
    "td": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
    "th": (("td", "th", "tr", "thead", "tbody", "tfoot"), ("table",)),
    "option": (("option", "optgroup"), ("select",)),
}
_PARAGRAPH_END = (
    r"(?=<(?:address|article|aside|blockquote|center|details|dialog|dir|div|dl|fieldset|figcaption|figure|footer|form|h[1-6]"
    r"|header|hgroup|hr|main|menu|nav|ol|p|pre|search|section|table|ul|li|dt|dd|td|th|tr)[\s>/])"
    r"|(?=</(?:address|article|aside|blockquote|body|center|details|dialog|div|dl|fieldset|figcaption|figure|footer|form"
    r"|header|hgroup|html|main|menu|nav|ol|pre|search|section|table|ul|li|dt|dd|td|th|tr)[\s>])"
)

_SCRIPT = r"(?is)<script\b.*?</script\s*>"
_COMMENT = r"(?s)<!--.*?-->"
_VALUE = r"""("[^"]*"|'[^']*'|[^\s>"']+)"""
_PREDICATE = re.compile(r"""@?([\w:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>\]]+)))?""")


@dataclass(frozen=True)
class Field:
    tag: str
    attributes: tuple[tuple[str, str | None], ...] = ()
    attribute: str | None = None

    @property
    def opening(self) -> str:
        """Pattern of the opening tag with all wanted attributes, in any order."""
        wanted = ""
        for name, value in self.attributes:
            wanted += r"(?=[^>]*\s%s" % re.escape(name)
            if value is not None:
                text = re.escape(value)
                wanted += r"""\s*=\s*(?:"%s"|'%s'|%s(?=[\s>]))""" % (text, text, text)
            else:
                wanted += r"(?=[\s=>/])"
            wanted += ")"
        return r"<%s(?=[\s>/])%s[^>]*>" % (re.escape(self.tag), wanted)

    @property
    def nests(self) -> bool:
        return self.tag.lower() not in FLAT_TAGS


def parse_field(text: str) -> Field:
    """Settings such as ``<div id="main">`` or ``//meta[@name="x"]/@content`` as a Field."""
    text = text.strip()
    if text.startswith("<"):
        tag, _, rest = text.strip("<>").partition(" ")
        found = _PREDICATE.finditer(rest)
        attribute = None
    else:
        path, _, attribute = text.lstrip("/").partition("/@")
        tag = path.partition("[")[0]
        found = (m for part in re.findall(r"\[([^\]]*)\]", path) for m in [_PREDICATE.match(part)] if m)
    values = tuple((m[1], next((v for v in m.groups()[1:] if v is not None), None)) for m in found)
    return Field(tag, values, attribute or None)


def strip_scripts(html: Column) -> Column:
    return F.regexp_replace(html, _SCRIPT, "")


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, _COMMENT, "")


def _attribute_pattern(field: Field) -> str:
    opening = field.opening.removesuffix("[^>]*>")
    return r"(?is)%s[^>]*?\s%s\s*=\s*%s" % (opening, re.escape(field.attribute), _VALUE)


def _unquote(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def _element_pattern(field: Field) -> str:
    ends = r"</%s\s*>" % re.escape(field.tag)
    if field.tag.lower() == "p":
        ends += "|" + _PARAGRAPH_END
    return r"(?is)%s(.*?)(?:%s|\z)" % (field.opening, ends)


# Kinds of a page's tags when containers are read.
_OTHER, _WANTED, _ENTER, _LEAVE, _NEXT, _END = range(6)
_RUN = 128  # tags read before the containers found in them join those found before


def _kind(piece: Column, field: Field) -> Column:
    """What a tag means for the elements the field names."""
    tag = field.tag.lower()
    siblings, scopes = _OPTIONAL_END.get(tag, ((), (tag,)))
    named = lambda names: "|".join(re.escape(name) for name in names)
    kind = F.when(piece.rlike("(?is)^" + field.opening), _WANTED)
    if siblings:
        kind = kind.when(piece.rlike(r"(?i)^<(?:%s)[\s>/]" % named(siblings)), _NEXT)
        kind = kind.when(piece.rlike(r"(?i)^</%s[\s>/]" % re.escape(tag)), _END)
    kind = kind.when(piece.rlike(r"(?i)^<(?:%s)[\s>/]" % named(scopes)), _ENTER)
    return kind.when(piece.rlike(r"(?i)^</(?:%s)[\s>/]" % named(scopes)), _LEAVE).otherwise(_OTHER)


def _containers(html: Column, field: Field) -> Column:
    """Inner HTML of every matching element, found in one pass over its tags.

    ``depth`` counts open scopes: elements of the same name, or those around elements whose end tag may
    be left out (lists for ``li``). An open wanted element is remembered with the depth at which it ends.
    """
    tag = field.tag.lower()
    siblings, scopes = _OPTIONAL_END.get(tag, ((), (tag,)))
    names = "|".join(re.escape(name) for name in dict.fromkeys((tag, *siblings, *scopes)))
    spans = "array<struct<start:int,depth:int>>"
    done = "array<struct<start:int,end:int>>"
    # A scope of its own name is entered by a wanted element as by any other.
    own_scope = tag in scopes

    def step(state: Column, tag_: Column) -> Column:
        depth, open_ = state["depth"], state["open"]
        entering = (tag_["kind"] == _ENTER) | ((tag_["kind"] == _WANTED) & F.lit(own_scope))
        after = depth + F.when(entering, 1).when(tag_["kind"] == _LEAVE, -1).otherwise(0)
        if own_scope:
            ends = lambda o: (tag_["kind"] == _LEAVE) & (o["depth"] > after)
        else:
            ends = lambda o: (
                ((tag_["kind"] == _LEAVE) & (o["depth"] > after))
                | (tag_["kind"].isin(_WANTED, _NEXT, _END) & (o["depth"] == depth))
            )
        closing = tag_["kind"] != _ENTER
        kept = F.when(closing, F.filter(open_, lambda o: ~ends(o))).otherwise(open_)
        started = F.array(F.struct(tag_["at"].alias("start"), after.alias("depth")))
        ended = F.transform(F.filter(open_, ends), lambda o: F.struct(o["start"].alias("start"), tag_["at"].alias("end")))
        return F.struct(
            after.alias("depth"),
            F.when(tag_["kind"] == _WANTED, F.concat(kept, started)).otherwise(kept).alias("open"),
            F.when(closing & F.exists(open_, ends), F.concat(state["done"], ended)).otherwise(state["done"]).alias("done"),
        )

    def run(state: Column, tags: Column) -> Column:
        start = F.struct(state["depth"].alias("depth"), state["open"].alias("open"), F.array().cast(done).alias("done"))
        return let(
            F.aggregate(tags, start, step),
            lambda now: F.struct(
                now["depth"].alias("depth"), now["open"].alias("open"), F.concat(state["done"], now["done"]).alias("done")
            ),
        )

    def found(pieces: Column) -> Column:
        tags = F.filter(
            F.transform(pieces, lambda piece, i: F.struct(i.alias("at"), _kind(piece, field).alias("kind"))),
            lambda t: t["kind"] != _OTHER,
        )
        zero = F.struct(F.lit(0).alias("depth"), F.array().cast(spans).alias("open"), F.array().cast(done).alias("done"))

        def walk(tags: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(tags) + 1, F.lit(_RUN)), lambda i: i <= F.size(tags))
            end = F.aggregate(F.transform(starts, lambda i: F.slice(tags, i, _RUN)), zero, run)
            return let(
                end,
                lambda state: F.array_sort(
                    F.concat(
                        state["done"],
                        F.transform(state["open"], lambda o: F.struct(o["start"].alias("start"), F.size(pieces).alias("end"))),
                    )
                ),
            )

        def inner(span: Column) -> Column:
            body = F.array_join(F.slice(pieces, span["start"] + 1, span["end"] - span["start"]), "")
            return F.regexp_replace(body, "^<[^>]*>", "")

        return F.transform(let(tags, walk), inner)

    return let(F.split(html, r"(?i)(?=</?(?:%s)[\s>/])" % names), found)


def inner_html(html: Column, field: Field) -> Column:
    """Inner HTML of every element the field names, in page order."""
    if field.tag.lower() in _OPTIONAL_END:
        return _containers(html, field)
    flat = F.regexp_extract_all(html, F.lit(_element_pattern(field)), 1)
    if not field.nests:
        return flat
    again = r"(?i)<%s[\s>/]" % re.escape(field.tag)
    nested = F.exists(flat, lambda part: part.rlike(again))
    return F.when(nested, _containers(html, field)).otherwise(flat)


def matched(html: Column, field: Field) -> Column:
    """Text of every match of the field, character references still in it."""
    if field.attribute:
        found = F.regexp_extract_all(html, F.lit(_attribute_pattern(field)), 1)
        return F.transform(found, _unquote)
    return F.transform(inner_html(html, field), strip_markup)


def _matches(html: Column, field: Field) -> Column:
    pattern = _attribute_pattern(field) if field.attribute else "(?is)" + field.opening
    return html.rlike(pattern)


def _first_inner(html: Column, field: Field) -> Column:
    if field.nests:
        return F.get(inner_html(html, field), F.lit(0))
    return F.regexp_extract(html, _element_pattern(field), 1)


def first_matched(html: Column, fields: Sequence[Field]) -> Column:
    """As first_text, with character references still in it."""
    choice = F
    for field in fields:
        if field.attribute:
            value = _unquote(F.regexp_extract(html, _attribute_pattern(field), 1))
        else:
            value = strip_markup(_first_inner(html, field))
        choice = choice.when(_matches(html, field), value)
    return choice.otherwise(F.lit(None))


def first_text(html: Column, fields: Sequence[Field]) -> Column:
    """Text of the first node of the first field that matches at all, even if empty; else null."""
    return decode_entities(first_matched(html, fields))


def first_inner_html(html: Column, fields: Sequence[Field]) -> Column:
    """As first_text, but with the tags inside the node kept."""
    choice = F
    for field in fields:
        choice = choice.when(_matches(html, field), _first_inner(html, field))
    return choice.otherwise(F.lit(None))


def join_content(parts: Sequence[Column], separator: str = "") -> Column:
    """Matches of one delimiter joined by ``|`` without the empty ones, delimiters by ``separator``."""
    joined = [F.array_join(F.filter(part, lambda t: ~is_blank(t)), "|") for part in parts]
    if not separator:
        return F.concat(*joined)
    return F.array_join(F.filter(F.array(*joined), lambda part: part != ""), separator)


def robots_meta(html: Column, word: str) -> Column:
    """Whether a robots meta tag in the head names the word; attribute order does not matter."""
    head = F.regexp_extract(html, r"(?is)<head\b[^>]*>(.*?)(?:</head|<body\b|\z)", 1)
    meta = parse_field('//meta[@name="robots"]/@content')
    return F.exists(
        F.regexp_extract_all(head, F.lit(_attribute_pattern(meta)), 1),
        lambda value: value.rlike(f"(?i){re.escape(word)}"),
    )


def links(html: Column) -> Column:
    """Quoted link targets cut at ``#``; links whose ``rel`` holds ``nofollow`` are left out.

    Any tag whose name starts with ``a`` and that has a quoted ``href`` counts, ``area`` included.
    """
    pattern = r"""(?is)<a[^>]*?href=(?:"[^"]*"|'[^']*')[^>]*>"""
    tags = F.regexp_extract_all(html, F.lit(pattern), 0)
    followed = F.filter(
        tags, lambda tag: ~tag.rlike(r"""(?i)\s(?:rel\s*=\s*(?:"[^"]*\bnofollow\b[^"]*"|'[^']*\bnofollow\b[^']*'|nofollow\b)|nofollow\s*=)""")
    )
    return F.transform(
        followed,
        lambda tag: F.substring_index(
            _unquote(F.regexp_extract(tag, r"""(?is)href=("[^"]*"|'[^']*')""", 1)), "#", 1
        ),
    )
