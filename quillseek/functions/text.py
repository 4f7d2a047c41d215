"""Text cleaning, cutting, snippets and highlighting as column expressions (no Python at run time)."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"

_ENTITY = r"^&(#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# The references almost all pages use, with the ampersand last.
_COMMON = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))
_UNCOMMON = r"&(?!(?:%s);)(?:#0*[0-9]{1,7}|#[xX]0*[0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);" % "|".join(
    name.strip("&;") for name, _ in _COMMON
)
_NAMES = json.dumps({name: chr(code) for name, code in name2codepoint.items()})
# Java's \s; the run's first character stands for the run.
_BLANKS = r"(\s)\s+"
_EDGES = " \t\n\r\f\x0b"
_MARKUP = r"(?s)<!--.*?(?:-->|\z)|<[^\s>][^>]*(?:>|\z)"
_CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_blank(text: Column) -> Column:
    """The emptiness test of page fields: nothing, an empty string, or the string ``0``."""
    return text.isNull() | text.isin("", "0")


def strip_markup(text: Column) -> Column:
    """Tags and comments removed; the text around them is glued together."""
    return F.regexp_replace(text, _MARKUP, "")


def drop_controls(text: Column) -> Column:
    """Control characters removed, tabs and line ends kept."""
    return F.regexp_replace(text, _CONTROLS, "")


def collapse_blanks(text: Column) -> Column:
    """Each run of whitespace becomes its first character; both ends are trimmed."""
    return F.btrim(F.regexp_replace(text, _BLANKS, "$1"), F.lit(_EDGES))


def _code_point(hex_digits: Column) -> Column:
    return F.decode(F.unhex(F.lpad(hex_digits, 8, "0")), "UTF-32")


def _decode_piece(piece: Column, names: Column) -> Column:
    body = F.regexp_replace(F.regexp_extract(piece, _ENTITY, 1), r"^#([xX]?)0+(?=[0-9a-fA-F])", "#$1")
    hexed = F.when(body.rlike("^#[xX]"), F.upper(F.substring(body, 3, 8))).otherwise(
        F.conv(F.substring(body, 2, 8), 10, 16)
    )
    number = F.conv(hexed, 16, 10).cast("long")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    char = (
        F.when(body == "", F.lit(None))
        .when(body == "amp", F.lit("&"))
        .when(body.startswith("#"), F.when(valid, _code_point(hexed)))
        .otherwise(F.element_at(names, body))
    )
    return F.when(char.isNull(), piece).otherwise(
        F.concat(char, F.regexp_replace(piece, _ENTITY, ""))
    )


def decode_entities(text: Column) -> Column:
    """Named and numeric character references decoded once, left to right.

    Replacing the common ones with the ampersand last is such a single pass. A text with any other
    reference is cut in front of every ``&`` instead and each piece is decoded on its own, so a decoded
    ``&`` can never start another reference.
    """
    names = F.from_json(F.lit(_NAMES), "map<string,string>")

    def in_pieces(raw: Column) -> Column:
        pieces = F.split(raw, "(?=&)")
        return F.array_join(F.transform(pieces, lambda piece: _decode_piece(piece, names)), "")

    def decode(raw: Column) -> Column:
        common = raw
        for name, char in _COMMON:
            common = F.replace(common, F.lit(name), F.lit(char))
        return (
            F.when(~F.contains(raw, F.lit("&")), raw)
            .when(raw.rlike(_UNCOMMON), in_pieces(raw))
            .otherwise(common)
        )

    return let(text, decode)


def encode_entities(text: Column) -> Column:
    """``& < > "`` encoded once: references already there are left alone."""
    bare = r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);)"
    text = F.regexp_replace(text, bare, "&amp;")
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def clean(
    text: Column, encode: bool = False, funcs: Sequence[Callable[[Column], Column]] | None = None
) -> Column:
    """Make text searchable: cleaning functions, entities, tags, whitespace; null becomes empty."""
    text = F.coalesce(text, F.lit(""))
    for func in (drop_controls,) if funcs is None else funcs:
        text = func(text)
    text = encode_entities(text) if encode else decode_entities(text)
    return collapse_blanks(strip_markup(text))


def limit_chars(text: Column, limit: int) -> Column:
    """Cut at the first word end at or after ``limit - 1`` characters; mark the cut with an ellipsis."""
    head_pattern = "(?s)^(.{%d,}?)(?: |$)" % max(limit - 1, 0)

    def cut(flat: Column) -> Column:
        words = F.trim(flat)
        head = F.when(F.length(words) < limit - 1, words).otherwise(
            F.trim(F.regexp_extract(words, head_pattern, 1))
        )
        return let(
            head,
            lambda kept: F.when(F.length(kept) == F.length(flat), kept).otherwise(
                F.concat(kept, F.lit(ELLIPSIS))
            ),
        )

    def fit(whole: Column) -> Column:
        flat = F.regexp_replace(whole, r"\s+", " ")
        return F.when(F.length(whole) < limit, whole).otherwise(
            let(flat, lambda line: F.when(F.length(line) <= limit, line).otherwise(cut(line)))
        )

    return let(text, fit)


def format_title(
    title: Column, limit: int, funcs: Sequence[Callable[[Column], Column]] | None = None
) -> Column:
    return limit_chars(clean(title, encode=True, funcs=funcs), limit)


def snippet(text: Column, limit: int = 100, word: Column | None = None, variance: int = 50) -> Column:
    """Text around a word: it starts ``variance`` characters before the word, at a word boundary."""
    if word is None:
        return limit_chars(text, limit) if limit else text
    found = F.coalesce(F.instr(F.lower(text), F.lower(word)), F.lit(0)) - 1
    start = F.greatest(found - variance, F.lit(0))

    def cut(window: Column, from_start: Column) -> Column:
        gap = F.greatest(F.instr(window, " "), F.lit(1))
        rest = F.concat(F.lit(ELLIPSIS), F.substring(window, gap, F.length(window)))
        return F.when(from_start == 0, window).otherwise(rest)

    def around(begin: Column) -> Column:
        window = F.substring(text, begin + 1, F.length(text))
        if limit:
            window = limit_chars(window, limit)
        return let(window, lambda shown: cut(shown, begin))

    return let(start, around)


def excerpt_source(excerpt: Column, content: Column, limit: int = 100) -> Column:
    """The excerpt, or the content where the excerpt is empty or shorter (in bytes) than the limit."""
    short = F.coalesce(is_blank(excerpt) | (F.octet_length(excerpt) < limit), F.lit(True))
    return F.when(short, content).otherwise(excerpt)


def quote_pattern(text: Column) -> Column:
    """A regular expression that matches the text itself."""
    inner = F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), inner, F.lit("\\E"))


def highlight(text: Column, phrase: Column, before: str, after: str) -> Column:
    """Every occurrence of the phrase, in any case, wrapped in the given marks."""
    marked = F.regexp_replace(
        text,
        F.concat(F.lit("(?iu)("), quote_pattern(phrase), F.lit(")")),
        F.lit(f"{before}$1{after}"),
    )
    return F.when(F.coalesce(phrase, F.lit("")) == "", text).otherwise(marked)
