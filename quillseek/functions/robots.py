"""robots.txt bodies to patterns. One body is one row, so no rule ever needs a shuffle or a window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillseek.functions.text import quote_pattern

# The words of the format. Unix line ends only: a carriage return belongs to its line and is trimmed from the value.
_SECTION = r"(?ids)\nuser-agent:[^#\n].*?(?=\nuser-agent:[^#\n]|\z)"
_AGENT = r"(?id)^\nuser-agent:([^#\n]+)"
_DISALLOW = r"(?idm)^.*?disallow:([^#\n]+).*$"
_EDGES = r"^[\s\x00]+|[\s\x00]+$"


def disallowed(body: Column, user_agent: str) -> Column:
    """Values of the ``Disallow`` lines that apply to ``*`` or the agent, in file order.

    Each ``User-agent`` line replaces the one before it, so of stacked lines only the last decides.
    """
    sections = F.regexp_extract_all(F.concat(F.lit("\n"), body), F.lit(_SECTION), 0)
    ours = F.filter(
        sections,
        lambda part: F.regexp_replace(F.regexp_extract(part, _AGENT, 1), _EDGES, "").isin("*", user_agent),
    )
    values = F.flatten(F.transform(ours, lambda part: F.regexp_extract_all(part, F.lit(_DISALLOW), 1)))
    trimmed = F.transform(values, lambda value: F.regexp_replace(value, _EDGES, ""))
    return F.filter(trimmed, lambda value: value != "")


def disallow_regex(pattern: Column) -> Column:
    """Unanchored pattern of one rule: ``*`` is a wildcard, everything else stands for itself."""
    parts = F.split(F.ltrim(pattern, F.lit("/")), r"\*", -1)
    return F.array_join(F.transform(parts, quote_pattern), ".*")


def combined_regex(patterns: Column) -> Column:
    """All rules of a site as one alternative; null where there are none."""
    each = F.transform(patterns, lambda p: F.concat(F.lit("(?:"), disallow_regex(p), F.lit(")")))
    return F.when(F.size(patterns) > 0, F.array_join(each, "|"))
