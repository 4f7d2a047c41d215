"""Job settings. One frozen object is passed to every job; nothing is read from globals."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

# Defaults that decide results.
DEFAULT_DELIMITERS = ('<div id="main">', '//meta[@name="keywords"]/@content')
DEFAULT_TITLE_TAGS = ("title", "h1")
DEFAULT_EXCERPT_TAGS = ("p", '//meta[@name="description"]/@content')
DEFAULT_LANGUAGE_TAGS = ("html[@lang]/@lang",)
AUTO_IGNORE = ("sitemap.xml", "robots.txt", "search")
DEFAULT_SCOPE = "pages"
HOME = "home"
SEARCHED_FIELDS = ("location", "title", "content")


@dataclass(frozen=True)
class SearchConfig:
    # What a page record is made of.
    delimiters: tuple[str, ...] = DEFAULT_DELIMITERS
    separator: str = ""
    title_tags: tuple[str, ...] = DEFAULT_TITLE_TAGS
    excerpt_tags: tuple[str, ...] = DEFAULT_EXCERPT_TAGS
    language_tags: tuple[str, ...] = DEFAULT_LANGUAGE_TAGS
    preserve_title_html: bool = False
    title_limit: int = 100
    cleaning_funcs: tuple[Callable[[Column], Column], ...] | None = None

    # Which pages are indexed.
    indexing_enabled: bool = True
    index_method: str = "crawl"  # "crawl", "sitemap" or "auto"
    user_agent: str = "quillseek"
    ignore_robots: bool = False
    exclude: tuple[str, ...] = ()
    scope_rules: tuple[tuple[str, str], ...] = ()
    index_modules: tuple[str, ...] | None = None  # None: every module
    depth: int = 0  # 0: unlimited
    languages: tuple[str, ...] | None = None  # configured; one alone: searches are not filtered by language
    default_language: str = "english"
    web_path: str = ""

    # How queries are answered.
    query_type: str = "match boolean"  # "like", "match" or "match boolean"
    min_length_search: int = 3
    min_length_fulltext: int = 4
    limit: int = 100
    per_page: int = 10
    excerpt_limit: int = 200
    like_literal: bool = False
    min_token: int = 4
    max_token: int = 84
    stop_words: tuple[str, ...] = ()

    # Physical limits: above them the plan changes, the result does not.
    max_broadcast_rows: int = 1_000_000
    max_broadcast_bytes: int = 256 * 1024 * 1024
    hot_rows: int = 1_000_000  # rows of one join key above which they are joined apart
    salts: int = 32
    max_inline_searches: int = 256
    max_inline_bytes: int = 64 * 1024
    postings_buckets: int = 64
    site_slices: int = 64  # of a stored index, and in how many of them a site lies
    slice_parts: int = 4
