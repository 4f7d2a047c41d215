"""URL rules as column expressions. ``site`` is a base URL such as ``https://example.org``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site_of(url: Column) -> Column:
    """Scheme and host of an absolute URL."""
    return F.regexp_extract(url, r"^(https?://[^/?#]+)", 1)


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def is_http(url: Column) -> Column:
    return url.rlike("^https?://")


def is_normal(url: Column) -> Column:
    """Neither a mail, phone or script link nor a bare fragment."""
    return ~url.rlike("(?i)^(?:mailto:|tel:|javascript:|#)")


def site_root(site: Column) -> Column:
    return F.concat(F.rtrim(site, F.lit("/")), F.lit("/"))


def is_local(url: Column, site: Column) -> Column:
    """A normal link that is relative or starts with the site's URL (same scheme, same case)."""
    return is_normal(url) & (~is_http(url) | url.startswith(site_root(site)))


def resolve(href: Column, parent: Column) -> Column:
    """A relative link put beside its page: the parent's last segment is replaced, dots are kept."""
    relative = (
        (href != "") & ~is_http(href) & is_normal(href) & ~href.startswith("/") & (parent != "")
    )
    folder = F.regexp_replace(parent, "/?[^/]*$", "")
    return F.when(relative, F.concat(folder, F.lit("/"), href)).otherwise(href)


def location_of(
    url: Column,
    site: Column,
    parent: Column | None = None,
    web_path: str = "",
    default_language: str = "english",
) -> Column:
    """The site-relative key of a URL: no site, outer slashes, web path or default-language suffix."""
    if parent is not None:
        url = resolve(url, F.coalesce(parent, F.lit("")))
    path = F.btrim(F.replace(url, site_root(site), F.lit("")), F.lit("/"))
    prefix = web_path.strip("/")
    if prefix:
        path = F.when(path.startswith(prefix + "/"), F.substring(path, len(prefix) + 2, 1 << 30)).otherwise(path)
    return F.replace(path, F.lit(f"?lang={default_language}"), F.lit(""))


def absolute_url(location: Column, site: Column) -> Column:
    return F.concat(site_root(site), F.btrim(location, F.lit("/")))


def stored_location(location: Column) -> Column:
    """The site's root is stored under a name of its own."""
    return F.when(location == "", F.lit("home")).otherwise(location)
