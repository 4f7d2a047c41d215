"""Sitemaps: reading the listed locations and writing the list of indexed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.config import HOME, SearchConfig
from quillseek.functions.text import decode_entities
from quillseek.functions.urls import absolute_url, location_of
from quillseek.operators.joins import unnest

_LOC = r"(?s)<loc(?:\s[^>]*)?>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</loc\s*>"


def read_sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """Sitemap XML files to ``loc``."""
    return (
        spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path)
    )


def sitemap_locations(files: DataFrame) -> DataFrame:
    """``(site, body)`` with a sitemap's text to ``(site, pos, loc)``: in file order, repeats kept."""
    found = F.regexp_extract_all("body", F.lit(_LOC), 1)
    return unnest(files, ["site"], found, "loc", pos=True).withColumn("loc", decode_entities(F.col("loc")))


def sitemap_paths(locations: DataFrame, config: SearchConfig) -> DataFrame:
    """Locations as canonical paths ``(site, path)``, once each."""
    path = location_of(F.col("loc"), F.col("site"), None, config.web_path, config.default_language)
    return locations.select("site", path.alias("path")).distinct()


def sitemap_list(index: DataFrame) -> DataFrame:
    """Sitemap of every site in the index: ``(site, page, loc, changefreq)`` in order of page.

    The root is listed under its empty name for every site. The order is a range sort, so one large
    site is spread over many tasks.
    """
    named = index.select("site", F.col("location").alias("page")).filter(
        ~F.col("page").isin(HOME, "sitemap.xml", "")
    )
    # Partial aggregation reduces each task to its sites before anything moves.
    roots = index.select("site", F.lit("").alias("page"))
    return (
        named.unionByName(roots)
        .distinct()
        .select("site", "page", absolute_url(F.col("page"), F.col("site")).alias("loc"), F.lit("weekly").alias("changefreq"))
        .orderBy("site", "page")
    )


def write_sitemap(listing: DataFrame, path: str) -> None:
    """Sitemap XML, one ``urlset`` per output file."""
    listing.select("loc", "changefreq").write.format("xml").option("rowTag", "url").option(
        "rootTag", 'urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    ).mode("overwrite").save(path)
