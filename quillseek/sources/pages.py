"""Fetched pages: ``(site, path, url, html, status, seq)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.functions.urls import location_of, site_of, without_fragment

DATE = "timestamp_ntz"  # as MySQL's datetime, without a zone


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Page rows laid out by site and path, so that reading again what changed on some sites skips the other files."""
    pages.repartitionByRange("site", "path").sortWithinPartitions("site", "path").write.parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """A scan of fewer splits than there are cores, spread over them.

    Extraction is bound by the processor, and a small file is a single split. Large inputs have more
    splits than cores and are left as they are.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if frame.rdd.getNumPartitions() < cores else frame


def page_rows(raw: DataFrame, config: SearchConfig, seq: str | None = None, added: str | None = None) -> DataFrame:
    """Rows with a site, a canonical path and an order.

    ``site`` and ``status`` are used when the input has them. ``seq`` names the column that orders
    copies of one page; without one the URL and HTML decide. ``added`` names the time that becomes the
    ``date_added`` of records that are new; without one it is null.
    """
    site = F.col("site") if "site" in raw.columns else site_of(F.col("url"))
    status = F.col("status").cast("int") if "status" in raw.columns else F.lit(None).cast("int")
    order = F.col(seq).cast("long") if seq else F.xxhash64("url", "html")
    rows = raw.select(
        site.alias("site"),
        without_fragment(F.col("url")).alias("url"),
        "html",
        status.alias("status"),
        order.alias("seq"),
        (F.col(added) if added else F.lit(None)).cast(DATE).alias("date_added"),
    )
    path = location_of(
        F.col("url"), F.col("site"), None, config.web_path, config.default_language
    )
    return rows.withColumn("path", path)


def fetched(pages: DataFrame) -> DataFrame:
    """Pages that were answered without an error."""
    return pages.filter(F.col("status").isNull() | (F.col("status") < 400))


def listed_pages(listing: DataFrame, config: SearchConfig) -> DataFrame:
    """Rows ``(site, pages)`` with comma-separated page lists to ``(site, path)``, once each."""
    each = listing.select("site", F.explode(F.split("pages", ",")).alias("page"))
    path = location_of(
        F.col("page"), F.col("site"), None, config.web_path, config.default_language
    )
    return each.select("site", path.alias("path")).distinct()
