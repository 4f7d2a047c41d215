"""What several corpus operators share: tables, stored intermediate results, words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.session import scratch_path

LIMITS = SearchConfig()  # the package's limits for broadcasts and hot keys
NARROW = SearchConfig(max_broadcast_rows=200_000, max_broadcast_bytes=16 << 20)  # for plans of many joins

# The characters that part words, and the letters that lower-casing changes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The rows, written as Parquet under the shared folder and read again: later jobs start from files
    that outlive executors, and read only the columns they need."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.option("compression", "zstd").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def others(docs: DataFrame, *names: str) -> list[str]:
    """The columns to keep beside a result's own ``names``, which replace columns called alike."""
    return [name for name in docs.columns if name.lower() not in names]


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(modulus)).cast("int")
