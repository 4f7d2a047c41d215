"""Stored indexes: versions that appear whole, and appended changes between them.

Layout under a root folder: ``version=N/slice=K/`` hold the rows of an index by slice, ``changes/batch=N/`` the state
rows of change batches. A location's slice follows from its site and its own name, so that a search of some sites, or
a lookup of some locations, lists the folders that can hold them and opens no other file. A version counts once it
carries a published mark, which is created last, names the last batch the version includes, and lists in which version's
folder each slice lies: a version holds only the slices that its changes touch. Readers never see half an index, and a
failed or empty rebuild leaves the live one in place. Older versions stay for readers that started with them,
until they expire.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillseek.config import SearchConfig
from quillseek.operators.joins import broadcast_if_small
from quillseek.operators.maintenance import KEYS, as_state, carried_dates, upsert, visible

STATE_SCHEMA = (
    "site string, location string, scope string, title string, content string, excerpt string, "
    "language string, seq bigint, date_added timestamp_ntz, deleted boolean, anew boolean"
)

_PUBLISHED = "_PUBLISHED-"
_FILES = 8  # of a large slice


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _listing(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Names and full paths directly under a folder."""
    folder, fs = _fs(spark, path)
    if not fs.exists(folder):
        return []
    return [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(folder)]


def slice_of(site: Column, location: Column, config: SearchConfig) -> Column:
    """A site lies in ``slice_parts`` slices, by location."""
    part = lambda value, many: F.pmod(F.crc32(F.coalesce(value, F.lit("")).cast("binary")), F.lit(many))
    return (part(site, config.site_slices) * config.slice_parts + part(location, config.slice_parts)).cast("int")


def slices_of_site(site: str, config: SearchConfig) -> list[int]:
    first = zlib.crc32(site.encode()) % config.site_slices * config.slice_parts
    return list(range(first, first + config.slice_parts))


def _mark(spark: SparkSession, path: str) -> tuple[int, dict[int, int] | None] | None:
    """The last batch that a version includes and the version that each slice lies in (none: the version is one folder
    without slices, as first written); none if it is not published."""
    for name, full in _listing(spark, path):
        if name.startswith(_PUBLISHED):
            file, fs = _fs(spark, full)
            stream = fs.open(file)
            text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            held = {int(k): v for k, v in json.loads(text).items()} if text else None
            return int(name.removeprefix(_PUBLISHED)), held
    return None


def versions(spark: SparkSession, root: str) -> list[tuple[int, int, str]]:
    """``(number, last change batch it includes, path)`` of the published versions, oldest first."""
    found = []
    for name, path in _listing(spark, root):
        if name.startswith("version="):
            for mark, _ in _listing(spark, path):
                if mark.startswith(_PUBLISHED):
                    number = int(name.removeprefix("version="))
                    found.append((number, int(mark.removeprefix(_PUBLISHED)), path))
    return sorted(found)


def batches(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """Completely written change batches, oldest first."""
    found = []
    for name, path in _listing(spark, f"{root}/changes"):
        if name.startswith("batch=") and any(n == "_SUCCESS" for n, _ in _listing(spark, path)):
            found.append((int(name.removeprefix("batch=")), path))
    return sorted(found)


def _publish(state: DataFrame, root: str, folded: int, config: SearchConfig, kept: dict[int, int] | None = None, empty: bool = False) -> int | None:
    """Write state rows as the next version's slices, then let readers switch to it; ``kept`` are slices of older
    versions that stay as they are. Nothing is published if there is no row at all, unless ``empty``."""
    spark = state.sparkSession
    taken = [int(n.removeprefix("version=")) for n, _ in _listing(spark, root) if n.startswith("version=")]
    number = max(taken, default=0) + 1
    path = f"{root}/version={number}"
    rows = state.withColumn("slice", slice_of(F.col("site"), F.col("location"), config))
    spread = F.pmod(F.xxhash64("location"), F.lit(_FILES))
    rows = rows.repartition("slice", spread).sortWithinPartitions("slice", *KEYS)
    rows.write.option("parquet.bloom.filter.enabled#location", "true").partitionBy("slice").parquet(path)
    held = dict(kept or {})
    held |= {int(name.removeprefix("slice=")): number for name, _ in _listing(spark, path) if name.startswith("slice=")}
    if not held and not empty:
        return None
    draft, fs = _fs(spark, f"{path}/.draft")
    stream = fs.create(draft)
    stream.write(json.dumps(held).encode())
    stream.close()
    fs.rename(draft, _fs(spark, f"{path}/{_PUBLISHED}{folded}")[0])
    return number


def rebuild(records: DataFrame, root: str, config: SearchConfig = SearchConfig()) -> int | None:
    """Full rebuild: the new index replaces the live one and all changes known when it starts.

    An empty rebuild publishes nothing: the live index stays. Changes appended meanwhile apply on top.
    Locations that the live index has keep its ``date_added``.
    """
    spark = records.sparkSession
    known = batches(spark, root)
    if known or versions(spark, root):
        records = carried_dates(records, read_index(spark, root, config))
    return _publish(as_state(records), root, known[-1][0] if known else -1, config)


def clear_index(spark: SparkSession, root: str, config: SearchConfig = SearchConfig()) -> int:
    """Publishes an empty index, which replaces the live one and all changes known when it starts."""
    known = batches(spark, root)
    nothing = spark.createDataFrame([], STATE_SCHEMA)
    return _publish(nothing, root, known[-1][0] if known else -1, config, empty=True)


def append_changes(changes: DataFrame, root: str, batch: int) -> None:
    """One change batch; writing the same batch again replaces it, so retries do no harm."""
    changes.write.mode("overwrite").parquet(f"{root}/changes/batch={batch}")


def _base(spark: SparkSession, root: str, slices: Iterable[int] | None) -> tuple[DataFrame, int, dict[int, int] | None]:
    """Rows of the newest version, all or of some slices; the last batch it includes; where its slices lie."""
    nothing = spark.createDataFrame([], STATE_SCHEMA)
    known = versions(spark, root)
    if not known:
        return nothing, -1, {}
    folded, held = _mark(spark, known[-1][2])
    if held is None:
        return spark.read.schema(STATE_SCHEMA).parquet(known[-1][2]), folded, None
    wanted = held if slices is None else {k: held[k] for k in slices if k in held}
    paths = [f"{root}/version={number}/slice={k}" for k, number in sorted(wanted.items())]
    return (spark.read.schema(STATE_SCHEMA).parquet(*paths) if paths else nothing), folded, held


def _later(spark: SparkSession, root: str, folded: int) -> DataFrame | None:
    paths = [path for number, path in batches(spark, root) if number > folded]
    return spark.read.schema(STATE_SCHEMA).parquet(*paths) if paths else None


def _in_slices(rows: DataFrame, slices: Iterable[int], config: SearchConfig) -> DataFrame:
    return rows.filter(slice_of(F.col("site"), F.col("location"), config).isin(*slices))


def read_state(spark: SparkSession, root: str, config: SearchConfig, slices: Iterable[int] | None = None) -> DataFrame:
    """The newest version with later changes on top, deletions included; of some slices only, if they are given."""
    base, folded, _ = _base(spark, root, slices)
    later = _later(spark, root, folded)
    if slices is not None:
        base, later = _in_slices(base, slices, config), None if later is None else _in_slices(later, slices, config)
    return base if later is None else upsert(base, later, config)


def read_index(spark: SparkSession, root: str, config: SearchConfig, sites: Iterable[str] | None = None) -> DataFrame:
    """What readers see. With ``sites`` only the files that can hold these are opened."""
    if sites is None:
        return visible(read_state(spark, root, config))
    sites = sorted(set(sites))
    slices = sorted({k for site in sites for k in slices_of_site(site, config)})
    return visible(read_state(spark, root, config, slices)).filter(F.col("site").isin(*sites))


def lookup(spark: SparkSession, root: str, wanted: DataFrame, config: SearchConfig) -> DataFrame:
    """Records of the wanted (site, location) pairs, from the files of their slices alone."""
    keys = wanted.select(*KEYS).distinct()
    found = keys.select(slice_of(F.col("site"), F.col("location"), config).alias("k")).distinct().collect()  # no more than there are slices
    rows = visible(read_state(spark, root, config, sorted(r["k"] for r in found)))
    return rows.join(broadcast_if_small(keys, config), KEYS, "left_semi")


def compact(spark: SparkSession, root: str, config: SearchConfig) -> int | None:
    """Fold the appended changes into a new version, which writes the slices that they touch and refers to the others
    where they are; deletions stay, so late changes stay late."""
    known = batches(spark, root)
    last = known[-1][0] if known else -1
    _, folded, held = _base(spark, root, ())
    later = _later(spark, root, folded)
    if held is None or later is None:
        return _publish(read_state(spark, root, config), root, last, config)
    touched = later.select(slice_of(F.col("site"), F.col("location"), config).alias("k")).distinct().collect()
    slices = sorted(r["k"] for r in touched)
    kept = {k: number for k, number in held.items() if k not in slices}
    return _publish(read_state(spark, root, config, slices), root, last, config, kept, empty=True)


def expire(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Remove what the newest ``keep`` versions do not need: folders of older versions, slices that were written anew
    since, and change batches that all of them include. Gives the folders that are gone."""
    known = versions(spark, root)
    if len(known) <= keep:
        return []
    needed: set[tuple[int, int]] = set()
    whole = set()
    for number, _, path in known[-keep:]:
        _, held = _mark(spark, path)
        whole.add(number)
        needed |= {(v, k) for k, v in (held or {}).items()}
    gone = []

    def drop(path: str) -> None:
        folder, fs = _fs(spark, path)
        fs.delete(folder, True)
        gone.append(path)

    for number, _, path in known[:-keep]:
        of_version = [(name, full) for name, full in _listing(spark, path) if name.startswith("slice=")]
        used = [name for name, _ in of_version if (number, int(name.removeprefix("slice="))) in needed]
        if not used:
            drop(path)
            continue
        for name, full in _listing(spark, path):
            if name.startswith(_PUBLISHED):  # no reader starts with it any more
                drop(full)
        for name, full in of_version:
            if name not in used:
                drop(full)
    for number, path in batches(spark, root):
        if number <= known[-keep][1]:
            drop(path)
    return gone


def swap_tables(spark: SparkSession, live: str, staged: str) -> bool:
    """Catalog tables: the staged table takes the live name and the old one is dropped.

    An empty staged table is not swapped in.
    """
    if spark.table(staged).isEmpty():
        return False
    spark.sql(f"DROP TABLE IF EXISTS {live}_old")  # left by a swap that broke off
    if spark.catalog.tableExists(live):
        spark.sql(f"ALTER TABLE {live} RENAME TO {live}_old")
    spark.sql(f"ALTER TABLE {staged} RENAME TO {live}")
    spark.sql(f"DROP TABLE IF EXISTS {live}_old")
    return True
