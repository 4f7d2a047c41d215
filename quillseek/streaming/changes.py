"""Incremental indexing from a stream of content changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillseek.config import SearchConfig
from quillseek.operators.eligibility import gated
from quillseek.operators.maintenance import feed_changes
from quillseek.sources.index_store import append_changes


def index_stream(
    feed: DataFrame,
    pages: DataFrame,
    root: str,
    config: SearchConfig,
    robots: DataFrame | None = None,
    once: bool = False,
    checkpoint: str | None = None,
    repeats: str | None = None,
) -> StreamingQuery:
    """Apply a streaming feed ``(seq, module, site, path, op)`` to the index stored under ``root``.

    Each micro-batch is reduced to the last change per location, re-read and appended as state rows;
    a micro-batch costs what it changes, not what the index holds. Rows carry the feed's ``seq``, so
    batches may split or repeat the feed in any way. The checkpoint sits beside the data and makes
    restarts continue where they stopped.

    ``repeats``, as ``2 hours``, is how long a change is remembered: a copy that arrives within this time, in whatever
    micro-batch, does not read its page again. Keys are kept in the state store and go with the watermark, which follows
    the time of arrival, so that the state is bounded and no change is too late to be applied. A copy that comes
    after that is applied again, which changes nothing.
    """
    if repeats:
        arrived = feed.withColumn("arrived", F.current_timestamp()).withWatermark("arrived", repeats)
        feed = arrived.dropDuplicatesWithinWatermark(["seq", "module", "site", "path", "op"]).drop("arrived")

    def apply(batch: DataFrame, number: int) -> None:
        # Planning reads the batch more than once.
        batch = batch.persist()
        try:
            changes = feed_changes(gated(batch, config), pages, config, robots)
            append_changes(changes, root, number)
        finally:
            batch.unpersist()

    writer = feed.writeStream.foreachBatch(apply).option(
        "checkpointLocation", checkpoint or f"{root}/stream"
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
