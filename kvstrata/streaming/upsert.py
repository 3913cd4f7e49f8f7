"""The mutation log as a stream.

latest_per_key keeps the newest version of every key as state and is an update-mode aggregate.
sink_to_store flushes each micro-batch into a KvStore; a batch that is run again after a failure
writes the same mutations with the same seq, so the live view doesn't change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..sources.store import KvStore


def latest_per_key(stream: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    return stream.groupBy(key).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("__r")).select(key, "__r.*")


def live_per_key(stream: DataFrame, key: str, order: list[str], payload: list[str], tombstone: str) -> DataFrame:
    """Newest versions; consumers drop a key when its newest version is a tombstone."""
    return latest_per_key(stream, key, order, [*payload, tombstone])


def sink_to_store(stream: DataFrame, store: KvStore, checkpoint: str, force: str | None = "minor") -> DataStreamWriter:
    """A writer that flushes batches of (key, value, tombstone, run, seq)."""

    def flush(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.flush(batch, force=force)

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
