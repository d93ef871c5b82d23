"""Incremental sync of manifest rows as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from seamline.operators import store


def upsert_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Apply each micro-batch of changes (repo, id, file, json, ord; json null: deleted) to the stored table at ``path``.

    Each batch is a version with the batch's number as its label, so that one which is repeated after a restart changes
    nothing, and leaves the files it touched beside it. Changes may come in any order: the largest ``ord`` of a key wins.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.commit(batch.sparkSession, path, batch.select("repo", "id", "file", "json", "ord"), label=f"batch {number}")

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
