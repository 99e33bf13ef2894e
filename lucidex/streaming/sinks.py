"""Keeping the conversion store fresh from a change feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lucidex import schemas
from lucidex.sources.tables import append_change

#: Changes that drop a stored conversion.
INVALIDATING_KINDS = ("save", "insert", "trash", "delete")


def invalidating_sink(root: str, stream: str = "invalidate") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: drop the changed documents from the store.

    *stream* names the stream, one for each checkpoint; a batch that is replayed is not logged again.
    """

    def apply(batch: DataFrame, epoch: int) -> None:
        changed = batch.filter(batch["kind"].isin(*INVALIDATING_KINDS) & (batch["content_id"] > 0))
        append_change(changed.select("site_id", "content_id").distinct(), root, "drop", schemas.STORE, f"{stream}-{epoch}")

    return apply


def upserting_sink(root: str, stream: str = "upsert") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: put new conversions into the store, each batch once."""

    def apply(batch: DataFrame, epoch: int) -> None:
        append_change(batch, root, "put", schemas.STORE, f"{stream}-{epoch}")

    return apply


def daily_run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """A run that takes everything that arrived since the last one and then ends."""
    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True))
