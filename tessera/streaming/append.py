"""Incremental appends from a stream: each micro-batch becomes one append to a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.collection import DatasetCollection
from tessera.types import Annotated


def append_stream(rows: DataFrame, collection: DatasetCollection, checkpoint: str, *, var: DataFrame | None = None, order: list[str], once: bool = True, **add) -> StreamingQuery:
    """Starts a query that adds each micro-batch; the collection's manifest commits it as a whole.

    The manifest also keeps the number of the stream's last batch (the stream is named by its checkpoint), so a batch that was
    committed and is run again is not added twice. The shuffle is seeded by the batch's number unless rng is given.
    """
    seed = add.pop("rng", "stream")

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            collection.add_adatas([Annotated(batch, var, order)], rng=f"{seed}:{number}", batch=(checkpoint, number), **add)

    out = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
