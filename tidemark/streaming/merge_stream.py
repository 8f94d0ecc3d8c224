"""Merging a stream of source rows: each micro-batch is one temporal merge into the next snapshot of a table.

Rows that come late are merged by their own validity, so no watermark is needed. With each snapshot the table keeps which
batch of which query it holds, so a batch that is run again after a failure is not merged twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.merge import temporal_merge
from tidemark.sources.snapshots import SnapshotTable


def merge_batches(stream: DataFrame, table: SnapshotTable, checkpoint: str, trigger: dict | None = None, on_feedback=None, **spec) -> StreamingQuery:
    """Start a query that merges every batch of `stream` into `table`; spec as in temporal_merge.

    The first snapshot of the table must exist. A query is known by its checkpoint: one that goes on from the checkpoint skips
    the batches that the table holds, and empty ones. on_feedback(batch id, feedback frame) is called with the outcomes of a batch.
    """

    def merge(batch: DataFrame, number: int) -> None:
        held = table.last_batch(checkpoint)
        if held is not None and held >= number or batch.isEmpty():
            return
        found = temporal_merge(table.read(), batch, persist="memory", **spec)
        table.write(found.target_after, writer=checkpoint, batch=number)
        if on_feedback is not None:
            on_feedback(number, found.feedback)
        found.release()

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
