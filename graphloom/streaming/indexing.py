"""A stream of changed and deleted documents into the text index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.textindex import TextIndex


def index_stream(changes: DataFrame, index: TextIndex, order: Sequence[str], checkpoint: str, deleted: str = "deleted", **trigger) -> StreamingQuery:
    """Every micro-batch becomes one segment. Of an id's changes in a batch the last by the order counts, of several batches the later one.

    A batch that runs again after a failure is left out if its segment is in the manifest: the manifest holds the batch's number.
    """
    return changes.writeStream.foreachBatch(lambda rows, number: index.apply(rows, order, deleted, number)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
