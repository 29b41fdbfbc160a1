"""Stages of the pipeline as streaming queries: a stage reads its queue, and its micro-batches never overlap."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from quillspark import settings

#: Minutes between two runs of a stage.
EVERY_MINUTES = 5


def queues() -> dict[str, str]:
    """The pool of each queue."""
    return {queue: pool for pool, names in settings.QUEUES.items() for queue in names}


def start(stream: DataFrame, queue: str, write: Callable[[DataFrame, int], None], checkpoint: str, minutes: int = EVERY_MINUTES, once: bool = False) -> StreamingQuery:
    """Runs ``write`` on each micro-batch of a queue, every so many minutes, or once on all there is.

    The query has the queue's name, so that a second one for it is refused; the
    checkpoint's folder names the queue too.
    """
    if queue not in queues():
        raise ValueError(f"unknown queue {queue}")
    if minutes < 1:
        raise ValueError("at least one minute")
    trigger = {"availableNow": True} if once else {"processingTime": f"{minutes} minutes"}
    return stream.writeStream.queryName(queue.replace("-", "_")).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{queue}").trigger(**trigger).foreachBatch(write).start()
