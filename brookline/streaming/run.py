"""Programs driven by Structured Streaming: each micro-batch is one receipt and one tick."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.program import Executor


def run_stream(
    node: Executor, messages: DataFrame, channel: str, checkpoint: str, after: Callable[[Executor, int], None] | None = None, order: str | None = None, available_now: bool = True,
    clock: Callable[[], int] | None = None,
) -> StreamingQuery:
    """Feeds a streaming DataFrame into a channel or stdin, after the bootstrap. With a ``clock`` (milliseconds) due periodics fire
    before each tick.

    After each batch the node's tables and clock are written below the checkpoint, with the number of the batch. A node that starts
    anew takes up the last of them, and a batch that Spark replays is not applied twice.

    The order of rows within a batch has no meaning to the set that a channel is; where the order of messages
    matters, they carry a sequence column (``order``), and rows of one batch are received in its order, a receipt each
    distinct value.
    """
    kept = f"{checkpoint.rstrip('/')}-node"
    last = node.restore(kept)
    applied = {"batch": -1 if last is None else last}
    if node.time == 0:
        node.bootstrap_tick()

    def step(rows: DataFrame) -> None:
        node.receive(channel, rows.select(*node[channel].names))
        if clock is not None:
            node.fire(clock())
        node.tick()

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= applied["batch"]:
            return
        if order is None:
            step(batch)
        else:
            for r in batch.select(order).distinct().orderBy(order).toLocalIterator():
                step(batch.where(batch[order] == r[0]))
        node.snapshot(kept, batch_id)
        applied["batch"] = batch_id
        if after is not None:
            after(node, batch_id)

    writer = messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
