"""Runs a program over every micro-batch of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine, Result
from ..plans import Compiled
from ..sources.hosts import Host


def run_stream(stream: DataFrame, program: Compiled, relation: str, sink: Callable[[Result, int], None], host: Host | None = None, trigger: dict | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Feeds each micro-batch of ``stream`` to the program as ``relation`` and gives its result to ``sink``.

    The relation's facts are those of the batch alone; with a ``checkpoint`` folder a restarted query goes on behind the last batch.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        sink(Engine(batch.sparkSession, program, host, {relation: batch}).run(), epoch)

    writer = stream.writeStream.foreachBatch(each).trigger(**(trigger or {"availableNow": True}))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
