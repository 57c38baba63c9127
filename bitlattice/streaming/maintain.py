"""Keep an index current from a stream of keyed rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..engine import BitmapEngine
from ..sources.folders import delete


def append_stream(engine: BitmapEngine, name: str, rows: DataFrame, compact_every: int = 8, order: str | None = None) -> DataStreamWriter:
    """A writer that appends each micro-batch of rows (row_id and the key column, and `order`, see
    BitmapIndex.append) to an index.

    A batch is written as the words that it touches alone, and the index reads them on top of its
    own; every compact_every batches it is written anew as a whole, and the words it was made of
    are deleted, so neither plans nor folders grow with the number of batches, and a batch costs
    what it holds. Appending a batch again, after a failure, changes nothing. DataFrames made
    from the index before a compaction can't be read after it.
    """
    deltas: list[str] = []

    def step(batch: DataFrame, _: int) -> None:
        index = engine.index(name)
        path = f"{engine.root}/{name}-delta-{uuid.uuid4().hex}"
        index = index.append_delta(engine.written(index.delta(batch, order), path))
        deltas.append(path)
        if len(deltas) >= compact_every:
            index = engine.stored(index)
            engine.superseded(name)
            delete(engine.spark, *deltas)
            deltas.clear()
        engine.replace_index(index)

    return rows.writeStream.foreachBatch(step).outputMode("append")
