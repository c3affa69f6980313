"""Triggers as notifications: a listener is told of each batch of rows that a stream adds to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

Listener = Callable[[str, str, int], None]


def on_insert(stream: DataFrame, table: str, listener: Listener, checkpoint: str, path: str | None = None) -> StreamingQuery:
    """Append every batch of `stream` to the Parquet table at `path` (if one is given) and call listener(table, "INSERT", rows).

    Runs over what is there and ends. A batch that holds no rows isn't told; one that is repeated after a failure is told again.
    """
    def tell(batch: DataFrame, _: int) -> None:
        if path:
            batch.write.mode("append").parquet(path)
        if n := batch.count():
            listener(table, "INSERT", n)

    return stream.writeStream.foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
