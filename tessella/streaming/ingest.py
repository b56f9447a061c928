"""Continuous ingest: streams of writes appended to a log, and the latest versions kept as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The number of a write is that of its micro-batch, above this many writes, and its place in it.
BATCH_BITS = 40


def ingest(writes: DataFrame, path: str, checkpoint: str, order: str, trigger: dict | None = None) -> StreamingQuery:
    """Append a stream of writes (row, column, ts, value and a column of their order) to a log at `path`.

    A batch is written to a folder named by its id, so one that is run again after a failure replaces
    itself: each write is there once.
    """

    def append(batch: DataFrame, n: int) -> None:
        seq = (F.lit(n).cast("long") * (1 << BATCH_BITS) + F.col(order).cast("long")).alias("seq")
        batch.select(seq, "row", "column", "ts", "value").write.mode("overwrite").parquet(f"{path}/batch={n}")

    w = writes.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def _newest(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, k: int) -> Iterator[pd.DataFrame]:
    held = dict(zip(*state.get, strict=True)) if state.exists else {}
    for b in batches:
        for ts, value in zip(b["ts"], b["value"], strict=True):
            held[int(ts)] = value
        held = dict(sorted(held.items(), reverse=True)[:k])
    state.update((list(held), list(held.values())))
    yield pd.DataFrame({"row": key[0], "column": key[1], "ts": list(held), "value": list(held.values())})


def latest_versions(writes: DataFrame, k: int) -> DataFrame:
    """A stream of the newest k versions of each (row, column) that a batch touches; state is k versions a key."""
    return writes.groupBy("row", "column").applyInPandasWithState(
        lambda key, batches, state: _newest(key, batches, state, k),
        "row string, column string, ts long, value string",
        "ts array<long>, value array<string>",
        "update",
        GroupStateTimeout.NoTimeout,
    )
