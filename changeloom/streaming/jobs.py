"""Streams of changes: applied to a snapshot table per micro-batch, or kept as state; rates and delays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sinks.tables import SnapshotTable


def apply_batches(table: SnapshotTable, keys: list[str], seq: str = "seq", stream: str = "s", compact: int = 8) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch is kept as changes of the target, under the ``stream``'s name and the batch's number.

    A batch costs what it holds; the target is rewritten once ``compact`` batches have come. Replayed batches change
    nothing. A batch may replay events of earlier ones (delivery is at least once), so sequences are not checked here.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        values = [c for c in table.base().columns if c not in keys]
        rows = batch.select(*keys, F.col(seq).alias("seq"), "op", F.struct(*values).alias("new_row"))
        if table.append(rows, f"{stream}-{batch_id}", keys):
            table.compact(compact)

    return run


def stateful_rows(changes: DataFrame, key: str, value: str, seq: str = "seq") -> DataFrame:
    """A stream of each key's row after every micro-batch (key, value, live), kept as state. For targets that fit in state."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live, row = state.get if state.exists else (False, None)
        e = pd.concat(list(frames)).sort_values(seq)
        gone = (e["op"] == "delete").to_numpy().nonzero()[0]
        if len(gone):  # only what follows the last delete counts
            e, live, row = e.iloc[gone[-1] + 1 :], False, None
        if not live and (first := (e["op"] == "insert").to_numpy().nonzero()[0]).size:
            e, live, row = e.iloc[first[0] + 1 :], True, e[value].iloc[first[0]]
        if live and len(late := e.loc[e["op"] == "update", value]):
            row = late.iloc[-1]
        state.update((live, row))
        yield pd.DataFrame({key: [k[0]], value: [row], "live": [live]})

    kinds = {f.name: f.dataType.simpleString() for f in changes.schema.fields}
    return changes.groupBy(key).applyInPandasWithState(
        step, f"{key} {kinds[key]}, {value} {kinds[value]}, live boolean", f"live boolean, {value} {kinds[value]}", "update", GroupStateTimeout.NoTimeout)


def rate(events: DataFrame, time: str = "event_time", watermark: str = "1 minute") -> DataFrame:
    """Events per second of each ten-second window, whole numbers."""
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    e = e.withWatermark("_t", watermark) if e.isStreaming else e
    g = e.groupBy(F.window("_t", "10 seconds")).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), F.expr("n div 10").alias("qps"), "n")


def delay(events: DataFrame, now_seconds: int | None = None) -> DataFrame:
    """Per table, seconds between now and the log time of its latest event."""
    now = F.lit(now_seconds) if now_seconds is not None else F.unix_timestamp()
    return events.groupBy("database", "table").agg((now - F.max("db_time")).cast("long").alias("delay_sec"))
