"""The merges as streams. There is no watermark: a late change is judged by its own clock, whatever its age."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from lectern.operators.changefeed import DeleteVectorTable, deliver

STATE = "at long, arrival long, text string, change_id long"
OUT = "account_id long, book_id string, h string, at long, arrival long, text string, change_id long"


def standing_edit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The newest edit of a key so far; emitted when it changes. State is one row a key."""
    held: Any = state.get if state.exists else None
    before = held
    for part in parts:
        for row in part.itertuples(index=False):
            if held is None or (row.at, row.arrival) >= (held[0], held[1]):
                held = (row.at, row.arrival, row.text, row.change_id)
    if held is not None and held != before:
        state.update(held)
        yield pd.DataFrame([(*key, *held)], columns=[c.split()[0] for c in OUT.split(", ")])


def edit_stream(changes: DataFrame) -> DataFrame:
    """Streaming last-writer-wins over (account, book, h): rows (account_id, book_id, h, at, arrival, text, change_id)."""
    rows = changes.select("account_id", "book_id", "h", "at", "arrival", "text", "change_id")
    return rows.groupBy("account_id", "book_id", "h").applyInPandasWithState(standing_edit, OUT, STATE, "update", "NoTimeout")


def feed_stream(changes: DataFrame, table: DeleteVectorTable, checkpoint: str):
    """Commit every micro-batch of shelf changes to a delete-vector table.

    A commit bears its micro-batch's number: one that is replayed after a restart does nothing, one
    that failed half way is written again; a change delivered again counts at its first arrival.
    """
    return changes.writeStream.foreachBatch(lambda batch, n: deliver(table, batch, f"batch{n}")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def quiet_periods(changes: DataFrame, gap: str = "2.5 seconds", lateness: str = "1 minute") -> DataFrame:
    """(account_id, book_id, window, n): pushes after a quiet period, as session windows of event time."""
    rows = changes.withWatermark("ts", lateness) if changes.isStreaming else changes
    return rows.groupBy("account_id", "book_id", F.session_window("ts", gap).alias("window")).agg(F.count("*").alias("n"))
