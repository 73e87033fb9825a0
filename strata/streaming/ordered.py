"""Emission in order: lines of a source are handed on once all lines before them have come.

Each source's state, kept in RocksDB, holds what has come too early, by place, and the next place that is waited for.
Whatever order rows arrive in, what goes out is the contiguous prefix, once. A row that covers several blocks says where the
next one begins. Rows behind the place that is waited for have been handed on already and are dropped, so a source that is replayed
gives nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "source string, block long, end long, line string"


class InOrder(StatefulProcessor):
    """Input and output: source, block, end (exclusive), line."""

    def __init__(self, first: int = 0):
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.next = handle.getValueState("next", "block long")
        self.held = handle.getMapState("held", "block long", "end long, line string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.next.get()[0] if self.next.exists() else self.first
        for batch in rows:
            for block, end, line in zip(batch["block"], batch["end"], batch["line"], strict=True):
                if block >= at:
                    self.held.updateValue((int(block),), (int(end), line))
        out = []
        while self.held.containsKey((at,)):
            end, line = self.held.getValue((at,))
            out.append((key[0], at, end, line))
            self.held.removeKey((at,))
            at = max(end, at + 1)
        self.next.update((at,))
        yield pd.DataFrame(out, columns=["source", "block", "end", "line"])

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, first: int = 0) -> DataFrame:
    """The rows (source, block, end, line) of a stream in the order of each source's blocks, from block ``first`` on.

    Of rows of one place the last to come before it is handed on counts; rows without source or place are left out; what never becomes contiguous stays in the state.
    """
    wanted = rows.where("source is not null and block is not null and end is not null").select("source", "block", "end", "line")
    return wanted.groupBy("source").transformWithStateInPandas(InOrder(first), OUT, "Append", "None")


def start(rows: DataFrame, path: str, checkpoint: str, first: int = 0):
    """A streaming query that appends what is in order to Parquet under ``path``; goes on from its checkpoint."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    out = in_order(rows, first)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
