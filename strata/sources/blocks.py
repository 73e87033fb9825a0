"""Block sources: a Python data source over one file, and blocks of a binary column."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

LOOK_AHEAD = 2048
#: Blocks in one Arrow batch.
BATCH = 2048
SCHEMA = "source_id string, block long, window_len int, window binary"


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def windows(data: bytes, n: int, size: int, look: int) -> pa.Array:
    """The first n blocks of the data, each with all that is there of its look-ahead, as one binary array."""
    whole = max(0, min(n, (len(data) - look) // size + 1))  # blocks whose window is not cut
    lengths = np.full(n, look, np.int64)
    lengths[whole:] = np.maximum(0, np.minimum(look, len(data) - np.arange(whole, n) * size))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(int(offsets[-1]), np.uint8)
    flat = np.frombuffer(data, np.uint8)
    if whole:
        out[: whole * look].reshape(whole, look)[:] = np.lib.stride_tricks.sliding_window_view(flat, look)[: whole * size : size]
    for i in range(whole, n):
        out[offsets[i] : offsets[i + 1]] = flat[i * size : i * size + lengths[i]]
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)]).cast(pa.binary())


class BlockReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.size = int(options.get("blockSize", 512))
        self.start = int(options.get("startBlock", 0))
        self.per = int(options.get("blocksPerPartition", 65536))
        self.end: int | None = None

    def pushFilters(self, filters):
        """Comparisons of ``block`` with a number bound the blocks that are read at all; the rest is left to Spark."""
        for f in filters:
            low = high = None
            if getattr(f, "attribute", None) == ("block",) and isinstance(getattr(f, "value", None), int):
                low = {EqualTo: f.value, GreaterThan: f.value + 1, GreaterThanOrEqual: f.value}.get(type(f))
                high = {EqualTo: f.value + 1, LessThan: f.value, LessThanOrEqual: f.value + 1}.get(type(f))
            if low is None and high is None:
                yield f
                continue
            self.start = max(self.start, low) if low is not None else self.start
            self.end = high if self.end is None else min(self.end, high) if high is not None else self.end

    def partitions(self):
        if not os.path.isfile(self.path) or not os.path.getsize(self.path):
            raise ValueError(f"not a file with data: {self.path}")
        blocks = -(-os.path.getsize(self.path) // self.size)
        blocks = blocks if self.end is None else min(blocks, self.end)
        return [_Range(i, min(i + self.per, blocks)) for i in range(self.start, blocks, self.per)] or [_Range(0, 0)]

    def read(self, part):
        look = max(LOOK_AHEAD, self.size)
        with open(self.path, "rb") as f:
            for at in range(part.first, part.last, BATCH):  # so many blocks and the look-ahead of the last one at a time
                n = min(BATCH, part.last - at)
                f.seek(at * self.size)
                data = f.read((n - 1) * self.size + look)
                window = windows(data, n, self.size, look)
                yield pa.RecordBatch.from_arrays([pa.array([self.path] * n), pa.array(np.arange(at, at + n)), pa.compute.binary_length(window), window], names=["source_id", "block", "window_len", "window"])


class BlockSource(DataSource):
    """``spark.read.format("blocks").option("path", …)``: every block with its look-ahead window.

    Options: blockSize (512), startBlock (0), blocksPerPartition (65536). Each partition seeks to its own
    blocks and reads the tail it needs itself, so partitions do not depend on one another. Rows come in Arrow batches, and
    filters on ``block`` with numbers choose the partitions (``register`` turns that on in the session).
    """

    @classmethod
    def name(cls):
        return "blocks"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return BlockReader(self.options)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)


def column_blocks(df: DataFrame, id_col: str, data_col: str, block: int = 512, start: int = 0, look_ahead: int = LOOK_AHEAD) -> DataFrame:
    """id, block, window_len, data (the block), window (block and look-ahead) of a binary column."""
    n = F.octet_length(data_col)
    last = F.call_function("div", n - 1, F.lit(block)).cast("long")
    blocks = df.where(n > start * block).select(id_col, data_col, F.explode(F.sequence(F.lit(start).cast("long"), last)).alias("block"))
    at = (F.col("block") * block + 1).cast("int")
    window = F.substring(F.col(data_col), at, F.lit(max(look_ahead, block)))
    return blocks.select(id_col, "block", F.octet_length(window).alias("window_len"), F.substring(F.col(data_col), at, F.lit(block)).alias("data"), window.alias("window"))


def raw_view(data, offset: int, length: int | None = None):
    """Bytes from ``offset`` on, to the end without ``length``."""
    return F.substring(data, offset + 1, length if length is not None else 2147483647)
