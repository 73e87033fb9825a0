"""Shared pieces: words, stable hashes, Arrow helpers and distributed connected components."""

from __future__ import annotations

import ctypes
import math
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  used as pa.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.session import checkpoint, shared_dir

#: A word is a run of characters other than these (the six ASCII white-space characters).
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_col(text):
    """Words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new folder under the one that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more, in whatever store they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


#: Rows that one partition of a compacted checkpoint holds.
COMPACT_ROWS = 200_000


def compact(df: DataFrame) -> tuple[DataFrame, int]:
    """A checkpoint in as many partitions as its rows need, and their number.

    Loops over few rows would else send them through shuffles of (partitions) x (partitions) near-empty blocks.
    """
    out = checkpoint(df)
    n = out.count()
    return out.coalesce(max(1, math.ceil(n / COMPACT_ROWS))), n


def trim(*caches: dict) -> None:
    """Empties caches and hands freed memory back, so that an idle worker kept for reuse stays small."""
    for c in caches:
        c.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for what is run inside: bounds a worker's memory where rows hold texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; a shorter text is one shingle as a whole; no words give none."""
    n = len(words)
    if n == 0:
        return words
    take = min(width, n)
    out = np.zeros(n - take + 1, dtype=np.uint64)
    for i in range(take):
        out = mix64(out + words[i : n - take + 1 + i] + np.uint64(i + 1))
    return out


#: Bytes that end a word, and a random 64-bit value of each byte; A-Z have those of a-z.
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_VALUES = np.random.default_rng(29).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[65:91] = _VALUES[97:123]
_BASE = 0x9E3779B97F4A7C15
#: Values that do not tell white space from letters, for other ways to part words.
LETTER_VALUES = _VALUES.copy()
_VALUES[_SPACES] = 0


def word_hashes(column: pa.Array, spaces: np.ndarray = _SPACES, values: np.ndarray = _VALUES) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of all texts of a column, and where each text's begin (one more at the end).

    ``spaces`` says which bytes part words; ``values`` must be 0 there.

    A word's hash is the sum of its bytes' values times powers of ``_BASE``, mixed. All texts are hashed in one pass;
    null is empty.
    """
    arr = column.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if not len(arr) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    letter = ~spaces[data]
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    opens[edges] = letter[edges]
    begin = np.flatnonzero(opens)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(arr) + 1, np.int64)
    place = np.arange(begin[0], len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data))))
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    sums = np.add.reduceat(values[data[begin[0] :]] * powers[place], begin - begin[0])
    return mix64(sums), np.searchsorted(begin, offsets)


def text_shingles(column: pa.Array, width: int, limit: int = 4 << 20) -> list[np.ndarray]:
    """Shingle hashes of each text of a column, in order (``shingle_hashes`` of its words).

    Texts are hashed together, up to ``limit`` bytes at a time, as the temporary arrays are 30 times as large.
    """
    size = np.cumsum(np.nan_to_num(pa.compute.binary_length(column.cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(float)))
    out: list[np.ndarray] = []
    while len(out) < len(column):
        at = len(out)
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
        words, first = word_hashes(column.slice(at, to - at))
        whole = shingle_hashes(words, width) if len(words) >= width else words[:0]
        for p, q in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            out.append(whole[p : q - width + 1] if q - p >= width else shingle_hashes(words[p:q], width))
    return out


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def binary_array(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, type=pa.binary())


def pieces(batches, rows: int = 512):
    """Arrow batches cut into pieces of few rows, so that what a worker builds for one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) per node, root the smallest node.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of a
    component's size, every step is joins and sums by key, and each round is checkpointed, so neither
    the driver nor one task ever holds a component.
    """
    e, _ = compact(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    while True:
        both = e.select(F.col("b").alias("u"), F.col("a").alias("v")).union(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.select(F.col("v").alias("b"), F.col("m").alias("a")).where("a < b").union(least.select(F.col("u").alias("b"), F.col("m").alias("a")))
        e, n = compact(nxt.select("a", "b").distinct())
        state = (n, *e.agg(F.sum("a"), F.sum("b"), F.sum(F.hash("a", "b").cast("long"))).first())
        if state == before:
            break
        before = state
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).union(e.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
