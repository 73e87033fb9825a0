"""Token ids in files of patched frame-of-reference blocks.

One segment holds the ids of consecutive documents (ascending id): a document directory, an index of
block starts, and blocks of 128 ids. A block subtracts its minimum, packs the differences bit plane by bit plane at the
width that holds a chosen percentile of them, and lists the others as exceptions (position, high bits).
Segments are rows of a Parquet table in the shared folder, so any store that Spark reaches can hold
them; the payload of each is self-contained and is what ``decode_segment`` reads.

Cases: a null or empty text has no ids of its own (only the end id); documents of any length stay whole;
rows that repeat an id follow each other, in any order among equals; null ids come first; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import binary_array, pieces, shared_path, table, texts
from strata.llm.tokens import worker_encoder

BLOCK = 128
HEAD = 6
PERCENTILE = 90
SEGMENT_IDS = 500_000
#: Distinct chunks that a worker remembers while it writes.
CHUNKS = 1_000_000
MAGIC = b"PFB1"


def widths_of(deltas: np.ndarray, percentile: int = PERCENTILE) -> np.ndarray:
    """Bits that hold the given percentile of each row of ``deltas``."""
    rank = min(BLOCK - 1, (BLOCK * percentile + 99) // 100 - 1)
    at = np.partition(deltas, rank, axis=1)[:, rank]
    return np.where(at > 0, np.floor(np.log2(np.maximum(at, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def encode_ids(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """count, block starts, then the blocks: minimum, width, number of exceptions, packed bits, positions, high bits."""
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    blocks = -(-len(ids) // BLOCK)
    full = np.empty(blocks * BLOCK, dtype=np.int64)
    full[: len(ids)] = ids
    if len(ids):
        full[len(ids) :] = ids[-1]  # the last block is filled with its last id; the count cuts it off again
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.int64)
    deltas = (full - low[:, None]).astype(np.uint32)
    width = widths_of(deltas, percentile) if blocks else np.zeros(0, np.int64)
    high = deltas >> width[:, None].astype(np.uint32)
    count = (high > 0).sum(axis=1)
    size = HEAD + BLOCK // 8 * width + 5 * count
    starts = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros((blocks, HEAD), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(blocks, 4)
    head[:, 4], head[:, 5] = width, count
    out[starts[:, None] + np.arange(HEAD)] = head
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        own = deltas[rows]
        planes = np.empty((len(rows), w, BLOCK), np.uint8)
        for j in range(w):
            planes[:, j] = own >> np.uint32(j) & np.uint32(1)
        out[starts[rows][:, None] + HEAD + np.arange(BLOCK // 8 * w)] = np.packbits(planes.reshape(len(rows), -1), axis=1, bitorder="little")
    block, place = np.nonzero(high)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    lists = (starts + HEAD + BLOCK // 8 * width)[block]
    out[lists + nth] = place
    out[(lists + count[block] + 4 * nth)[:, None] + np.arange(4)] = high[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return struct.pack("<QI", len(ids), blocks) + starts.astype("<u8").tobytes() + out.tobytes()


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of ``encode_ids``, as unsigned 32-bit integers."""
    total, blocks = struct.unpack_from("<QI", data)
    starts = np.frombuffer(data, "<u8", blocks, 12).astype(np.int64) + 12 + 8 * blocks
    raw = np.frombuffer(data, np.uint8)
    low = raw[starts[:, None] + np.arange(4)].copy().view("<u4")[:, 0].astype(np.int64) if blocks else np.zeros(0, np.int64)
    width, count = raw[starts + 4].astype(np.int64), raw[starts + 5].astype(np.int64)
    full = np.zeros((blocks, BLOCK), np.int64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        body = raw[starts[rows][:, None] + HEAD + np.arange(BLOCK // 8 * w)]
        planes = np.unpackbits(body, axis=1, bitorder="little").reshape(len(rows), w, BLOCK)
        own = planes[:, 0].astype(np.uint32)
        for j in range(1, w):
            own |= planes[:, j].astype(np.uint32) << np.uint32(j)
        full[rows] = own
    block = np.repeat(np.arange(blocks), count)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
    lists = (starts + HEAD + BLOCK // 8 * width)[block]
    high = raw[(lists + count[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1).astype(np.int64)
    full[block, raw[lists + nth]] |= high << width[block]
    return (full + low[:, None]).reshape(-1)[:total].astype("<u4")


def decode_block(data: bytes, k: int) -> np.ndarray:
    """Only block ``k``, found through the index of block starts."""
    total, blocks = struct.unpack_from("<QI", data)
    starts = np.frombuffer(data, "<u8", blocks, 12)
    a = 12 + 8 * blocks + int(starts[k])
    b = 12 + 8 * blocks + int(starts[k + 1]) if k + 1 < blocks else len(data)
    return decode_ids(struct.pack("<QI", min(BLOCK, total - k * BLOCK), 1) + bytes(8) + data[a:b])


def encode_segment(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A document directory (null flag, id, number of ids) and the ids."""
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return MAGIC + struct.pack("<I", len(doc_ids)) + null.tobytes() + keys.tobytes() + np.array(lengths, "<u8").tobytes() + encode_ids(ids)


def decode_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, all ids in a row."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment")
    n = struct.unpack_from("<I", data, 4)[0]
    null, at = data[8 : 8 + n], 8 + n
    keys = np.frombuffer(data, "<i8", n, at)
    lengths = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
    return [None if z else int(k) for z, k in zip(null, keys, strict=True)], lengths, decode_ids(data[at + 16 * n :])


def write_token_files(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> None:
    """Writes the ids of every text to ``path``, ascending by id, as segments of about ``SEGMENT_IDS`` ids.

    Texts are dealt by ranges of the id, each range is encoded and written by one task in order. A
    segment's row carries its range, its place and the number of ids that its range holds before it.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id")

    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def segments(batches):
        from pyspark import TaskContext

        part, seq, before = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[bytes] = []
        size = 0

        def flush():
            nonlocal seq, before, docs, held, size
            body = encode_segment(docs, [len(x) // 4 for x in held], np.frombuffer(b"".join(held), "<u4"))
            row = pa.RecordBatch.from_arrays([pa.array([part]), pa.array([seq]), pa.array([before]), pa.array([size]), binary_array([body])], names=["range", "seq", "before", "n_ids", "payload"])
            seq, before, docs, held, size = seq + 1, before + size, [], [], 0
            return row

        encoder = worker_encoder(tokenizer_path, CHUNKS)
        for b in pieces(batches):
            for d, x in zip(b.column(0).to_pylist(), encoder.batch(texts(b.column(1))), strict=True):
                docs.append(d)
                held.append(x + end)
                size += len(held[-1]) // 4
                if size >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    dealt.mapInArrow(segments, "range long, seq long, before long, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (binary, little-endian unsigned 32-bit), read from the files.

    The offset of each range comes from one count per range: as many rows as the writing job had ranges,
    which bounds what is broadcast.
    """
    files = spark.read.schema("range long, seq long, before long, n_ids long, payload binary").parquet(path)
    counts = {r["range"]: r["n"] for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect()}
    starts, total = [], 0
    for k in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(k, 0)

    def documents(batches):
        for b in batches:
            for part, before, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                docs, lengths, ids = decode_segment(payload)
                ends = np.cumsum(lengths)
                first = starts[part] + before + ends - lengths
                raw = ids.tobytes()
                cut = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                for at in range(0, len(docs), 2048):
                    yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + 2048], pa.int64()), pa.array(first[at : at + 2048]), binary_array(cut[at : at + 2048])], names=["doc_id", "start", "ids"])

    return files.select("range", "before", "payload").mapInArrow(documents, "doc_id long, start long, ids binary")


def op7_pfor_blocks(spark, sf_dir: str) -> DataFrame:
    """Start, number and checksum of every document's ids, read back from the files."""
    import public_tokenizers

    path = shared_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    back = read_token_files(spark, path)
    return back.select("doc_id", "start", F.expr("CAST(octet_length(ids) div 4 AS bigint)").alias("n_tokens"), F.crc32("ids").cast("long").alias("ids_crc32"))


