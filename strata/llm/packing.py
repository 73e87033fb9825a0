"""Packing documents into sequences by minimum bin slack.

Documents longer than the capacity are cut at multiples of it; those pieces are sequences of their own.
The rest of each document is one piece. For one window of pieces at a time, a subset-sum dynamic program
over bitsets (bit s: some multiset of the remaining lengths sums to s) picks the multiset that fills a
sequence closest to the capacity, starting from the longest piece left; backtracking gives the count of
each length, and the same multiset is used again for as long as its lengths last. Where the closest multiset
leaves slack, every piece left is longer than that: the shortest one is cut, its first part fills the sequence
and the rest is a piece again. What the last sequence holds is cut into sequences whose sizes are powers of
two, so that nothing is padded.

A window is at most ``WINDOW_IDS`` ids of one input partition, so memory is bounded whatever the
partition holds, nothing is shuffled, and a lost task repeats with the same result.

Cases: a null text has no ids but the end id; a document without ids (``pack`` on null or empty ids) yields no
piece; documents of any length are used whole; repeated ids are separate documents; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import table
from strata.llm.tokens import token_ids

CAPACITY = 4096
WINDOW_IDS = 4_000_000


def closest_multiset(counts: dict[int, int], capacity: int, first: int) -> dict[int, int]:
    """The multiset of lengths (at most ``counts`` of each, at least one ``first``) with the largest sum up to capacity."""
    room = capacity - first
    steps: list[tuple[int, int, int]] = []  # length, copies taken together, sums reachable before
    reach, mask = 1, (1 << room + 1) - 1
    full = 1 << room
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        take = 1
        while left > 0 and not reach & full:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << length * take) & mask
            left -= take
            take *= 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    out = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out[length] = out.get(length, 0) + take
    return out


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece index, start in the piece, length); every id of every piece is used once.

    Every sequence but the last few is exactly full; those have sizes that are powers of two.
    """
    stacks: dict[int, list[tuple[int, int]]] = {}  # length left: piece, start; taken from the end, so in order
    for i in range(len(lengths) - 1, -1, -1):
        if lengths[i]:
            stacks.setdefault(int(lengths[i]), []).append((i, 0))
    out: list[list[tuple[int, int, int]]] = []
    last: list[tuple[int, int, int]] = []

    def take(length: int) -> tuple[int, int, int]:
        i, start = stacks[length].pop()
        if not stacks[length]:
            del stacks[length]
        return i, start, length

    while stacks:
        chosen = closest_multiset({k: len(v) for k, v in stacks.items()}, capacity, max(stacks))
        slack = capacity - sum(k * n for k, n in chosen.items())
        times = min(len(stacks[k]) // n for k, n in chosen.items()) if not slack else 1
        for _ in range(times):
            row = [take(k) for k, n in chosen.items() for _ in range(n)]
            if not slack:
                out.append(row)
            elif stacks:
                i, start, k = take(min(stacks))
                out.append([*row, (i, start, slack)])
                stacks.setdefault(k - slack, []).append((i, start + slack))
            else:
                last = row
    total = sum(n for _, _, n in last)
    for b in range(capacity.bit_length() - 1, -1, -1):
        size, row = total & 1 << b, []
        while size:
            i, start, n = last.pop(0)
            if n > size:
                last.insert(0, (i, start + size, n - size))
                n = size
            row.append((i, start, n))
            size -= n
        if row:
            out.append(row)
    return out


def pack(df: DataFrame, id_col: str = "id", ids_col: str = "ids", capacity: int = CAPACITY, window_ids: int = WINDOW_IDS) -> DataFrame:
    """One row per piece: id, start, length, ids (binary), doc_tokens, sequence_id, offset."""
    source = df.selectExpr(f"`{id_col}` as id", f"`{ids_col}` as ids")
    kind = source.schema["id"].dataType.simpleString()

    def window(docs: list, held: list[bytes], base: int):
        sizes = np.array([len(x) // 4 for x in held], np.int64)
        whole = sizes // capacity
        rows: list[tuple[int, int, int, int, int]] = []  # document, start, length, sequence, offset
        seq = base
        for d in np.flatnonzero(whole):
            for k in range(int(whole[d])):
                rows.append((int(d), k * capacity, capacity, seq, 0))
                seq += 1
        for pieces in pack_lengths(sizes - whole * capacity, capacity):
            offset = 0
            for d, start, n in pieces:
                rows.append((d, int(whole[d]) * capacity + start, n, seq, offset))
                offset += n
            seq += 1
        for lo in range(0, len(rows), 4096):
            part = rows[lo : lo + 4096]
            columns = [
                pa.array([docs[r[0]] for r in part], type=kinds),
                pa.array([r[1] for r in part], pa.int64()), pa.array([r[2] for r in part], pa.int64()),
                pa.array([held[r[0]][4 * r[1] : 4 * (r[1] + r[2])] for r in part], pa.binary()),
                pa.array([int(sizes[r[0]]) for r in part], pa.int64()), pa.array([r[3] for r in part], pa.int64()), pa.array([r[4] for r in part], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        return seq

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = to_arrow_type(source.schema["id"].dataType)

    def run(batches):
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 40  # sequences of different partitions never share a number
        docs: list = []
        held: list[bytes] = []
        size = 0
        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(d)
                held.append(x or b"")
                size += len(held[-1]) // 4
                if size >= window_ids:
                    seq = yield from window(docs, held, seq)
                    docs, held, size = [], [], 0
        if docs:
            yield from window(docs, held, seq)

    return source.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def pack_texts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, chunks: int = 600_000) -> DataFrame:
    return pack(token_ids(df, tokenizer_path, id_col, text_col, end_id, chunks))


def op8_slack_packing(spark, sf_dir: str) -> DataFrame:
    """Where every id of every document lies."""
    import public_tokenizers
    from pyspark.sql import functions as F

    packed = pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


