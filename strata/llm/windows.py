"""Substring dedup by compact windows.

Tokens are 5-word shingles. For one hash function, the shingle of least hash in a stretch is the root of a
Cartesian tree; every node (l, c, r) of it with r - l + 1 >= ``SPAN`` is a compact window: all stretches inside
l..r that contain c share the min-hash c. ``BANDS`` bands of two hash functions are used; where the windows of
both functions intersect in a stretch of at least ``SPAN`` shingles (50 words), that intersection gets a key made
of both min-hashes. Equal keys of different documents are candidates: their stretches are joined over all bands
into intervals, and the intervals are checked on the shingles themselves: stretches of ``SPAN`` shingles that
share at least ``percent`` of their union are near-duplicate passages.

Plan: documents of equal text are one (the least id stands for all). Rows go by key; the keys that a sample finds in
many documents go in parts, and the first rows of the parts meet. Each row of a key meets the first and the one before
it, the first ``SMALL`` meet each other, and these pairs are checked on the texts. So keys of up to ``SMALL`` rows are
checked whole. In larger ones, all pairs that still join two components, or whose second stretch holds no passage yet that
a smaller document holds, are compared in cells of bounded size: every two documents that share a key are in one component,
or proven not to share a passage there. Rows grow with the text, not with the square of a passage's documents; the
comparisons in cells (counts of common shingles) grow with a key's rows times those outside its main component or open.

Cases: null, empty and short texts (under 50 words) hold no passage; texts of any length are read whole; rows
that repeat a doc_id are one document each (all get the class of that id; with different texts the passages are
those of any of them); rows with a null doc_id hold no passage; an empty table gives an empty result; extra
columns are ignored by ``passage_classes`` and kept by ``cut_passages``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import binary_array, checkpoint, compact, components, mix64, pieces, remove, shared_path, small_batches, table, text_shingles, texts, trim
from strata.llm.minhash import maybe_broadcast

WIDTH = 5
WORDS = 50
SPAN = WORDS - WIDTH + 1
BANDS = 5
SMALL = 4
#: One document in so many is looked at to find keys that many hold; rows there that make a key frequent; rows of one
#: part of such a key; keys that are listed at most.
SAMPLE, FREQUENT, PART_ROWS, FREQUENT_KEYS = 100, 8, 20_000, 100_000
#: Requests that go with one copy of a text.
ASKED = 64
#: Rows of a key that are compared in one cell, and rows in a block there, for pairs that keys do not propose.
CELL, BLOCK = 2048, 128
CANDIDATE = "kind int, a long, b long, x long, y long"
PASSAGE = "a long, b long, a_from long, a_to long, b_from long, b_to long"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sliding(values: np.ndarray, size: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) over every stretch of ``size`` values, by doubling."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def compact_windows(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cartesian-tree nodes (l, c, r) whose stretch has at least ``size`` values; ties go to the left.

    Only values that are least in some stretch of ``size`` can have such a node, and so can only they bound
    one, hence nearest smaller values are sought among those alone, by pointer jumping.
    """
    n = len(values)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none
    low = sliding(values, size, np.minimum)
    pad = np.zeros(size - 1, values.dtype)
    opened = sliding(np.concatenate([pad, low, pad]), size, np.maximum)
    at = np.flatnonzero(values == opened)
    v = values[at]
    every = np.arange(len(at))
    before, move = every - 1, every  # those that still have to move on
    while len(move := move[(before[move] >= 0) & (v[before[move]] > v[move])]):
        before[move] = before[before[move]]
    after, move, w = np.append(every + 1, len(at)), every, np.append(v, 0)
    while len(move := move[(after[move] < len(at)) & (w[after[move]] >= v[move])]):
        after[move] = after[after[move]]
    after = after[:-1]
    left = np.where(before >= 0, at[before] + 1, 0)
    right = np.where(after < len(at), at[np.minimum(after, len(at) - 1)] - 1, n - 1)
    keep = right - left + 1 >= size
    return left[keep], at[keep], right[keep]


def banded_windows(shingles: list[np.ndarray], size: int = SPAN) -> tuple[np.ndarray, ...]:
    """(text, key, from, to) of the intersected compact windows of every text, all texts in one pass.

    The texts' hashes stand in a row with a zero between; no hash is zero, so no window crosses one.
    """
    lengths = np.array([len(s) for s in shingles], np.int64)
    starts = np.cumsum(lengths + 1) - lengths
    whole = np.zeros(int((lengths + 1).sum()) + 1, np.uint64)
    real = np.zeros(len(whole), bool)
    for s, at in zip(shingles, starts.tolist(), strict=True):
        whole[at : at + len(s)] = s
        real[at : at + len(s)] = True
    out = []
    for band in range(BANDS):
        found = []
        for h in (2 * band, 2 * band + 1):
            values = (mix64(whole + np.uint64(0x9E3779B97F4A7C15 * (h + 1) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            values[~real] = 0
            left, at, right = compact_windows(values, size)
            keep = real[at]
            left, at, right = left[keep], at[keep], right[keep]
            # stretches of exactly ``size`` values that this window's shingle is the least of begin here
            begin = np.maximum(left, at - size + 1)
            order = np.argsort(begin, kind="stable")
            found.append((begin[order], left[order], at[order], right[order]))
        (b1, l1, c1, r1), (b2, l2, c2, r2) = found
        if not len(b1):
            continue
        begin = np.union1d(b1, b2)
        i, j = np.searchsorted(b1, begin, "right") - 1, np.searchsorted(b2, begin, "right") - 1
        ok = (i >= 0) & (j >= 0)
        begin, i, j = begin[ok], i[ok], j[ok]
        # all stretches of ``size`` in the intersection that hold both shingles
        first, last = np.minimum(c1[i], c2[j]), np.maximum(c1[i], c2[j])
        lo, hi = np.maximum(np.maximum(l1[i], l2[j]), last - size + 1), np.minimum(np.minimum(r1[i], r2[j]), first + size - 1)
        key = mix64(mix64(whole[c1[i]] + np.uint64(band + 1)) + whole[c2[j]])
        text = np.searchsorted(starts, begin, "right") - 1
        out.append((text, key.view(np.int64), lo - starts[text], hi - starts[text]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def merged_windows(text: np.ndarray, key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """The windows with those of one text and key that overlap, one after the other, as one."""
    if not len(key):
        return text, key, lo, hi
    order = np.lexsort((lo, text, key))
    text, key, lo, hi = text[order], key[order], lo[order], hi[order]
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1]) | (lo[1:] > hi[:-1])]))
    return text[begin], key[begin], lo[begin], np.maximum.reduceat(hi, begin)


def window_rows(docs: DataFrame) -> DataFrame:
    """key, doc, span (from << 32 | to, in shingles) of every window of (doc_id, text) rows. Windows of one key that
    overlap in a document, as where words repeat, are one row."""

    def run(batches):
        for b in pieces(batches, 256):
            ids = b.column(0).to_numpy()
            shingles = text_shingles(b.column(1), WIDTH)
            text, key, lo, hi = merged_windows(*banded_windows([s if len(s) >= SPAN else s[:0] for s in shingles]))
            for at in range(0, len(key), 20_000):
                part = slice(at, at + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(key[part]), pa.array(ids[text[part]]), pa.array((lo[part] << 32) | hi[part])], names=["key", "doc", "span"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc long, span long")


def frequent_keys(docs: DataFrame) -> DataFrame:
    """key, parts: keys that many documents hold, and into how many parts their rows go.

    They are counted in a hundredth of the documents (by hash of the id). The level rises with the rows, so at most
    ``FREQUENT_KEYS`` keys are listed, whatever the input's size. They decide where rows go, not what is found.
    """
    rows = window_rows(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0))
    counts, _ = compact(rows.groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {FREQUENT}"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(FREQUENT, -(-total // FREQUENT_KEYS))).select("key", F.ceil(F.col("n") * SAMPLE / PART_ROWS).cast("int").alias("parts"))


PAIR, MEMBER, EDGE = 0, 1, 2


def candidates(docs: DataFrame, at: str) -> DataFrame:
    """What the keys propose, as rows (kind, a, b, x, y); a table below the folder ``at``.

    ``PAIR``: documents a < b with the stretches of both that share a key. ``MEMBER``: key, document and stretch of
    keys with more than ``SMALL`` rows, whose pairs are not all proposed. ``EDGE``: key, document and stretch of the
    first row of each part of a frequent key.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = window_rows(docs).join(F.broadcast(frequent_keys(docs)), "key", "left")  # at most FREQUENT_KEYS rows
    rows = rows.select("key", F.when(F.col("parts").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc"), "parts")).cast("long").alias("part"), "doc", "span")

    def out(kind: int, *cols) -> pa.RecordBatch:
        cols = [np.ascontiguousarray(c) for c in cols]
        cols += [np.zeros(len(cols[0]), np.int64)] * (4 - len(cols))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *map(pa.array, cols)], names=["kind", "a", "b", "x", "y"])

    def run(batches):
        tail = np.zeros((0, 4), np.int64)  # key, part, doc, span of the last rows
        place_before, pivot = 0, np.zeros(2, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            new = np.stack([b.column(i).to_numpy() for i in range(4)], axis=1)
            old = len(tail)
            every = np.concatenate([tail, new])
            index = np.arange(len(new))
            head = np.concatenate([[old == 0 or bool((new[0, :2] != tail[-1, :2]).any())], (new[1:, :2] != new[:-1, :2]).any(axis=1)])
            begin = np.maximum.accumulate(np.where(head, index, -1))
            place = np.where(begin >= 0, index - begin, index + place_before)
            first = np.where((begin >= 0)[:, None], new[np.maximum(begin, 0), 2:], pivot)
            left, right = [first[place > 0]], [new[place > 0, 2:]]
            for lag in range(1, SMALL):
                at = index[(place > lag) & ((place < SMALL) | (lag == 1))]
                left.append(every[at + old - lag, 2:])
                right.append(new[at, 2:])
            split = new[:, 1] >= 0
            whole = [new[split | (place >= SMALL)]]
            full = index[(place == SMALL) & ~split]  # the key has more than SMALL rows: the first ones are members too
            whole += [every[full + old - lag] for lag in range(1, SMALL + 1)]
            place_before, pivot, tail = int(place[-1]) + 1, first[-1], every[-SMALL:]
            x, y = np.concatenate(left), np.concatenate(right)
            swap = x[:, 0] > y[:, 0]
            x[swap], y[swap] = y[swap].copy(), x[swap].copy()
            keep = x[:, 0] < y[:, 0]
            yield out(PAIR, x[keep, 0], y[keep, 0], x[keep, 1], y[keep, 1])
            members = np.concatenate(whole)
            yield out(MEMBER, members[:, 0], members[:, 2], members[:, 3])
            yield out(EDGE, *new[split & head][:, [0, 2, 3]].T)
        trim()

    dealt = rows.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "doc", "span")
    dealt.mapInArrow(run, CANDIDATE).write.parquet(f"{at}/candidates")
    return spark.read.schema(CANDIDATE).parquet(f"{at}/candidates")


def joined_parts(found: DataFrame) -> DataFrame:
    """Pairs (a, b, x, y) of the first rows of a key's parts with the first of them all."""
    ends = found.where(F.col("kind") == EDGE).select(F.col("a").alias("key"), F.struct(F.col("b").alias("doc"), F.col("x").alias("span")).alias("end"))
    least = ends.groupBy("key").agg(F.min("end").alias("low"), F.count("*").alias("n")).where("n > 1")
    return least.join(ends, "key").where("low.doc < end.doc").select(F.col("low.doc").alias("a"), F.col("end.doc").alias("b"), F.col("low.span").alias("x"), F.col("end.span").alias("y"))


def merged_intervals(pairs: DataFrame) -> DataFrame:
    """One row per pair of documents and stretch: keys whose stretches overlap in both documents are joined.

    A pair has at most as many rows as its documents have windows, so a group is bounded by a document's length.
    """

    def run(batches):
        for batch in pieces(batches, 128):
            out = []
            for a, b, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                open_: list[list[int]] = []
                for s in sorted(((s["y"], s["x"]) for s in spans)):
                    y0, y1, x0, x1 = s[0] >> 32, s[0] & 0xFFFFFFFF, s[1] >> 32, s[1] & 0xFFFFFFFF
                    for o in open_:
                        if y0 <= o[3] and x0 <= o[1] and o[0] <= x1:
                            o[0], o[1], o[3] = min(o[0], x0), max(o[1], x1), max(o[3], y1)
                            break
                    else:
                        open_.append([x0, x1, y0, y1])
                out += [(a, b, *o) for o in open_]
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "x0", "x1", "y0", "y1"])
        trim()

    grouped = pairs.groupBy("a", "b").agg(F.collect_set(F.struct("x", "y")).alias("spans"))
    return grouped.mapInArrow(run, "a long, b long, x0 long, x1 long, y0 long, y1 long")


def similar_stretches(x: np.ndarray, y: np.ndarray, percent: int, size: int = SPAN) -> list[tuple[int, int, int, int]]:
    """Stretches (x from, x to, y from, y to; ends included) made of ``size`` shingles and more, near-equal window by window."""
    order = np.argsort(x, kind="stable")
    sorted_x = x[order]
    at = np.searchsorted(sorted_x, y)
    hit = (at < len(x)) & (sorted_x[np.minimum(at, len(x) - 1)] == y)
    if len(y) < size or len(x) < size:
        return []
    total = np.concatenate([[0], np.cumsum(hit)])
    starts = np.flatnonzero(total[size:] - total[:-size] >= least_common(percent, size))
    if not len(starts):
        return []
    out: list[list[int]] = []
    place = order[np.minimum(at, len(x) - 1)]
    shift = np.where(hit, place - np.arange(len(y)), 0)
    shifts = np.unique(shift[hit])
    again = np.argsort(y, kind="stable")
    twice = y[again[1:]] == y[again[:-1]]
    if twice.any():
        # of a stretch's distinct shingles, at least ``percent`` must be in x at all
        before = np.full(len(y), -1)
        before[again[1:][twice]] = again[:-1][twice]
        views = np.lib.stride_tricks.sliding_window_view(before, size)[starts] < starts[:, None]
        held = views & np.lib.stride_tricks.sliding_window_view(hit, size)[starts]
        ok = 100 * held.sum(axis=1) >= percent * views.sum(axis=1)
        # stretches of the same shingles as an earlier one are like it: the first of each such set is tried
        sums = np.where(views, np.lib.stride_tricks.sliding_window_view(mix64(y), size)[starts], np.uint64(0)).sum(axis=1)
        _, sets = np.unique(sums, return_inverse=True)
        starts, sets = starts[ok], sets[ok].tolist()
        # stretches that x has just so, and where
        weights = np.cumprod(np.full(size, 0x9E3779B97F4A7C15, np.uint64))
        of_x, of_y = ((np.lib.stride_tricks.sliding_window_view(mix64(z), size) * weights).sum(axis=1) for z in (x, y))
        by_sum = np.argsort(of_x, kind="stable")
        near = by_sum[np.minimum(np.searchsorted(of_x[by_sum], of_y), len(of_x) - 1)]
        just = np.where(of_x[near] == of_y, near, -1)
    else:
        sets = just = None
    equal = sorted_x[1:] == sorted_x[:-1]
    lone = None
    if equal.any():
        single = np.ones(len(x), bool)
        single[1:][equal] = single[:-1][equal] = False
        lone = hit & single[np.minimum(at, len(x) - 1)]
    # where nothing repeats: at each shift, a start's common shingles are those whose place in x is in the window
    exact = sets is None and lone is None and 1 < len(shifts) <= 16

    def possible(starts: np.ndarray) -> np.ndarray:
        views = np.lib.stride_tricks.sliding_window_view(np.where(hit, place, -len(x) - size), size)[starts]
        begins = np.clip(starts[None, :] + shifts[:, None], 0, len(x) - size)
        best = np.max([((views >= b[:, None]) & (views < b[:, None] + size)).sum(axis=1) for b in begins], axis=0)
        return starts[best >= least_common(percent, size)]

    failed = set()
    todo, k = starts.tolist(), -1
    while k + 1 < len(todo):
        k += 1
        s = todo[k]
        x0 = -1 if just is None else int(just[s])
        if (out and s + size - 1 <= out[-1][3]) or (sets and x0 < 0 and sets[k] in failed):
            continue
        similar, q = x0 >= 0, np.unique(y[s : s + size])
        # the commonest shift, of equals the largest: where words repeat, that is the one of the stretch's first
        # shingles; before it the one of shingles that x has once
        for which in (hit,) if lone is None else (lone, hit):
            own = shift[s : s + size][which[s : s + size]]
            if similar or not len(own):
                continue
            d = int(own.max() - np.bincount(own.max() - own).argmax())
            x0 = min(max(0, s + d), len(x) - size)
            p = np.unique(x[x0 : x0 + size])
            both = len(np.intersect1d(p, q, assume_unique=True))
            similar = 100 * both >= percent * (len(p) + len(q) - both)
        if not similar:
            if sets:
                failed.add(sets[k])
            elif exact and k + 1 < len(todo):
                todo, k, exact = possible(starts[k + 1 :]).tolist(), -1, False
            continue
        if out and s <= out[-1][3] + 1:
            out[-1][0], out[-1][1], out[-1][3] = min(out[-1][0], x0), max(out[-1][1], x0 + size - 1), s + size - 1
        else:
            # the stretch goes on for as long as shingles keep matching on the same diagonal
            out.append([x0, x0 + size - 1, s, s + size - 1])
        o = out[-1]
        m = min(len(y) - o[3], len(x) - o[1]) - 1
        same = y[o[3] + 1 : o[3] + 1 + m] == x[o[1] + 1 : o[1] + 1 + m]
        m = m if same.all() else int(same.argmin())
        o[1], o[3] = o[1] + m, o[3] + m
    return [tuple(o) for o in out]


def least_common(percent: int, size: int = SPAN) -> int:
    """Shingles that two stretches of ``size`` share at least at that similarity."""
    return -(-2 * size * percent // (100 + percent))


def asked_of(docs: DataFrame, asked: DataFrame, side: str, other: str) -> DataFrame:
    """side, text, asked (array of structs): each text with what is asked of it, ``ASKED`` requests to a row or so.

    A document of which much is asked is so many rows; its text is not repeated for each request.
    """
    n = asked.groupBy(F.col(side).alias("n_of_")).agg(F.ceil(F.count("*") / ASKED).alias("lanes_"))
    lanes = asked.join(n, F.col(side) == F.col("n_of_")).withColumn("lane_", F.pmod(F.xxhash64(other, F.lit(3)), "lanes_"))
    lists = lanes.groupBy(side, "lane_").agg(F.collect_list(F.struct(*[c for c in asked.columns if c != side])).alias("asked"))
    return docs.select(F.col("doc_id").alias(side), "text").join(lists, side).select(side, "text", "asked")


def slices(batches, wanted: list[str], first: str, last: str):
    """For each text with what is asked of it: its id, the columns of the requests, and the shingles from ``first`` to ``last`` of each."""
    for b in pieces(batches, 64):
        lists = b.column(2)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).tolist()
        rows = lists.flatten()
        cols = {c: rows.field(c) for c in wanted}
        lo, hi = rows.field(first).to_pylist(), rows.field(last).to_pylist()
        for i, (d, shingles) in enumerate(zip(b.column(0).to_pylist(), text_shingles(b.column(1), WIDTH), strict=True)):
            p, q = ends[i], ends[i + 1]
            for at in range(p, q, 32):
                to = min(q, at + 32)
                yield d, {c: v.slice(at, to - at) for c, v in cols.items()}, [shingles[lo[k] : hi[k] + 1] for k in range(at, to)]
    trim()


def verified(docs: DataFrame, pairs: DataFrame, percent: int, at: str) -> DataFrame:
    """Passages (a < b, and the first and last word in both) of the candidate pairs (a, b, x, y). Written as a table below ``at``."""
    spark = docs.sparkSession
    with small_batches(spark, 1024):
        requests, _ = compact(merged_intervals(pairs))
    ask = ["b", "x0", "x1", "y0", "y1"]

    def cut(batches):
        for d, cols, found in slices(batches, ask, "x0", "x1"):
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(found), pa.int64()), *[cols[c] for c in ask], binary_array([s.tobytes() for s in found])], names=["a", *ask, "sx"])

    def check(batches):
        rows: list[tuple] = []

        def flush():
            cols = list(zip(*rows, strict=True)) or [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "a_from", "a_to", "b_from", "b_to"])

        for b, cols, found in slices(batches, ["a", "x0", "y0", "sx"], "y0", "y1"):
            for a, x0, y0, sx, sy in zip(*[cols[c].to_pylist() for c in ("a", "x0", "y0", "sx")], found, strict=True):
                rows += [(a, b, x0 + p, x0 + q + WIDTH - 1, y0 + r, y0 + s + WIDTH - 1) for p, q, r, s in similar_stretches(np.frombuffer(sx, np.uint64), sy, percent)]
            if len(rows) > 10_000:
                yield flush()
        yield flush()

    # requests grow with the corpus, so both joins deal by document; slices of a are sent on to b, not whole texts
    with small_batches(spark, 64):
        with_a = asked_of(docs, requests, "a", "b").mapInArrow(cut, "a long, b long, x0 long, x1 long, y0 long, y1 long, sx binary")
        asked_of(docs, with_a.drop("x1"), "b", "a").mapInArrow(check, PASSAGE).write.parquet(f"{at}/passages")
    return spark.read.schema(PASSAGE).parquet(f"{at}/passages")


def open_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of keys of which pairs still matter: key, doc, span, root, open, out, and the cells they go to.

    Pairs matter where the documents are in two components, or where the stretch of the larger document holds no
    passage yet that a smaller document holds (``open``). So only rows outside the key's main component and open ones
    (``out``) have to meet all others, and a passage that all its documents are known to share costs nothing. A key's
    rows are dealt to cells of ``CELL`` outer rows by ``CELL`` rows.
    """
    lo, hi = F.shiftright("span", 32), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF))
    roots = components(found.select("a", "b")).select(F.col("node").alias("doc"), "root")
    known = repeated_spans(found).select(F.col("doc_id").alias("doc"), "spans")
    held = F.exists("spans", lambda s: F.least(s["hi"] - (WIDTH - 1), hi) - F.greatest(s["lo"], lo) + 1 >= SPAN)
    rows = members.join(roots, "doc", "left").join(known, "doc", "left")
    rows = checkpoint(rows.select("key", "doc", "span", F.coalesce("root", "doc").alias("root"), (~F.coalesce(held, F.lit(False))).alias("open")))
    per_root = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.min("doc").alias("low"), F.sum(F.col("open").cast("int")).alias("o"))
    keys = per_root.groupBy("key").agg(F.sum("c").alias("held"), F.count("*").alias("roots"), F.min("low").alias("low"), F.sum("o").alias("o"), F.max(F.struct("c", "root", "o")).alias("main"))
    outs = F.col("held") - F.col("main.c") + F.col("main.o")  # the outer rows: all of other components, open ones of the main one
    keys = keys.where("roots > 1 or o > 1").select("key", F.col("main.root").alias("main"), "low", F.ceil(outs / CELL).alias("rows_"), F.ceil(F.col("held") / CELL).alias("cols_"))
    mixed = rows.join(keys, "key").withColumn("open", F.col("open") & (F.col("doc") != F.col("low"))).withColumn("out", (F.col("root") != F.col("main")) | F.col("open"))
    i, j = F.pmod(F.xxhash64("doc"), F.greatest("rows_", F.lit(1))), F.pmod(F.xxhash64("doc", F.lit(1)), "cols_")
    return mixed.select("key", "doc", lo.alias("lo"), hi.alias("hi"), "root", "open", "out", i.alias("i"), j.alias("j"), "rows_", "cols_")


def in_cells(rows: DataFrame) -> DataFrame:
    """The members once for each cell: as an outer row (``u``) of its row of cells, as any row (``v``) of its column."""
    cell = lambda i, j, u, v: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), u.alias("u"), v.alias("v"))
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest("rows_", F.lit(1)) - 1), lambda c: cell(c, F.col("j"), F.col("out") & (c == F.col("i")), F.lit(True)))
    more = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), F.col("cols_") - 1), lambda c: F.col("out") & (c != F.col("j"))), lambda c: cell(F.col("i"), c, F.lit(True), F.lit(False)))
    return rows.withColumn("c", F.explode(F.concat(own, more))).select("key", "c.i", "c.j", "doc", "lo", "root", "open", "out", "c.u", "c.v", "shingles")


class Cell:
    """Members of one cell, sorted by document: finds the passages that still matter."""

    def __init__(self, rows: list[tuple], percent: int):
        doc, lo, root, opened, out, u, v, self.shingles = zip(*rows, strict=True)
        self.doc, self.lo, self.root = (np.array(c, np.int64) for c in (doc, lo, root))
        self.open, self.out = np.array(opened), np.array(out)
        self.u, self.v = np.flatnonzero(u), np.flatnonzero(v)
        self.percent, self.need = percent, least_common(percent)
        self.up = {r: r for r in root}

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def matter(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which pairs of rows matter, as a matrix; of two outer rows each pair counts once."""
        dx, dy, rx, ry = self.doc[p][:, None], self.doc[q][None, :], self.root[p][:, None], self.root[q][None, :]
        opens = np.where(dx < dy, self.open[q][None, :], self.open[p][:, None])
        return (dx != dy) & ((rx != ry) | opens) & ~(self.out[q][None, :] & (dx > dy))

    def passages(self):
        """Rows (a, b, a_from, a_to, b_from, b_to) that join components or close open stretches, of all pairs that matter.

        Pairs with too few common shingles, or without a stretch of ``SPAN`` with enough of them, are never similar.
        """
        if not self.matter(self.u, self.v).any():
            return
        size = np.array([len(s) for s in self.shingles])
        _, ids = np.unique(np.concatenate(self.shingles), return_inverse=True)
        ends = np.cumsum(size)
        parts = [ids[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
        row = np.repeat(np.arange(len(size)), size)
        twice = size - np.bincount(np.unique(row * (int(ids.max()) + 1) + ids) // (int(ids.max()) + 1), minlength=len(size))
        local = np.full(int(ids.max()) + 1, -1, np.int64)
        order = self.v[np.argsort(size[self.v], kind="stable")]  # stretches of like lengths in one block
        for at in range(0, len(self.u), BLOCK):
            p = self.u[at : at + BLOCK]
            own = np.unique(np.concatenate([parts[k] for k in p]))
            local[own] = np.arange(len(own))
            x = np.zeros((len(p), len(own) + 1), np.float32)
            for r, k in enumerate(p):
                x[r, local[parts[k]]] = 1
            for to in range(0, len(order), BLOCK):
                q = order[to : to + BLOCK]
                wanted = self.matter(p, q)
                if not wanted.any():
                    continue
                width = int(size[q].max())
                y = np.full((len(q), width), -1, np.int64)
                for r, k in enumerate(q):
                    y[r, : size[k]] = local[parts[k]]
                z = np.zeros((len(q), len(own) + 1), np.float32)
                z[np.arange(len(q))[:, None], y] = 1
                z[:, -1] = 0  # shingles that no row of p holds
                wanted &= x @ z.T >= self.need - np.maximum(twice[p][:, None], twice[q][None, :])
                for r in np.flatnonzero(wanted.any(axis=1)):
                    hits = np.flatnonzero(wanted[r])
                    total = np.cumsum(np.pad(x[r][y[hits]], ((0, 0), (1, 0))), axis=1)
                    hits = hits[(total[:, SPAN:] - total[:, :-SPAN] >= self.need - twice[p[r]]).any(axis=1)]
                    for k in q[hits]:
                        yield from self.checked(p[r], k)
            local[own] = -1

    def checked(self, p: int, q: int):
        a, b = (p, q) if self.doc[p] < self.doc[q] else (q, p)
        ra, rb = self.find(self.root[a]), self.find(self.root[b])
        if ra == rb and not self.open[b]:
            return
        found = similar_stretches(self.shingles[a], self.shingles[b], self.percent)
        if found:
            self.up[max(ra, rb)] = min(ra, rb)
            self.open[b] = False
        for x0, x1, y0, y1 in found:
            yield (int(self.doc[a]), int(self.doc[b]), int(self.lo[a] + x0), int(self.lo[a] + x1 + WIDTH - 1), int(self.lo[b] + y0), int(self.lo[b] + y1 + WIDTH - 1))


def open_passages(docs: DataFrame, members: DataFrame, found: DataFrame, percent: int, at: str) -> DataFrame:
    """Passages of pairs that share a key and were not proposed, as far as they still matter (``open_members``)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = ["key", "lo", "root", "open", "out", "i", "j", "rows_", "cols_"]
    rows = open_members(members, found)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def cut(batches):
        for d, cols, own in slices(batches, kept, "lo", "hi"):
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(own), pa.int64()), *[cols[c] for c in kept], binary_array([s.tobytes() for s in own])], names=["doc", *kept, "shingles"])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 6
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "a_from", "a_to", "b_from", "b_to"])

    def compare(batches):
        group, held, out = None, [], []
        for b in batches:
            *names, shingles = b.columns
            for row in zip(*[c.to_pylist() for c in names], shingles.to_pylist(), strict=True):
                if row[:3] != group:
                    if held:
                        out += Cell(held, percent).passages()
                    group, held = row[:3], []
                held.append((*row[3:-1], np.frombuffer(row[-1], np.uint64)))
            if len(out) > 10_000:
                yield batch_of(out)
        if held:
            out += Cell(held, percent).passages()
        yield batch_of(out)
        trim()

    with small_batches(spark, 64):
        with_shingles = asked_of(docs, rows, "doc", "key").mapInArrow(cut, ", ".join(["doc long", *[f"{c} {kinds[c]}" for c in kept], "shingles binary"]))
        dealt = in_cells(with_shingles).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "doc", "lo")
    with small_batches(spark, 1024):
        dealt.mapInArrow(compare, PASSAGE).write.parquet(f"{at}/open-passages")
    return spark.read.schema(PASSAGE).parquet(f"{at}/open-passages")


def passages(docs: DataFrame, percent: int, at: str) -> DataFrame:
    """Near-duplicate passages of distinct texts: a < b, and for both the first and last word of the stretch.

    They are read from tables in the folder ``at``, which the caller deletes when it has what it needs.
    """
    proposed = candidates(docs, at)
    pairs = proposed.where(F.col("kind") == PAIR).select("a", "b", "x", "y")
    found = verified(docs, pairs.union(joined_parts(proposed)), percent, at)
    members = proposed.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("doc"), F.col("x").alias("span"))
    return found.union(open_passages(docs, members, found, percent, at))


def first_of_texts(docs: DataFrame) -> DataFrame:
    """doc_id, first_id: the least id with the same text, for ids that are not that one. Summed by the text's hashes."""
    hashed = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h1"), F.hash("text").alias("h2"), F.crc32(F.col("text").cast("binary")).alias("h3"))
    first = hashed.groupBy("h1", "h2", "h3").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    return checkpoint(hashed.join(first, ["h1", "h2", "h3"]).where("doc_id <> first_id").select("doc_id", "first_id").distinct())


def distinct_texts(docs: DataFrame, copies: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null").join(maybe_broadcast(copies.select("doc_id"), copies.count()), "doc_id", "left_anti")


def merge_spans(spans: list) -> list[tuple[int, int]]:
    """Union of stretches of words, ends included."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


def repeated_spans(found: DataFrame) -> DataFrame:
    """doc_id, spans (array of lo, hi): the passages that a document of smaller id holds too."""
    return found.groupBy(F.col("b").alias("doc_id")).agg(F.collect_set(F.struct(F.col("b_from").alias("lo"), F.col("b_to").alias("hi"))).alias("spans"))


def passage_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_words, component_id (least id reachable over shared passages and equal texts of at least 50 words),
    n_linked (other rows of that component), n_passages and n_repeated_words (held by a document of smaller id; for a
    copy of a text its whole text, if that has at least 50 words)."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    copies, at = first_of_texts(docs), shared_path(df.sparkSession, "windows")
    found = passages(distinct_texts(docs, copies), percent, at)
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    counted = docs.select("doc_id", n_words.alias("n_words"))
    roots = components(found.select("a", "b"))
    # merged lengths of spans that may overlap, without leaving the JVM
    sorted_spans = F.sort_array("spans")
    merged = F.aggregate(
        sorted_spans, F.struct(F.expr("0L").alias("words"), F.expr("0L").alias("runs"), F.expr("-2L").alias("end")),
        lambda s, x: F.struct(
            (s["words"] + F.greatest(F.expr("0L"), x["hi"] - F.greatest(x["lo"] - 1, s["end"]))).alias("words"),
            (s["runs"] + F.when(x["lo"] > s["end"] + 1, 1).otherwise(0)).alias("runs"), F.greatest(s["end"], x["hi"]).alias("end"),
        ),
    )
    repeats = repeated_spans(found).select("doc_id", merged.alias("m")).select("doc_id", F.col("m.words").alias("repeated"), F.col("m.runs").alias("passages"))
    first = copies.withColumnRenamed("first_id", "class_id")
    out = counted.join(first, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").join(repeats, "doc_id", "left")
    copy = (F.col("doc_id") != F.col("class_id")) & (F.col("n_words") >= WORDS)
    # a copy of a text under 50 words shares no passage, so it stays a class of its own
    short = F.col("n_words") < WORDS
    rows = out.select(
        "doc_id", "n_words", F.when(short, F.col("doc_id")).otherwise(F.coalesce("root", "class_id")).alias("component_id"),
        F.when(copy, 1).otherwise(F.coalesce("passages", F.lit(0))).cast("long").alias("n_passages"),
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("repeated", F.lit(0))).cast("long").alias("n_repeated_words"),
    )
    rows = checkpoint(rows)
    remove(df.sparkSession, at)
    sizes = rows.where("component_id is not null").groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(sizes, "component_id", "left").select("doc_id", "n_words", "component_id", (F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_linked"), "n_passages", "n_repeated_words")


def cut_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """All rows, with the passages that a document of smaller id holds cut out of the text.

    A passage goes with the white space behind it. Of equal texts of at least 50 words the least id keeps its text
    and the others are left empty.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    copies, place = first_of_texts(docs), shared_path(df.sparkSession, "windows")
    spans = repeated_spans(passages(distinct_texts(docs, copies), percent, place))
    whole = copies.select("doc_id", F.expr("array(struct(0L as lo, 9000000000000000000L as hi))").alias("spans"))
    cuts = checkpoint(spans.unionByName(whole)).select(F.col("doc_id").alias("cut_id_"), F.col("spans").alias("cut_spans_"))
    remove(df.sparkSession, place)
    joined = df.join(maybe_broadcast(cuts, cuts.count()), F.col(f"`{id_col}`") == F.col("cut_id_"), "left").drop("cut_id_")
    at, names = df.columns.index(text_col), df.columns

    def run(batches):
        for b in pieces(batches):
            if b.column(len(names)).null_count == b.num_rows:
                yield pa.RecordBatch.from_arrays(b.columns[: len(names)], schema=pa.schema([b.schema.field(i) for i in range(len(names))]))
                continue
            out = []
            for t, spans_ in zip(texts(b.column(at)), b.column(len(names)).to_pylist(), strict=True):
                if spans_:
                    ends = [(m.start(), m.end()) for m in WORD.finditer(t)]
                    if len(ends) >= WORDS:
                        keep, last = [], 0
                        for lo, hi in merge_spans([(s["lo"], min(s["hi"], len(ends) - 1)) for s in spans_ if s["lo"] < len(ends)]):
                            keep.append(t[last : ends[lo][0]])
                            last = ends[hi + 1][0] if hi + 1 < len(ends) else len(t)
                        t = b"".join([*keep, t[last:]])
                out.append(t.decode())
            valid = b.column(at).is_valid().to_pylist()
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array([t if ok else None for t, ok in zip(out, valid, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([b.schema.field(i) for i in range(len(names))]))

    return joined.mapInArrow(run, df.schema)


def op4_compact_windows(spark, sf_dir: str) -> DataFrame:
    """Passage class, links and repeated words of every document."""
    return passage_classes(table(spark, sf_dir, "documents"))
