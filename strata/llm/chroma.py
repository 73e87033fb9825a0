"""Chroma audio fingerprints and the recordings that they align.

A recording's spectrum is folded frame by frame into twelve pitch classes. An integral image over frames and
classes makes the sum of any rectangle four look-ups, so each of sixteen rectangle filters compares two parts of
a stretch of frames at once; its log ratio, cut into four levels in Gray code, gives two bits, and sixteen filters
one 32-bit integer per frame. Two recordings are aligned by the histogram of offsets at which they hold the same
integers, and match if at the best offset at most ``MAX_ERRORS`` of the bits of the overlap differ.

Plan: recordings of equal fingerprints are one class. Keys are some choices of the bits of two consecutive integers,
so that recordings share keys although many of their bits differ (``sub_keys``). Keys are dealt to buckets, and a
fingerprint goes once to each bucket in which it has a key. There any two recordings that share a key are
aligned and compared over their whole overlap, many pairs at a time, unless links of that bucket join them
already: they are in one component, or proven not to match. Rows of a key that very many recordings hold go in parts, and any two parts meet in
one cell. Comparisons grow with the pairs that share a key, rows with the recordings.

Cases: null or empty sound, and sound shorter than the filters, gives an empty fingerprint that matches nothing;
sound of any length is read whole; repeated ids give repeated rows; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import binary_array, checkpoint, compact, components, mix64, pieces, remove, shared_path, small_batches, table, texts, trim

RATE = 4000
FRAME, HOP = 512, 256
SPAN = 8  #: frames that a filter looks at
LEAST_OVERLAP = 12
MAX_ERRORS = 0.2
#: Keys of two consecutive integers: choices of bits, bits of each, and how many hashes stand for one that is kept.
MASKS, KEY_BITS, KEPT = 8, 44, 4
#: Occurrences of an integer above which its offsets are counted by a transform instead of one by one.
OFTEN = 64
LOW, HIGH = 110.0, 1800.0
#: Integers to one bucket of keys on average, and buckets at least.
BUCKET_ITEMS, LEAST_BUCKETS = 1_000_000, 6
#: One recording in so many is looked at to find keys that many hold, rows of such a key that meet in one cell, keys that
#: are listed at most.
SAMPLE, CELL, FREQUENT_KEYS = 16, 4096, 100_000
#: Pairs that are compared at a time, integers whose offsets are counted at a time, and entries of the table that finds them.
COMPARED, VOTED, LANE_CELLS = 1 << 16, 1 << 20, 1 << 20
FOUND = "a long, b long, offset long, overlap long, errors double"


def pitch_classes() -> np.ndarray:
    """Matrix (spectrum bins, 12): which pitch class a bin belongs to."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), np.float32)
    use = np.flatnonzero((hz >= LOW) & (hz <= HIGH))
    out[use, np.round(12 * np.log2(hz[use] / 440.0)).astype(int) % 12] = 1
    return out


def filters() -> list[tuple[int, int, int, int]]:
    """Sixteen filters (kind, first class, classes, frames): kinds are halves in time, halves in pitch, quarters
    crosswise, and centre against sides; positions walk through the classes."""
    return [(k % 4, (3 * k) % 12 if k % 4 == 0 else (5 * k) % 8, 4, SPAN if k % 2 == 0 else SPAN // 2 + 2) for k in range(16)]


def chroma(pcm: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Frames by twelve, each frame scaled to a sum of one."""
    if len(pcm) < FRAME:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(pcm.astype(np.float32), FRAME)[::HOP]
    power = np.abs(np.fft.rfft(frames * np.hanning(FRAME).astype(np.float32), axis=1)).astype(np.float32) ** 2
    c = power @ classes
    return (c + 1e-3) / (c.sum(axis=1, keepdims=True) + 12e-3)


def fingerprint(pcm: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer per frame that has ``SPAN`` frames ahead."""
    c = chroma(pcm, classes)
    n = len(c) - SPAN + 1
    if n < 1:
        return np.zeros(0, np.uint32)
    c = np.concatenate([c, c[:, :4]], axis=1)  # classes go round
    area = np.zeros((len(c) + 1, c.shape[1] + 1))
    np.cumsum(np.cumsum(c, axis=0), axis=1, out=area[1:, 1:])
    t = np.arange(n)

    def box(t0, t1, p0, p1):
        return area[t + t1, p1] - area[t + t0, p1] - area[t + t1, p0] + area[t + t0, p0]

    out = np.zeros(n, np.uint32)
    for k, (kind, p, height, width) in enumerate(filters()):
        half, mid = width // 2, p + height // 2
        if kind == 0:
            x, y = box(0, half, p, p + height), box(half, width, p, p + height)
        elif kind == 1:
            x, y = box(0, width, p, mid), box(0, width, mid, p + height)
        elif kind == 2:
            x, y = box(0, half, p, mid) + box(half, width, mid, p + height), box(half, width, p, mid) + box(0, half, mid, p + height)
        else:
            y = box(width // 3, width - width // 3, p, p + height)
            x = box(0, width, p, p + height) - y
        level = np.searchsorted([-0.8, 0.0, 0.8], np.log((x + 1e-2) / (y + 1e-2)))
        out |= (level ^ level >> 1).astype(np.uint32) << np.uint32(2 * k)
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, float]:
    """Best offset (of b's frames against a's) by histogram, frames of overlap there, share of bits that differ."""
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    once = np.flatnonzero(hi > lo)
    if not len(once):
        return 0, 0, 1.0
    n = hi[once] - lo[once]
    votes = np.zeros(len(a) + len(b) - 1, np.int64)  # by offset, from 1 - len(b) on
    often = n > OFTEN
    for value in np.unique(b[once[often]]):  # sound that holds for long: its places are correlated by transform
        size = 1 << (len(votes) - 1).bit_length()
        x, y = np.fft.rfft(a == value, size), np.fft.rfft((b == value)[::-1], size)
        votes += np.rint(np.fft.irfft(x * y, size)[: len(votes)]).astype(np.int64)
    once, n, begin = once[~often], n[~often], lo[once[~often]]
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    votes += np.bincount(order[at] - np.repeat(once, n) + len(b) - 1, minlength=len(votes))
    best = int(votes.argmax()) - (len(b) - 1)
    x, y = a[max(0, best) :], b[max(0, -best) :]
    m = min(len(x), len(y))
    wrong = int(np.bitwise_count(x[:m] ^ y[:m]).sum())
    return best, m, wrong / (32 * m)


def key_masks() -> np.ndarray:
    """``MASKS`` choices of ``KEY_BITS`` of the 64 bits of two consecutive integers."""
    rng = np.random.default_rng(5)
    return np.array([sum(1 << int(i) for i in rng.permutation(64)[:KEY_BITS]) for _ in range(MASKS)], np.uint64)


def sub_keys(items: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Distinct keys of a fingerprint: of each pair of integers some choices of its bits, each hashed, one hash in ``KEPT`` kept.

    Which hashes are kept depends on them alone, so two recordings keep the same ones. A pair with a share e of wrong bits has a
    key in common with a chance of (1 - e) ** KEY_BITS for each choice, and a recording has hundreds of them.
    """
    if len(items) < 2:
        return np.zeros(0, np.int64)
    pairs = items[:-1].astype(np.uint64) << np.uint64(32) | items[1:].astype(np.uint64)
    seeds = np.arange(1, len(masks) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = mix64((pairs[None, :] & masks[:, None]) + seeds[:, None])
    kept = np.unique(h[h % np.uint64(KEPT) == 0])
    return (kept if len(kept) else np.unique(h.min(axis=1))).view(np.int64)


def fingerprints(df: DataFrame, id_col: str = "id", pcm_col: str = "pcm") -> DataFrame:
    """id, items (binary: little-endian unsigned 32-bit) of signed 16-bit mono sound at ``RATE``."""

    def run(batches):
        classes = pitch_classes()
        for b in pieces(batches, 128):
            out = [fingerprint(np.frombuffer(x[: len(x) // 2 * 2], "<i2"), classes).astype("<u4").tobytes() if x else b"" for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), binary_array(out)], names=["id", "items"])

    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{pcm_col}`").alias("pcm")).mapInArrow(run, "id long, items binary")


def frequent_keys(prints: DataFrame, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that many recordings hold, and into how many parts (two at least) their rows go.

    They are counted in one recording of ``SAMPLE`` (by hash of the id). The level rises with the rows, so at most
    ``FREQUENT_KEYS`` keys are listed, whatever the input's size. They decide where rows go, not what is found.
    """

    def keys(batches):
        for b in pieces(batches, 1024):
            found = [sub_keys(np.frombuffer(x, "<u4"), masks) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], names=["key"])

    least = CELL // SAMPLE
    rows = prints.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select("items").mapInArrow(keys, "key long")
    counts, _ = compact(rows.groupBy("key").agg(F.count("*").alias("n")).where(f"n >= {least}"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.where(F.col("n") >= max(least, -(-total // FREQUENT_KEYS))).orderBy("key").collect()
    return np.array([r["key"] for r in found], np.int64), np.array([max(2, -(-r["n"] * SAMPLE * 2 // CELL)) for r in found], np.int64)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``n`` of them, one range after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)


def dealt_keys(ids: np.ndarray, key: np.ndarray, row: np.ndarray, frequent: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the rows (``row``: of ``ids``) of keys meet under: index of the row, and hash of key and cell. Rows of a frequent
    key are in one of its parts, and any two parts meet in one cell; a row goes to all cells of its part."""
    index, met = np.arange(len(key)), mix64(key.view(np.uint64))
    if not len(frequent):
        return index, met
    at = np.minimum(np.searchsorted(frequent, key), len(frequent) - 1)
    often = np.flatnonzero(frequent[at] == key)
    n = parts[at[often]]
    own = (mix64(ids[row[often]].view(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
    other = np.arange((n - 1).sum()) - np.repeat(np.cumsum(n - 1) - (n - 1), n - 1)
    own, often, n = np.repeat(own, n - 1), np.repeat(often, n - 1), np.repeat(n, n - 1)
    other += other >= own
    cell = np.minimum(own, other) * n + np.maximum(own, other) + 1
    rare = np.flatnonzero(frequent[at] != key)
    return np.concatenate([rare, often]), np.concatenate([met[rare], mix64(met[often] + cell.astype(np.uint64))])


class Bucket:
    """Recordings (ids in ascending order, items one after the other, how many each has) and keys (with their recording, in order of these)."""

    def __init__(self, ids: np.ndarray, flat: np.ndarray, size: np.ndarray, row: np.ndarray, key: np.ndarray):
        self.ids, self.size, self.start = ids, size, np.cumsum(size) - size
        self.flat = np.append(flat, np.uint32(0))
        self.two = self.flat[:-1].astype(np.uint64) | self.flat[1:].astype(np.uint64) << np.uint64(32)
        values, value = np.unique(flat, return_inverse=True)
        self.value, self.values = value.astype(np.int32), max(1, len(values))
        self.lanes = int(np.clip(LANE_CELLS // self.values, 1, 64))
        self.found = np.full(self.lanes * self.values, -1, np.int32)
        order = np.argsort(key, kind="stable")
        self.row = row[order]
        head = np.flatnonzero(np.diff(key[order].astype(np.int64), prepend=-1))
        end = np.repeat(np.append(head[1:], len(order)), np.diff(np.append(head, len(order))))
        more = np.flatnonzero(end - np.arange(len(order)) > 1)  # others of that key come behind
        of = np.argsort(self.row[more], kind="stable")
        self.owner, self.at, self.end = self.row[more[of]], more[of] + 1, end[more[of]]
        self.root = np.arange(len(ids))

    def links(self):
        """a < b, offset, overlap, errors of recordings that share a key and match; of those that others join already, none."""
        held, waiting, done = [], 0, 0
        while done < len(self.owner):
            low = int(self.owner[done])
            to = int(np.searchsorted(self.owner, low + self.lanes))
            n = self.end[done:to] - self.at[done:to]
            pairs = np.sort(np.repeat(self.owner[done:to] - low, n) * len(self.ids) + self.row[ranges(self.at[done:to], n)])
            pairs = pairs[np.diff(pairs, prepend=-1) > 0]
            lane, others = pairs // len(self.ids), pairs % len(self.ids)
            apart = self.root[others] != self.root[lane + low]
            lane, others, done = lane[apart], others[apart], to
            mine = self.slots(low, min(low + self.lanes, len(self.ids)))
            total, at = np.cumsum(self.size[others]), 0
            while at < len(others):  # as many as hold ``VOTED`` integers, one at least
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + VOTED)))
                held.append(self.best_offsets(low, lane[at:end], others[at:end], *mine[1:]))
                waiting, at = waiting + len(held[-1][0]), end
                if waiting >= COMPARED:
                    yield from self.compared(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, waiting = [], 0
            self.found[mine[0]] = -1
        if held:
            yield from self.compared(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def slots(self, low: int, high: int) -> tuple[np.ndarray, ...]:
        """Marks the distinct integers of recordings low to high in ``found``: where, and of each its places, as first and number."""
        size = self.size[low:high]
        whole = slice(int(self.start[low]), int(self.start[high - 1] + size[-1]))
        code = np.repeat(np.arange(high - low), size) * self.values + self.value[whole]
        order = np.argsort(code, kind="stable")
        place = np.arange(len(code)) - np.repeat(self.start[low:high] - self.start[low], size)
        head = np.flatnonzero(np.diff(code[order], prepend=-1))
        self.found[code[order[head]]] = np.arange(len(head))
        return code[order[head]], place[order], head, np.diff(np.append(head, len(code)))

    def best_offsets(self, low: int, lane: np.ndarray, others: np.ndarray, place: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of recordings (low + lane, other) those that hold an integer in common, and their offset as ``align`` finds it."""
        size = self.size[others]
        at = np.arange(int(size.sum()), dtype=np.int32)
        ends = np.cumsum(size)
        met = self.value[at + np.repeat((self.start[others] - (ends - size)).astype(np.int32), size)]
        met = self.found[met + np.repeat((lane * self.values).astype(np.int32), size)]
        hit = np.flatnonzero(met >= 0)
        which, met = np.searchsorted(ends, hit, "right"), met[hit]
        hit -= (ends - size)[which]
        often = n[met] > OFTEN
        steady = np.unique(which[often])
        if len(steady):
            once = ~np.isin(which, steady)
            which, met, hit = which[once], met[once], hit[once]
        votes = n[met]
        if len(votes) and votes.max() > 1:
            place, which, hit = place[ranges(first[met], votes)], np.repeat(which, votes), np.repeat(hit, votes)
        else:
            place = place[first[met]]
        widest = int(size.max())
        wide = widest + int(self.size[low : low + self.lanes].max())
        codes = np.sort(which * wide + (place - hit + widest))
        begin = np.flatnonzero(np.diff(codes, prepend=-1))
        votes, codes = np.diff(np.append(begin, len(codes))), codes[begin]
        k, offset = codes // wide, codes % wide - widest
        head = np.flatnonzero(np.diff(k, prepend=-1))
        if len(head):
            best = np.flatnonzero(votes == np.repeat(np.maximum.reduceat(votes, head), np.diff(np.append(head, len(k)))))
            best = best[np.diff(k[best], prepend=-1) > 0]  # the least of equal ones
            k, offset = k[best], offset[best]
        for i in steady.tolist():
            k, offset = np.append(k, i), np.append(offset, align(self.items(low + lane[i]), self.items(others[i]))[0])
        return low + lane[k], others[k], offset

    def items(self, a: int) -> np.ndarray:
        return self.flat[self.start[a] : self.start[a] + self.size[a]]

    def compared(self, a: np.ndarray, b: np.ndarray, offset: np.ndarray):
        """Compares recordings a and b at these offsets."""
        x, y = np.maximum(offset, 0), np.maximum(-offset, 0)
        overlap = np.minimum(self.size[a] - x, self.size[b] - y)
        wanted = (overlap >= LEAST_OVERLAP) & (self.root[a] != self.root[b])
        a, b, offset, x, y, overlap = (v[wanted] for v in (a, b, offset, x, y, overlap))
        errors = self.wrong_bits(self.start[a] + x, self.start[b] + y, overlap) / (32 * overlap)
        for k in np.flatnonzero(errors <= MAX_ERRORS).tolist():
            yield from self.joined(int(a[k]), int(b[k]), int(offset[k]), int(overlap[k]), float(errors[k]))

    def joined(self, i: int, j: int, offset: int, overlap: int, errors: float):
        low, high = sorted((int(self.root[i]), int(self.root[j])))
        if low != high:
            self.root[self.root == high] = low
            yield int(self.ids[i]), int(self.ids[j]), offset, overlap, errors

    def wrong_bits(self, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Bits that differ between the n integers from x on and those from y on."""
        out = np.where(n % 2 == 1, np.bitwise_count(self.flat[x + n - 1] ^ self.flat[y + n - 1]), 0).astype(np.int64)
        steps = n // 2
        order = np.argsort(steps, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(steps[order])) + 1, len(order)).tolist()
        at = 0
        for end in ends:
            if end == at:
                continue
            wide = 2 * np.arange(steps[order[at]])
            while at < end:
                k = order[at : min(end, at + max(1, (1 << 18) // max(1, len(wide))))]
                out[k] += np.bitwise_count(self.two[x[k][:, None] + wide] ^ self.two[y[k][:, None] + wide]).sum(axis=1, dtype=np.int64)
                at += len(k)
        return out


def bucket_ids(spark, n: int) -> np.ndarray:
    """Numbers that hash partitioning deals one to each of ``n`` partitions."""
    rows = spark.range(32 * n).select(F.col("id").cast("int"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    return np.array(sorted(r["id"] for r in rows), np.int32)


def matches(prints: DataFrame, at: str) -> DataFrame:
    """a < b, offset, overlap, errors of recordings (id, items) that share a key and match, as many as join what matches
    into components; read from a table in the folder ``at``."""
    spark = prints.sparkSession
    masks = key_masks()
    prints = prints.where(F.octet_length("items") >= 4 * LEAST_OVERLAP)  # shorter ones match nothing
    total = (prints.agg(F.sum(F.octet_length("items"))).first()[0] or 0) // 4
    buckets = bucket_ids(spark, max(LEAST_BUCKETS, -(-total // BUCKET_ITEMS)))
    frequent, parts = frequent_keys(prints, masks)

    def deal(batches):
        for b in pieces(batches, 256):
            ids, items = b.column(0).to_numpy(), b.column(1).to_pylist()
            found = [sub_keys(np.frombuffer(x, "<u4"), masks) for x in items]
            row = np.repeat(np.arange(len(ids)), [len(k) for k in found])
            index, met = dealt_keys(ids, np.concatenate(found), row, frequent, parts)
            bucket = (met % np.uint64(len(buckets))).astype(np.int64)
            where = bucket * len(ids) + row[index]
            order = np.argsort(where, kind="stable")
            rows, where = (met[order] >> np.uint64(32)).astype("<u4"), where[order]
            begin = np.flatnonzero(np.diff(where, prepend=-1))
            ends = np.append(begin[1:], len(where)).tolist()
            of = where[begin] % len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets[where[begin] // len(ids)]), pa.array(ids[of]), binary_array([items[k] for k in of.tolist()]), binary_array([rows[i:j].tobytes() for i, j in zip(begin.tolist(), ends, strict=True)])],
                names=["bucket", "id", "items", "keys"],
            )

    def compare(batches):
        ids, kept = [], ([], [])
        for b in batches:
            ids.append(b.column(1).to_numpy().copy())
            for c, out in zip((b.column(2), b.column(3)), kept, strict=True):
                ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
                data = np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(c) and ends[-1] > ends[0] else np.zeros(0, np.uint8)
                out.append((data.copy(), np.diff(ends).astype(np.int64)))
        if not ids:
            return
        ids, (flat, keys), (size, n) = np.concatenate(ids), *([np.concatenate([x[i] for x in out]) for out in kept] for i in range(2))
        order = np.argsort(ids, kind="stable")
        flat, keys, at, key_at = flat.view("<u4"), keys.view("<u4"), (np.cumsum(size) - size)[order] // 4, (np.cumsum(n) - n)[order] // 4
        ids, size, n = ids[order], size[order] // 4, n[order] // 4
        # two buckets may come to one task: a recording of both is one
        head = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        row = np.repeat(np.repeat(np.arange(len(head)), np.diff(np.append(head, len(ids)))), n)
        held = Bucket(ids[head], flat[ranges(at[head], size[head])], size[head], row, keys[ranges(key_at, n)])
        cols = list(zip(*held.links(), strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["a", "b", "offset", "overlap", "errors"])
        trim()

    with small_batches(spark, 1024):
        dealt = prints.select("id", "items").mapInArrow(deal, "bucket int, id long, items binary, keys binary").repartition(len(buckets), "bucket")
        dealt.mapInArrow(compare, FOUND).write.parquet(f"{at}/found")
    return spark.read.schema(FOUND).parquet(f"{at}/found")


def recording_classes(df: DataFrame, id_col: str = "id", pcm_col: str = "pcm") -> DataFrame:
    """id, n_items, component_id (least id reachable over matches and equal fingerprints), n_linked (other recordings of
    that component), fingerprint (checksum)."""
    spark = df.sparkSession
    at = shared_path(spark, "recordings")
    with small_batches(spark, 512):
        fingerprints(df, id_col, pcm_col).write.parquet(f"{at}/prints")
    seen = spark.read.schema("id long, items binary").parquet(f"{at}/prints").withColumn("h1", F.xxhash64("items")).withColumn("h2", F.crc32("items"))
    real = seen.where("id is not null and octet_length(items) > 0")
    classes = checkpoint(real.groupBy("h1", "h2").agg(F.min("id").alias("node"), F.first("items").alias("items")))
    found = matches(classes.select(F.col("node").alias("id"), "items"), at)
    roots = components(found.select("a", "b"))
    sizes = real.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    named = classes.select("h1", "h2", "node").join(roots, "node", "left").join(sizes, ["h1", "h2"]).select("h1", "h2", F.coalesce("root", "node").alias("component_id"), "n")
    named = checkpoint(named)
    sums = named.groupBy("component_id").agg((F.sum("n") - 1).alias("n_linked"))
    named = named.join(sums, "component_id").select("h1", "h2", "component_id", "n_linked")
    rows = checkpoint(seen.select("id", F.expr("CAST(octet_length(items) div 4 AS bigint)").alias("n_items"), "h1", "h2", F.col("h2").alias("fingerprint")))
    remove(spark, at)
    linked = rows.where("id is not null and n_items > 0").join(named, ["h1", "h2"]).select("id", "n_items", "component_id", "n_linked", "fingerprint")
    alone = rows.where("id is null or n_items = 0").select("id", "n_items", F.col("id").alias("component_id"), F.lit(0).cast("long").alias("n_linked"), "fingerprint")
    return linked.union(alone)


def rendered(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pcm: each word of a text as a tone of 64 ms whose pitch follows from the word. The test tables hold no sound."""

    def run(batches):
        import zlib

        n = RATE * 64 // 1000
        t = np.arange(n) / RATE
        tones = [(9000 * np.sin(2 * np.pi * 220.0 * 2 ** (k / 12) * t)).astype("<i2").tobytes() for k in range(36)]
        for b in pieces(batches, 128):
            out = [b"".join([tones[zlib.crc32(w) % 36] for w in t_.split()]) for t_ in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), binary_array(out)], names=["id", "pcm"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, pcm binary")


#: A recording's id is conv_id * TURNS + turn.
TURNS = 100_000


def op2_chroma_prints(spark, sf_dir: str) -> DataFrame:
    """Class of every turn of ``conversations``, rendered as sound."""
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * TURNS + F.col("turn")).alias("id"), "text")
    return recording_classes(rendered(turns, "id", "text")).withColumnRenamed("id", "recording_id")
