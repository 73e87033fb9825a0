"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard checks, components.

Signature: one permutation places a shingle in a circle of ``CIRCLE`` slots, a second one ranks the slots;
coordinate k is the least rank among the slots shifted by k. So two permutations give every coordinate,
and the coordinates of one shingle are a run of consecutive table entries. ``BANDS`` bands of ``ROWS``
coordinates become keys: at a similarity of 0.8 two sets share no key with a chance below 1e-5.

Plan: documents with equal sets are one class (summed by the set's hash before anything else, so copies
cost nothing later). Classes are dealt by ranges of (key, next key, class), which splits a key that many
classes share; in that order every class meets its neighbours, the first class of its key, and, among the
first ``SMALL`` of a key, all of them: rows grow with the classes, never with their square. Candidate pairs
are counted over the bands. Then, in rounds, every component picks the two most promising of its pairs to
other components, these are checked on the full sets, and links merge components; the last round checks all pairs
that still join two components. Last, all pairs of one key that were no neighbours and are still in two components
are compared by sketches that bound their similarity, and checked in the same way unless the bound excludes them;
these comparisons grow with the classes of a key times those outside its main component. So no two classes that share a key stay unchecked unless they are already linked.

Cases: null, empty and white-space texts have empty sets and are linked with nothing; a text with fewer
words than the shingle width is one shingle; texts of any length are read whole; rows that repeat a doc_id
with equal text are returned as often as they occur, with the same values; rows with a null doc_id link
nothing and are their own component (null); an empty table gives an empty result; extra columns are ignored
by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import binary_array, checkpoint, compact, components, mix64, pieces, remove, shared_path, small_batches, table, text_shingles, trim

CIRCLE = 1 << 20
ROWS = 8
BANDS = 64
SMALL = 8
LAGS = 2
#: Classes in a block of a key, blocks in a lane, and slots of a set's sketch, for the pairs that were no neighbours.
SHARE = 128
LANE = 16
SKETCH = 1024
#: A list of ids is broadcast only up to this many rows (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 250_000
PICKING_ROUNDS = 1


def rank_table(seed: int = 11) -> np.ndarray:
    """Ranks of the slots, once around the circle and as far again as the last shift reaches."""
    ranks = np.random.default_rng(seed).permutation(CIRCLE).astype(np.int32)
    return np.concatenate([ranks, ranks[: ROWS * BANDS]])


def signature(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """``ROWS * BANDS`` coordinates of a set of shingle hashes."""
    slots = (mix64(shingles ^ np.uint64(0x5DEECE66D)) & np.uint64(CIRCLE - 1)).astype(np.int64)
    shifted = np.lib.stride_tricks.sliding_window_view(ranks, ROWS * BANDS)
    out = None
    for at in range(0, len(slots), 256):
        low = shifted[slots[at : at + 256]].min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        keys = mix64(keys * np.uint64(31) + parts[:, :, k] + np.uint64(1))
    return keys


def sketches(df: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (hash of the set; null for an empty set), keys (binary: one long per band)."""

    def run(batches):
        import xxhash

        ranks = rank_table()
        for b in pieces(batches):
            n, h1, h2, rows, sigs = [], [], [], [], []
            for i, s in enumerate(map(np.unique, text_shingles(b.column(1), width))):
                n.append(len(s))
                if not len(s):
                    h1.append(None)
                    h2.append(None)
                    continue
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                h1.append((h >> 64) - (1 << 63))
                h2.append((h & (1 << 64) - 1) - (1 << 63))
                rows.append(i)
                sigs.append(signature(s, ranks))
            keys = [None] * b.num_rows
            if rows:
                for i, k in zip(rows, band_keys(np.stack(sigs)), strict=True):
                    keys[i] = k.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), binary_array(keys)], names=["doc_id", "n_shingles", "h1", "h2", "keys"])
        trim()

    return df.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys binary")


def explode_keys(classes: DataFrame) -> DataFrame:
    """node, key, next: one row per band; ``next`` is the key of the band after it."""

    def run(batches):
        for b in pieces(batches, 1024):
            keys = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, BANDS)
            node = np.repeat(b.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys.reshape(-1)), pa.array(np.roll(keys, -1, axis=1).reshape(-1))], names=["node", "key", "next"])
        trim()

    return classes.select("node", "keys").mapInArrow(run, "node long, key long, next long")


def neighbours(banded: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) with the number of bands that propose them.

    A key that goes on over partitions is joined by its least class: each partition's least one meets it.
    """
    parts = int(banded.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        tail_key = tail_node = np.zeros(0, np.int64)
        run_at, lowest = 0, 0  # rows of the current key so far, and its least class
        first_key, first_least = None, 0
        for b in batches:
            new_key, new_node = b.column(1).to_numpy(), b.column(0).to_numpy()
            if not len(new_key):
                continue
            old = len(tail_key)
            key, node = np.concatenate([tail_key, new_key]), np.concatenate([tail_node, new_node])
            index = np.arange(len(new_key))
            head = np.concatenate([[old == 0 or new_key[0] != tail_key[-1]], new_key[1:] != new_key[:-1]])
            begin = np.maximum.accumulate(np.where(head, index, -1))
            place = np.where(begin >= 0, index - begin, index + run_at)
            seg = np.flatnonzero(head | (index == 0))
            least = np.minimum.reduceat(new_node, seg)
            if not head[0]:
                least[0] = min(int(least[0]), lowest)
            lowest = int(least[-1])
            if first_key is None:
                first_key, first_least = int(new_key[0]), int(new_node[0])
            if new_key[0] == first_key:
                first_least = min(first_least, int(least[0]))
            a, c = [np.repeat(least, np.diff(np.append(seg, len(new_node))))], [new_node]
            for lag in range(1, SMALL):
                at = index[(place >= lag) & ((place < SMALL) | (lag <= LAGS))]
                a.append(node[at + old - lag])
                c.append(new_node[at])
            run_at = int(place[-1]) + 1
            tail_key, tail_node = key[-SMALL:], node[-SMALL:]
            x, y = np.concatenate(a), np.concatenate(c)
            low, high = np.minimum(x, y), np.maximum(x, y)
            keep = low < high
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(int(keep.sum()), bool)), pa.array(low[keep]), pa.array(high[keep])], names=["edge", "a", "b"])
        if first_key is not None:  # what may go on in the partitions before and after: key and least class here
            ends = {first_key: first_least} | {int(tail_key[-1]): lowest}
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(ends)), pa.array(list(ends), pa.int64()), pa.array(list(ends.values()), pa.int64())], names=["edge", "a", "b"])

    dealt = banded.repartitionByRange(parts, "key", "next", "node").sortWithinPartitions("key", "next", "node")
    found = checkpoint(dealt.mapInArrow(run, "edge boolean, a long, b long").groupBy("edge", "a", "b").agg(F.count("*").alias("bands")))
    ends = found.where("edge").select(F.col("a").alias("key"), F.col("b").alias("node"))
    least = ends.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("shares")).where("shares > 1")
    joined = least.join(ends, "key").where("a < node").select("a", F.col("node").alias("b"), F.lit(1).cast("long").alias("bands"))
    return found.where("not edge").select("a", "b", "bands").union(joined).groupBy("a", "b").agg(F.sum("bands").alias("bands"))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def checked(pairs: DataFrame, n_pairs: int, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).join(maybe_broadcast(pairs, n_pairs), "a")
    need = pairs.select(F.col("b").alias("node")).distinct()
    right = sets.join(maybe_broadcast(need, n_pairs), "node", "left_semi").select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def run(batches):
        for batch in pieces(batches, 1024):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        trim()

    return left.join(right.hint("merge"), "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def set_sketches(sets: DataFrame) -> DataFrame:
    """node, sketch (binary): which of ``SKETCH`` slots the shingles of a set fall in."""

    def run(batches):
        for b in pieces(batches, 1024):
            out = []
            for x in b.column(1).to_pylist():
                bits = np.zeros(SKETCH, np.uint8)
                bits[(mix64(np.frombuffer(x, np.uint64)) % np.uint64(SKETCH)).astype(np.int64)] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), binary_array(out)], names=["node", "sketch"])
        trim()

    return sets.select("node", "shingles").mapInArrow(run, "node long, sketch binary")


def unproposed(members: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a < b, bands) that share a key but are not in ``pairs``, for classes of different components.

    ``members`` has key, node, root and n (size of the set). Of two such classes one at least is outside the component
    that most of the key's classes belong to, so blocks of those meet all blocks of the key: a key of one component
    costs nothing. A slot that only x has holds a shingle that y lacks, so sizes and slots bound what two sets share;
    pairs that cannot reach ``percent`` are left out, and no others.
    """
    per_root = members.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = per_root.groupBy("key").agg(F.sum("c").alias("held"), F.count("*").alias("roots"), F.max(F.struct("c", "root")).getField("root").alias("main")).where("roots > 1 and held > 2")
    mixed = members.join(keys.select("key", "main", F.ceil(F.col("held") / SHARE).alias("shares")), "key").withColumn("out", F.col("root") != F.col("main"))
    mixed = mixed.join(set_sketches(sets), "node").withColumn("share", F.pmod(F.xxhash64("node"), "shares"))
    lists = [F.collect_list(c).alias(f"{c}s") for c in ("node", "root", "n")]
    blocks = checkpoint(mixed.groupBy("key", "out", "share").agg(*lists, F.collect_list("sketch").alias("sketches"), F.first("shares").alias("shares")))
    # the blocks of a key are dealt to lanes of ``LANE``, and its outer blocks go to every lane: a large key is many tasks
    lane = F.floor(F.col("share") / LANE).cast("int")
    cols = ("nodes", "roots", "ns", "sketches")
    one = blocks.where("out").select("key", F.col("share").alias("at"), F.explode(F.sequence(F.lit(0), F.floor((F.col("shares") - 1) / LANE).cast("int"))).alias("lane"), *[F.col(c).alias(f"{c}_") for c in cols])
    met = one.join(blocks.withColumn("lane", lane), ["key", "lane"]).where("not out or at <= share").select(*[f"{c}_" for c in cols], *cols)

    def run(batches):
        for batch in pieces(batches, 64):
            low, high = [], []
            for i in range(batch.num_rows):
                x, rx, nx, y, ry, ny = (batch.column(c)[i].values.to_numpy() for c in (0, 1, 2, 4, 5, 6))
                sx, sy = (np.frombuffer(b"".join(batch.column(c)[i].as_py()), np.uint64).reshape(-1, SKETCH // 64) for c in (3, 7))
                least, most = np.minimum.outer(nx, ny), np.maximum.outer(nx, ny)
                p, q = np.nonzero((rx[:, None] != ry[None, :]) & (100 * least >= percent * most))
                for at in range(0, len(p), 8192):
                    u, v = p[at : at + 8192], q[at : at + 8192]
                    lacks = np.bitwise_count(sx[u] & ~sy[v]).sum(axis=1, dtype=np.int64)
                    more = np.bitwise_count(sy[v] & ~sx[u]).sum(axis=1, dtype=np.int64)
                    both = np.minimum(nx[u] - lacks, ny[v] - more)
                    ok = 100 * both >= percent * (nx[u] + ny[v] - both)
                    low.append(np.minimum(x[u[ok]], y[v[ok]]))
                    high.append(np.maximum(x[u[ok]], y[v[ok]]))
            if low:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low)), pa.array(np.concatenate(high))], names=["a", "b"])
        trim()

    with small_batches(members.sparkSession, 64):  # a row holds two blocks
        found, _ = compact(met.mapInArrow(run, "a long, b long").groupBy("a", "b").agg(F.count("*").alias("bands")))
    return found.join(pairs.select("a", "b"), ["a", "b"], "left_anti")


def set_rows(docs: DataFrame, width: int) -> DataFrame:
    """node, shingles (binary, sorted longs) of the given (node, text) rows."""

    def run(batches):
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), binary_array([np.unique(s).tobytes() for s in text_shingles(b.column(1), width)])], names=["node", "shingles"])
        trim()

    return docs.select("node", "text").mapInArrow(run, "node long, shingles binary")


def link_rounds(pairs: DataFrame, sets: DataFrame, percent: int, roots: DataFrame | None = None) -> DataFrame:
    """Components (node, root) of the candidate pairs that are similar, merged in rounds (see above); ``roots``: those known."""
    spark = pairs.sparkSession
    left, turn = pairs, 0
    links = None if roots is None else roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    while True:
        if roots is not None:
            here = roots.select(F.col("node").alias("a"), F.col("root").alias("ra"))
            there = roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
            left = left.join(here, "a", "left").join(there, "b", "left").select("a", "b", "bands", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
        else:
            left = left.select("a", "b", "bands", F.col("a").alias("ra"), F.col("b").alias("rb"))
        left, _ = compact(left)
        if turn < PICKING_ROUNDS:
            both = left.select(F.col("ra").alias("r"), "bands", "a", "b").union(left.select(F.col("rb").alias("r"), "bands", "a", "b"))
            half = F.xxhash64("a", "b", F.lit(turn)) % 2 == 0
            best = [F.max(F.when(half if k else ~half, F.struct("bands", "a", "b"))).alias(f"m{k}") for k in (0, 1)]
            chosen = both.groupBy("r").agg(*best).select(F.explode(F.array("m0", "m1")).alias("m")).where("m is not null").select("m.a", "m.b").distinct()
        else:
            chosen = left.select("a", "b")
        chosen, n = compact(chosen)
        if n == 0:
            break
        with small_batches(spark, 256):  # a row holds two sets
            good, _ = compact(checked(chosen, n, sets, percent))
        links = good if links is None else links.union(good)
        roots, _ = compact(components(links))
        if turn >= PICKING_ROUNDS:
            break
        left = left.join(chosen, ["a", "b"], "left_anti").select("a", "b", "bands")
        turn += 1
    if roots is None:
        return spark.createDataFrame([], "node long, root long")
    return roots


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    at = shared_path(spark, "minhash")
    with small_batches(spark, 1024):
        sketches(docs, width).write.parquet(f"{at}/sketches")
    seen = spark.read.parquet(f"{at}/sketches")
    known = seen.where("doc_id is not null and h1 is not null")
    known.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"), F.first("n_shingles").alias("n")).write.parquet(f"{at}/classes")
    classes = spark.read.parquet(f"{at}/classes")
    pairs, _ = compact(neighbours(explode_keys(classes)))
    need, n = compact(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct())
    # equal rows can repeat an id: one of them gives the set
    wanted = docs.withColumnRenamed("doc_id", "node").join(maybe_broadcast(need, n), "node", "left_semi")
    with small_batches(spark, 1024):
        set_rows(wanted, width).groupBy("node").agg(F.first("shingles").alias("shingles")).write.parquet(f"{at}/sets")
    sets = spark.read.schema("node long, shingles binary").parquet(f"{at}/sets")
    roots = link_rounds(pairs, sets, percent)
    # every class of a key that others share is in ``need``, as it meets one of them at least
    again = classes.join(maybe_broadcast(need, n), "node", "left_semi")
    of_node = again.select("node", "n").join(roots, "node", "left").select("node", "n", F.coalesce("root", "node").alias("root"))
    members = checkpoint(explode_keys(again).select("node", "key").join(maybe_broadcast(of_node, n), "node"))
    roots = link_rounds(unproposed(members, sets, pairs, percent), sets, percent, roots)
    small = roots.groupBy("root").agg(F.min("node").alias("low"))
    named = roots.join(small, "root").select("node", "low")
    by_class = classes.select("h1", "h2", "node").join(named, "node", "left").select("h1", "h2", F.coalesce("low", "node").alias("component_id"))
    counts = seen.select("doc_id", "n_shingles", "h1", "h2")
    linked = counts.where("doc_id is not null and h1 is not null").join(by_class, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id")
    alone = counts.where("doc_id is null or h1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked.union(alone).write.parquet(f"{at}/result")
    remove(spark, *[f"{at}/{x}" for x in ("sketches", "classes", "sets")])
    return spark.read.schema("doc_id long, n_shingles long, component_id long").parquet(f"{at}/result")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the one of least id; documents that are linked with nothing stay."""
    found = near_duplicates(df, id_col, text_col, width, percent)
    others = found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_")).distinct()
    return df.join(others, F.col(f"`{id_col}`").cast("long") == F.col("gone_"), "left_anti")


def op10_circulant_minhash(spark, sf_dir: str) -> DataFrame:
    """Component of every document over sets of 2-word shingles."""
    found = near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP10_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS sh FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, n, sh FROM s JOIN n USING (doc_id)),
link AS (SELECT a.doc_id AS x, b.doc_id AS y FROM k a JOIN k b ON a.sh = b.sh AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT edge.y, reach.c FROM reach JOIN edge ON edge.x = reach.d),
low AS (SELECT d, min(c) AS c FROM reach GROUP BY d)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, doc_id = c AS kept
FROM documents JOIN low ON d = doc_id LEFT JOIN n USING (doc_id)"""
