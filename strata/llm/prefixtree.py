"""Prefix tree of conversations, built as a Patricia tree over their sorted sequences.

A turn is 24 bytes: 128 bits of the SHA-256 of role and text, and the bytes of the text; a conversation is the bytes of
its turns in order, so equal beginnings are equal bytes. All sequences are sorted together (dealt by ranges of sequence
and id, so that a conversation with any number of copies is many tasks). In sorted order the turns that neighbours share
give the tree: one pass with a stack makes only the points where sequences branch, end or are leaves, each with the
compressed edge above it. A point's members are a stretch of the sorted rows, so its sums are differences of running sums.
Unary nodes are written last, from the point at the edge's lower end and the suffix sums of the bytes along the edge.

Rows are taken in segments of ``SEGMENT`` at most, which bounds a task's memory. A node whose members reach over a segment's border
lies on the path of the segment's first or last sequence; each segment gives its part of such open nodes, and
the parts are summed by the hash of the path. How many turns the first row of a partition shares with the last one of
the partition before it is the only thing that goes through the driver: two numbers for each partition.

Cases: null role or text is empty; a null turn comes first, turns of equal place are ordered by the hash of role and
text; rows that repeat are turns of their own; rows with a null conv_id are left out; turnless conversations end at the root;
texts of any length are read whole and shuffled as 24 bytes; one row holds the 24 bytes of all turns of a conversation; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import checkpoint, remove, shared_path, small_batches, table

TURN = 24  #: bytes of a turn in a sequence
SEGMENT = 20_000
NOTHING = hashlib.sha256(b"").hexdigest()
ROWS = "kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, seg long, place long, key binary, parent_key binary, above long"
SCHEMA = pa.schema([
    ("kind", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
    ("saved_tokens", pa.int64()), ("ends", pa.string()), ("seg", pa.int64()), ("place", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary()), ("above", pa.int64()),
])
NODE, OPEN, ENDS = 0, 1, 2
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns(df: DataFrame) -> DataFrame:
    """conv_id, keys (array of the turns' hex keys in order) of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    rows = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(digest, F.lpad(F.hex(F.octet_length(text)), 16, "0")).alias("key"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "key"))), lambda x: x["key"]).alias("keys"))


def rebuilt(convs: DataFrame, group: int = 5, most: int = 9) -> DataFrame:
    """conv_id, keys: each conversation with the first turns of its group's first one in place of its own.

    The group of c is c - c % group, and h = crc32(decimal c) % most turns are taken.
    """
    convs = checkpoint(convs)
    head = convs.select(F.col("conv_id").alias("first_"), F.slice("keys", 1, most - 1).alias("head_"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    own = convs.withColumn("first_", F.col("conv_id") - F.col("conv_id") % group).withColumn("h_", h)
    keys = F.concat(F.slice(F.coalesce("head_", F.array().cast("array<string>")), F.lit(1), F.col("h_")), F.slice("keys", F.col("h_") + 1, F.size("keys")))
    return own.join(head, "first_", "left").select("conv_id", keys.alias("keys"))


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two sequences share at their beginning."""
    lo, hi = 0, min(len(a), len(b)) // TURN
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo * TURN : mid * TURN] == b[lo * TURN : mid * TURN]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def path_keys(seq: bytes, depth: int) -> list[bytes]:
    """Hashes of the first 0, 1, ... depth turns."""
    h, out = hashlib.sha256(), []
    for d in range(depth + 1):
        if d:
            h.update(seq[(d - 1) * TURN : d * TURN])
        out.append(h.copy().digest()[:16])
    return out


class Points:
    """Points of one segment: what the stack makes of the turns that neighbours share."""

    def __init__(self, size: list[int], shared: list[int], after: int, least: list[int]):
        self.depth, self.first, self.last, self.low, self.children, self.end, self.goes_on, self.parent, self.open = ([] for _ in range(9))
        stack: list[int] = []
        for d in range(max(0, shared[0]) + 1):  # the path on which the segment begins
            stack.append(self.add(d, 0, shared[0] >= 0))
        for k, n in enumerate(size):
            d = max(0, shared[k])
            self.close(stack, d, k - 1)
            top = stack[-1]
            if n > d:
                self.children[top] += 1
                stack.append(self.add(n, k))
                top = stack[-1]
            self.end[top] = k
            self.low[top] = min(self.low[top], least[k])
        self.close(stack, max(0, after), len(size) - 1)
        if after >= 0:  # every node of the path on which it ends
            full, below = [], stack[-1]
            for at in reversed(stack):
                for d in range(self.depth[below] - 1, self.depth[at], -1):
                    full.append(self.add(d, self.first[below]))
                    self.children[full[-1]] = 1
                full.append(at)
                below = at
            stack = full[::-1]
        for at in reversed(stack):
            self.last[at] = len(size) - 1
            self.open[at] = after >= 0 or self.goes_on[at]
        for up, at in reversed(list(zip(stack, stack[1:], strict=False))):
            self.parent[at] = up
            self.low[up] = min(self.low[up], self.low[at])

    def add(self, depth: int, first: int, goes_on: bool = False) -> int:
        for held, value in ((self.depth, depth), (self.first, first), (self.last, -1), (self.low, 1 << 63), (self.children, 0), (self.end, -1), (self.goes_on, goes_on), (self.parent, -1), (self.open, goes_on)):
            held.append(value)
        return len(self.depth) - 1

    def close(self, stack: list[int], d: int, last: int) -> None:
        """Takes what lies deeper than d from the stack; at d there is a point then."""
        while self.depth[stack[-1]] > d:
            at = stack.pop()
            if self.depth[stack[-1]] < d:
                stack.append(self.add(d, self.first[at]))
                self.children[stack[-1]] = 1
            up = stack[-1]
            self.last[at], self.parent[at] = last, up
            self.low[up] = min(self.low[up], self.low[at])


def segment(seqs: list[bytes], ids: list[int], before: int, after: int, seg: int) -> pa.RecordBatch:
    """Rows (nodes, parts of open nodes, ids that end at open nodes) of sorted sequences. ``before`` and ``after``: the turns
    that the first one shares with the row before it and the last one with the row behind it; -1 where there is none."""
    begin = [0, *[k for k in range(1, len(seqs)) if seqs[k] != seqs[k - 1]]]
    ends_at = [*begin[1:], len(seqs)]
    runs = [seqs[k] for k in begin]
    size = [len(s) // TURN for s in runs]
    shared = [before, *[shared_turns(a, b) for a, b in zip(runs, runs[1:], strict=False)]]
    p = Points(size, shared, after, [ids[k] for k in begin])  # ids of equal sequences are sorted
    # running sums over the runs, and bytes of the first d turns of each run at place[k] + d
    flat = np.frombuffer(b"".join(runs), np.dtype([("hash", "S16"), ("bytes", ">i8")]))["bytes"].astype(np.int64)
    n = np.array(size)
    place = np.concatenate([[0], np.cumsum(n + 1)])
    total = np.concatenate([[0], np.cumsum(flat)])
    start = np.cumsum(n) - n
    prefix = np.concatenate([total[s : s + m + 1] - total[s] for s, m in zip(start.tolist(), size, strict=True)])
    copies = np.array(ends_at) - np.array(begin)
    whole = prefix[place[:-1] + n]
    own = whole - prefix[place[:-1] + np.maximum(shared, 0)]
    leaf = n > np.array([*shared[1:], after])
    run = lambda x: np.concatenate([[0], np.cumsum(x)])
    sum_copies, sum_whole, sum_own, sum_leaf = run(copies), run(copies * whole), run(own), run(leaf)
    depth, first, last, low, children, end, parent = (np.array(x, np.int64) for x in (p.depth, p.first, p.last, [min(x, (1 << 63) - 1) for x in p.low], p.children, p.end, p.parent))
    goes_on, is_open = np.array(p.goes_on, bool), np.array(p.open, bool)
    members, leaves = sum_copies[last + 1] - sum_copies[first], sum_leaf[last + 1] - sum_leaf[first]
    above = prefix[place[first] + np.maximum(depth - 1, 0)]
    # bytes of all members' turns from here on, less one copy of each distinct one
    once = np.where(goes_on, sum_own[last + 1] - sum_own[first], sum_own[last + 1] - sum_own[first + 1] + whole[first] - above)
    part = sum_whole[last + 1] - sum_whole[first] - once
    saved = part - members * above

    def ids_of(k: int) -> str:
        return ",".join(map(str, ids[begin[k] : ends_at[k]]))

    # closed points, and the unary nodes of the edges above them
    at = np.flatnonzero(~is_open)
    up = np.where(parent[at] >= 0, parent[at], at)
    span = np.where(parent[at] >= 0, depth[at] - depth[up], 1)
    of = np.repeat(at, span)
    back = np.repeat(np.cumsum(span), span) - np.arange(len(of)) - 1  # how far above its point a node is
    d = depth[of] - back
    suffix = prefix[place[first[of]] + np.maximum(depth[of] - 1, 0)] - prefix[place[first[of]] + np.maximum(d - 1, 0)]
    top = back == np.repeat(span, span) - 1
    up_of = np.repeat(up, span)
    lone = top & (parent[of] >= 0) & is_open[up_of]
    told = np.where(top, low[up_of], low[of])
    no_parent = lone | (d == 0)
    ends = [NOTHING] * len(of)
    for i in np.flatnonzero((back == 0) & (end[of] >= 0)).tolist():
        ends[i] = hashlib.sha256(ids_of(int(end[of[i]])).encode()).hexdigest()
    nodes = {
        "kind": pa.array(np.zeros(len(of), np.int32)), "conv_id": pa.array(low[of]), "depth": pa.array(d), "parent_conv_id": pa.array(told, mask=no_parent), "n_convs": pa.array(members[of]),
        "n_children": pa.array(np.where(back == 0, children[of], 1)), "n_leaves": pa.array(leaves[of]), "saved_tokens": pa.array(saved[of] + (members[of] - 1) * suffix), "ends": pa.array(ends, pa.string()),
        "seg": pa.array(np.full(len(of), seg)), "place": pa.array(up_of, mask=~lone), "key": pa.nulls(len(of), pa.binary()), "parent_key": pa.nulls(len(of), pa.binary()), "above": pa.nulls(len(of), pa.int64()),
    }
    # parts of open nodes: they lie on the paths of the first and the last sequence
    at = np.flatnonzero(is_open)
    keys = {False: path_keys(runs[-1], max(0, after)), True: path_keys(runs[0], max(0, before))}
    keyed = [keys[bool(goes_on[i])] for i in at]
    m = len(at)
    opened = {
        "kind": pa.array(np.full(m, OPEN, np.int32)), "conv_id": pa.array(low[at]), "depth": pa.array(depth[at]), "parent_conv_id": pa.nulls(m, pa.int64()), "n_convs": pa.array(members[at]), "n_children": pa.array(children[at]),
        "n_leaves": pa.array(leaves[at]), "saved_tokens": pa.array(part[at]), "ends": pa.nulls(m, pa.string()), "seg": pa.array(np.full(m, seg)), "place": pa.array(at), "key": pa.array([k[i] for k, i in zip(keyed, depth[at], strict=True)], pa.binary()),
        "parent_key": pa.array([k[i - 1] if i else None for k, i in zip(keyed, depth[at], strict=True)], pa.binary()), "above": pa.array(above[at]),
    }
    told_ends = [(int(end[i]), k[depth[i]]) for i, k in zip(at, keyed, strict=True) if end[i] >= 0]
    m = len(told_ends)
    none = pa.nulls(m, pa.int64())
    ended = dict.fromkeys(SCHEMA.names, none) | {
        "kind": pa.array(np.full(m, ENDS, np.int32)), "ends": pa.array([ids_of(k) for k, _ in told_ends], pa.string()), "seg": pa.array(np.full(m, seg)), "key": pa.array([k for _, k in told_ends], pa.binary()), "parent_key": pa.nulls(m, pa.binary()),
    }
    tables = [pa.Table.from_arrays([x[c] for c in SCHEMA.names], schema=SCHEMA) for x in (nodes, opened, ended)]
    return pa.concat_tables(tables).combine_chunks().to_batches()[0]


def borders(ordered: DataFrame) -> dict[int, tuple[int, int]]:
    """Of each partition that holds rows: the turns that it shares with the one before it and behind it (-1: there is none)."""

    def outer(batches):
        from pyspark import TaskContext

        first = last = None
        for b in batches:
            if b.num_rows:
                first = b.column(0)[0].as_py() if first is None else first
                last = b.column(0)[b.num_rows - 1].as_py()
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first], pa.binary()), pa.array([last], pa.binary())], names=["part", "first", "last"])

    def shared(batches):
        before = None
        for b in batches:
            rows = []
            for part, first, last in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows.append((part, -1 if before is None else shared_turns(before, first)))
                before = last
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 2, names=["part", "n"])

    ends = ordered.select("seq").mapInArrow(outer, "part long, first binary, last binary")  # one row a partition
    rows = sorted(tuple(r) for r in ends.coalesce(1).sortWithinPartitions("part").mapInArrow(shared, "part long, n long").collect())
    return {part: (n, rows[i + 1][1] if i + 1 < len(rows) else -1) for i, (part, n) in enumerate(rows)}


def prefix_tree(convs: DataFrame) -> DataFrame:
    """The nodes (``NODES``) of the prefix tree of the sequences (conv_id: distinct longs, keys)."""
    spark = convs.sparkSession
    seqs = convs.select(F.unhex(F.array_join("keys", "")).alias("seq"), "conv_id")
    ordered = checkpoint(seqs.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id"))
    edges = borders(ordered)
    at_most = SEGMENT

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before, after = edges.get(part, (-1, -1))
        held_seqs, held_ids, count = [], [], 0
        for b in batches:
            for s, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(held_ids) == at_most:
                    common = shared_turns(held_seqs[-1], s)
                    yield segment(held_seqs, held_ids, before, common, part << 32 | count)
                    before, count, held_seqs, held_ids = common, count + 1, [], []
                held_seqs.append(s)
                held_ids.append(i)
        if held_ids:
            yield segment(held_seqs, held_ids, before, after, part << 32 | count)

    at = shared_path(spark, "prefix-tree")
    with small_batches(spark, 5000):
        ordered.mapInArrow(run, ROWS).write.parquet(at)
    rows = spark.read.schema(ROWS).parquet(at)
    found = assembled(rows)
    result = shared_path(spark, "prefix-nodes")
    found.write.parquet(result)
    remove(spark, at)
    return spark.read.schema(found.schema).parquet(result)


def assembled(rows: DataFrame) -> DataFrame:
    """The nodes of all segments, with those that segments share put together."""
    parts = rows.where(F.col("kind") == OPEN)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    whole = checkpoint(parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.max("above").alias("above"), *sums))

    def digest(batches):
        now, h = None, None
        for b in batches:
            out = []
            for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        out.append((now, h.hexdigest()))
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends_sha256"])

    # one row holds up to a segment's ids, so the ids of a sequence with very many copies pass one task as few rows, in order
    ends = rows.where(F.col("kind") == ENDS).select("key", "seg", "ends").repartition("key").sortWithinPartitions("key", "seg")
    with small_batches(rows.sparkSession, 64):
        ended = checkpoint(ends.mapInArrow(digest, "key binary, ends_sha256 string"))
    up = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    shared = whole.withColumn("saved_tokens", F.col("saved_tokens") - F.col("n_convs") * F.col("above")).join(up, "parent_key", "left").join(ended, "key", "left")
    shared = shared.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*NODES)
    nodes = rows.where(F.col("kind") == NODE).withColumnRenamed("ends", "ends_sha256")
    # nodes below an open one: of a segment and a place in it there are at most ``SEGMENT``, so no key of this join is hot
    place = parts.select("seg", "place", "key").join(whole.select("key", F.col("conv_id").alias("up_")), "key").drop("key")
    below = nodes.where("place is not null").drop("parent_conv_id").join(place, ["seg", "place"]).withColumnRenamed("up_", "parent_conv_id")
    return nodes.where("place is null").select(*NODES).unionByName(below.select(*NODES)).unionByName(shared)


def op12_prefix_tree(spark, sf_dir: str) -> DataFrame:
    """The prefix tree of all rebuilt conversations."""
    return prefix_tree(rebuilt(turns(table(spark, sf_dir, "conversations"))))


OP12_SQL = """
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM (SELECT unnest(range(256)) AS i)),
crc_table AS (SELECT list(t ORDER BY i) AS t FROM bits),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, text, sha256(concat(strlen(role), ':', role, text)) AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS n FROM o),
c AS (SELECT conv_id AS c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, x: xor(a // 256, list_extract(bits_, CAST(xor(a % 256, x) + 1 AS BIGINT)))), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), (SELECT t AS bits_ FROM crc_table)),
r AS (SELECT c, n AS d, k, strlen(text) AS b FROM c JOIN t ON conv_id = c - c % 5 AND n <= h UNION ALL SELECT c, least(h, f) + n - h, k, strlen(text) FROM c JOIN t ON conv_id = c AND n > h JOIN (SELECT c AS c2, (SELECT count(*) FROM t WHERE conv_id = x.c - x.c % 5) AS f FROM c x) ON c2 = c),
m AS (SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d) AS p, b FROM r UNION ALL SELECT c, 0, '', 0 FROM c),
l AS (SELECT c, max(d) AS len FROM m GROUP BY c),
g AS (SELECT d, p, min(m.c) AS conv_id, count(*) AS n, max(b) AS b, coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (len = d), '') AS ends FROM m JOIN l ON l.c = m.c GROUP BY d, p),
k AS (SELECT left(p, 64 * (d - 1)) AS q, count(*) AS n FROM g WHERE d > 0 GROUP BY 1),
s AS (SELECT left(p, CAST(64 * u AS BIGINT)) AS q, sum((g.n - 1) * b) AS saved, count(*) FILTER (k.q IS NULL) AS leaves FROM (SELECT *, unnest(range(d + 1)) AS u FROM g) g LEFT JOIN k ON k.q = p GROUP BY 1)
SELECT g.conv_id, CAST(g.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, g.n AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(g.ends) AS ends_sha256
FROM g LEFT JOIN g up ON g.d > 0 AND up.p = left(g.p, 64 * (g.d - 1)) LEFT JOIN k ON k.q = g.p JOIN s ON s.q = g.p
"""
