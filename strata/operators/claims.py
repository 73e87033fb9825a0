"""Interval operators over claims (pos, len in blocks): from bytes, merged, joined with blocks, swept."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from strata.session import checkpoint

BIN = 4096
#: Rows that a task sorts at a time where their number is known beforehand.
TASK_ROWS = 250_000


def claim_of_length(abs_off: Column, length: Column, contiguous: Column, block: int = 512) -> Column:
    """struct(pos, len) of an item of known place and length; null where it claims nothing."""
    ok = contiguous & (abs_off >= 0) & (length > 0)
    return F.when(ok, F.struct(F.call_function("div", abs_off, F.lit(block)).alias("pos"), F.call_function("div", length + (block - 1), F.lit(block)).alias("len")))


def claim_of_bytes(off: Column, length: Column, block: int = 512, compat: bool = False) -> Column:
    """struct(first, last): blocks whose first byte lies in the byte range; null if there is none.

    ``compat`` counts one block more where the range ends at a block boundary.
    """
    first = F.call_function("div", off + (block - 1), F.lit(block))
    last = F.call_function("div", off + length - (0 if compat else 1), F.lit(block))
    return F.when((length > 0) & (last >= first), F.struct(first.alias("first"), last.alias("last")))


def merge_claims(df: DataFrame, key: str, bin_size: int = BIN, tasks: int | None = None) -> DataFrame:
    """Union of intervals per key; adjacent ones are one. Null keys are one key; intervals without position or length are left out.

    They are merged by the bin that they begin in first, so one source is many tasks; what is left of each bin is then
    merged over the source. ``tasks``: number of tasks, else that of the session.
    """
    rows = df.where("pos is not null and len > 0").withColumn("bin_", F.expr(f"pos div {bin_size}"))
    return _islands(_islands(rows, [key, "bin_"], tasks).select(key, "pos", "len"), [key], tasks)


def _islands(df: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    df = df.repartition(tasks, *keys) if tasks else df
    w = Window.partitionBy(*keys).orderBy("pos", "len")
    end = F.col("pos") + F.col("len")
    marked = df.withColumn("before_", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    islands = marked.withColumn("island_", F.sum(F.when(F.col("pos") <= F.col("before_"), 0).otherwise(1)).over(w))
    return islands.groupBy(*keys, "island_").agg(F.min("pos").alias("pos"), F.max(end).alias("end")).select(*keys, "pos", (F.col("end") - F.col("pos")).alias("len"))


def before_ranges(block: Column, ranges: Column) -> Column:
    """The block lies before all of the ranges (array of struct(pos, len)); true without ranges, null for a null array."""
    return F.forall(ranges, lambda r: block < r["pos"])


def within_ranges(block: Column, ranges: Column) -> Column:
    """One of the ranges holds the block; null for a null array."""
    return F.exists(ranges, lambda r: (block >= r["pos"]) & (block < r["pos"] + r["len"]))


def after_ranges(block: Column, ranges: Column) -> Column:
    """The block lies behind the ends of all ranges; true without ranges, null for a null array."""
    return F.forall(ranges, lambda r: block >= r["pos"] + r["len"])


def range_inside(inner: Column, outer: Column) -> Column:
    """The range begins no earlier than the other and ends before it does (an equal end is not inside)."""
    return (inner["pos"] >= outer["pos"]) & (inner["pos"] + inner["len"] < outer["pos"] + outer["len"])


def last_block(ranges: Column) -> Column:
    """The last block of all ranges, whatever their order; null without ranges."""
    return F.array_max(F.transform(ranges, lambda r: r["pos"] + r["len"] - 1))


def outside_parent(items: DataFrame, item: str, parent: str) -> DataFrame:
    """Items (with pos and len) that reach out of the range of their parent: a check, empty for sound results.

    Items without parent, or whose parent is not there, cannot be checked and are left out.
    """
    up = items.select(F.col(item).alias("up_"), F.col("pos").alias("up_pos_"), F.col("len").alias("up_len_"))
    out = (F.col("pos") < F.col("up_pos_")) | (F.col("pos") + F.col("len") > F.col("up_pos_") + F.col("up_len_"))
    return items.join(up, F.col(parent) == F.col("up_")).where(out).drop("up_", "up_pos_", "up_len_")


def runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values per key: key, first order value, value, n."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = df.withColumn("change_", F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1))
    return changed.withColumn("run_", F.sum("change_").over(w)).groupBy(key, "run_").agg(F.min(order[0]).alias("start"), F.first(value).alias(value), F.count("*").alias("n"))


def binned(claims: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Each claim once per bin that it touches, so that an interval join becomes an equi-join."""
    return claims.withColumn("bin_", F.explode(F.sequence(F.expr(f"pos div {bin_size}"), F.expr(f"(pos + len - 1) div {bin_size}"))))


def blocks_outside(blocks: DataFrame, claims: DataFrame, key: str, bin_size: int = BIN) -> DataFrame:
    """Blocks that no claim of their key holds."""
    c = binned(claims, bin_size).select(F.col(key).alias("k_"), "bin_", "pos", "len")
    b = blocks.withColumn("bin_", F.expr(f"block div {bin_size}"))
    hit = (b[key] == c["k_"]) & (b["bin_"] == c["bin_"]) & (b["block"] >= c["pos"]) & (b["block"] < c["pos"] + c["len"])
    return b.join(c, hit, "left_anti").drop("bin_")


def blocks_inside(blocks: DataFrame, claims: DataFrame, key: str, bin_size: int = BIN) -> DataFrame:
    """Blocks with each claim that holds them."""
    c = binned(claims, bin_size).withColumnRenamed(key, "k_")
    b = blocks.withColumn("bin_", F.expr(f"block div {bin_size}"))
    hit = (b[key] == c["k_"]) & (b["bin_"] == c["bin_"]) & (b["block"] >= c["pos"]) & (b["block"] < c["pos"] + c["len"])
    return b.join(c, hit).drop(c["bin_"]).drop("k_", "bin_")


def continuations(claims: DataFrame) -> DataFrame:
    """One row per claimed block."""
    return claims.withColumn("block", F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("len") - 1)))


def owned_fragments(claims: DataFrame, key: str, owner: str, order: str, bin_size: int | None = None) -> DataFrame:
    """key, owner, pos, len: which stretch of blocks belongs to whom, if of all claims on a block the one that was written
    first (least ``order``, then least owner) has it. Input: key, owner, order, pos, len.

    Claims are dealt by bins; in each, one sweep over the beginnings in order holds the claims that reach over the sweep's place
    by their rank, and gives a stretch whenever the first of them changes. What is given are stretches, at most two for
    each claim and bin, never blocks. Stretches of one owner that touch are one. Claims without position or length are left out.
    """
    size = bin_size or RANGE_BLOCKS
    shuffled = int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffled, -(-claims.count() // TASK_ROWS))  # so that what a task sorts does not grow with the table
    rows = claims.where("pos is not null and len > 0").select(F.col(key).alias("k_"), F.col(owner).alias("w_"), F.col(order).alias("o_"), "pos", (F.col("pos") + F.col("len")).alias("end_"))
    dealt = rows.withColumn("bin_", F.explode(F.sequence(F.expr(f"pos div {size}"), F.expr(f"(end_ - 1) div {size}"))))
    low, high = F.greatest("pos", F.col("bin_") * size).cast("long"), F.least("end_", (F.col("bin_") + 1) * size).cast("long")
    dealt = dealt.select("k_", "bin_", low.alias("pos"), high.alias("end_"), "o_", "w_")
    schema = T.StructType([dealt.schema["k_"], dealt.schema["w_"], T.StructField("pos", T.LongType()), T.StructField("len", T.LongType())])
    arrow = to_arrow_schema(schema)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, held, out = None, 0, [], []

        def until(place: int | None):
            nonlocal at
            while held and (place is None or at < place):
                _, w, end = held[0]
                if end <= at:
                    heapq.heappop(held)
                    continue
                stop = end if place is None else min(end, place)
                if out and out[-1][0] == now[0] and out[-1][1] == w and out[-1][2] + out[-1][3] == at:
                    out[-1][3] += stop - at
                else:
                    out.append([now[0], w, at, stop - at])
                at = stop

        def batch():
            cols = list(zip(*out, strict=True)) or [()] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

        for b in batches:
            for k, bin_, pos, end, o, w in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (k, bin_) != now:
                    until(None)
                    now, at = (k, bin_), pos
                until(pos)
                at = max(at, pos)
                heapq.heappush(held, (o, w, end))
            yield batch()
        until(None)
        yield batch()

    painted = dealt.repartition(tasks, "k_", "bin_").sortWithinPartitions("k_", "bin_", "pos").mapInArrow(sweep, schema)
    whole = merge_claims(painted.select(F.struct("k_", "w_").alias("at_"), "pos", "len"), "at_", size, tasks)
    return whole.select(F.col("at_.k_").alias(key), F.col("at_.w_").alias(owner), "pos", "len")


def first_writer(claims: DataFrame, key: str, owner: str, order: str) -> DataFrame:
    """Owner of every claimed block: the claim that was written first keeps it. One row per block of the owned fragments: for sinks."""
    return continuations(owned_fragments(claims, key, owner, order)).select(key, "block", owner)


def promoted_members(items: DataFrame, key: str) -> DataFrame:
    """key, node, block, up: the members that get rows of their own, with the block of the item or member that they were told by.
    Input: key, node (unique in its key), parent (null for items), block (null if not known), ord.

    When something is shown at its block, those of its members that lie behind it wait for their own blocks; of several
    that wait for one block the first stays (told at the least block, then of least ``ord``, then ``node``), and what is dropped takes its
    members along. Whether a member counts depends on what lies before it, so rounds settle it: each takes the members of what
    was found to count in the round before, and sees a member once. Only where one of them takes a block from a member that was found
    earlier, all are looked at again, until nothing changes.
    """
    rows = items.select(key, "node", "parent", "block", "ord")
    top = rows.where("parent is null").select(key, "node", "block", F.lit(None).cast("long").alias("up"))
    below = rows.where("parent is not null and block is not null")
    rest, added, held = below, top, None

    def members(first: DataFrame) -> DataFrame:
        return first.select(key, F.col("m.node").alias("node"), "block", F.col("m.up").alias("up"))

    while True:
        over = added.select(F.col(key).alias("k_"), F.col("node").alias("up_node_"), F.col("block").alias("up"), F.lit(True).alias("told_"))
        seen = rest.join(over, (rest[key].eqNullSafe(over["k_"])) & (rest["parent"] == over["up_node_"]), "left").drop("k_", "up_node_")
        seen = checkpoint(seen.where("told_ is null or block > up"))
        rest = seen.where("told_ is null").drop("up", "told_")
        first = seen.where("block > up").groupBy(key, "block").agg(F.min(F.struct("up", "ord", "node")).alias("m"))
        if held is None:
            first = first.withColumn("taken", F.lit(False))
        else:
            has = held.select(F.col(key).alias("k_"), F.col("block").alias("b_"), F.col("m").alias("held_"))
            first = first.join(has, (first[key].eqNullSafe(has["k_"])) & (first["block"] == has["b_"]), "left").where("held_ is null or m < held_")
            first = first.select(key, "block", "m", F.col("held_").isNotNull().alias("taken"))
        first = checkpoint(first)
        n, taken = first.agg(F.count("*"), F.max("taken")).first()
        if taken:
            break
        held, added = first if held is None else held.unionByName(first), members(first)
        if not n or rest.isEmpty():
            return members(held)
    top, below = checkpoint(top), checkpoint(below)
    state, before = top.unionByName(members(held)), None
    while True:
        up = state.select(F.col(key).alias("k_"), F.col("node").alias("up_node_"), F.col("block").alias("up"))
        may = below.join(up, (below[key].eqNullSafe(up["k_"])) & (below["parent"] == up["up_node_"])).where("block > up")
        first = may.groupBy(key, "block").agg(F.min(F.struct("up", "ord", "node")).alias("m"))
        state = checkpoint(top.unionByName(first.select(key, F.col("m.node").alias("node"), "block", F.col("m.up").alias("up"))))
        now = tuple(state.agg(F.count("*"), F.sum(F.xxhash64(key, "node", "up").cast("decimal(38,0)"))).first())
        if now == before:
            return state.where("up is not null")
        before = now


RANGES = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("len", T.LongType())]))
#: Blocks that one task of a sweep folds at a time, where the caller gives no other number.
RANGE_BLOCKS = 1 << 17


class Covered:
    """Which blocks the claims so far hold, asked from left to right: an interval set of which the past is forgotten."""

    def __init__(self):
        self.ahead: list[tuple[int, int]] = []
        self.end = 0

    def add(self, pos: int, length: int) -> None:
        if length > 0:
            heapq.heappush(self.ahead, (pos, pos + length))

    def free(self, block: int) -> int:
        """The first block at or after this one that no claim holds."""
        at = block
        while True:
            while self.ahead and self.ahead[0][0] <= at:
                self.end = max(self.end, heapq.heappop(self.ahead)[1])
            if at >= self.end:
                return at
            at = self.end


def fold_claims(rows: DataFrame, key: str, opened, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """key, block, start, ranges, extra of the rows that own blocks. Input: key, block (no nulls), arg (of any type).

    Left to right, ``step(arg, block, covered)`` says of each row whether it counts: nothing, or (start, claimed ranges
    (pos, len), extra). ``opened()`` is a context manager, entered once per task, that gives the step. What a row claims
    holds blocks behind it, in any number of ranges, and ranges behind its own block only: what lies before is decided.

    Every source is cut into parts of ``range_blocks`` blocks. Parts are folded in parallel, first as if nothing reached
    into them; those that ranges of earlier parts do reach into are folded again with these, until nothing
    changes. A part depends on those before it only, so there are never more rounds than parts; claims that are no longer than a part
    need two as a rule. Null keys are one source; rows of one block are taken in the order of ``arg``.
    """
    size = range_blocks
    dealt = rows.select(F.col(key).alias("k_"), F.expr(f"block div {size}").alias("part_"), "block", "arg")
    kind, arg = dealt.schema["k_"].dataType, dealt.schema["arg"].dataType
    schema = T.StructType([T.StructField("k_", kind), T.StructField("part_", T.LongType()), T.StructField("block", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ranges", RANGES), T.StructField("extra", T.LongType())])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, covered = None, Covered()
        with opened() as step:
            for b in batches:
                out = []
                for k, part, looked_at, block, length, own in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if (k, part) != now:
                        now, covered = (k, part), Covered()
                    if not looked_at:
                        covered.add(block, length)
                        continue
                    found = step(own, block, covered)
                    if found:
                        for pos, n in found[1]:
                            covered.add(pos, n)
                        out.append((k, part, block, found[0], [{"pos": p, "len": n} for p, n in found[1]], found[2]))
                cols = list(zip(*out, strict=True)) or [()] * len(arrow)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    def folded(rows: DataFrame, entries: DataFrame | None) -> DataFrame:
        both = rows.select("k_", "part_", F.lit(True).alias("looked_at"), "block", F.lit(0).cast("long").alias("len"), "arg")
        if entries is not None:
            both = both.unionByName(entries.select("k_", "part_", F.lit(False).alias("looked_at"), F.col("pos").alias("block"), "len", F.lit(None).cast(arg).alias("arg")))
        return both.repartition("k_", "part_").sortWithinPartitions("k_", "part_", "looked_at", "block", "arg").mapInArrow(fold, schema)

    def same(x: DataFrame, y: DataFrame):
        return x["k_"].eqNullSafe(y["k_"]) & (x["part_"] == y["part_"])

    last = dealt.groupBy("k_").agg(F.max("part_").alias("last_"))
    state, before = checkpoint(folded(dealt, None)), None
    while True:
        claim = state.select("k_", "part_", F.explode("ranges").alias("r")).select("k_", "part_", F.col("r.pos").alias("pos"), (F.col("r.pos") + F.col("r.len")).alias("end"))
        first = F.greatest(F.col("part_") + 1, F.expr(f"pos div {size}"))
        reach = claim.where(F.col("end") > (F.col("part_") + 1) * size).join(last, claim["k_"].eqNullSafe(last["k_"])).select(claim["k_"], "pos", "end", first.alias("first_"), F.least(F.expr(f"(end - 1) div {size}"), "last_").alias("last_"))
        cut = reach.where("first_ <= last_").select("k_", "pos", "end", F.explode(F.sequence("first_", "last_")).alias("part_"))
        low, high = F.greatest("pos", F.col("part_") * size), F.least("end", (F.col("part_") + 1) * size)
        merged = merge_claims(cut.select(F.struct("k_", "part_").alias("at_"), low.alias("pos"), (high - low).alias("len")), "at_")
        entries = checkpoint(merged.select("at_.k_", "at_.part_", "pos", "len"))
        changed = entries if before is None else entries.exceptAll(before).unionAll(before.exceptAll(entries))
        changed = checkpoint(changed.select("k_", "part_").distinct())
        if changed.isEmpty():
            return state.select(F.col("k_").alias(key), "block", "start", "ranges", "extra")
        again = folded(dealt.join(changed, same(dealt, changed), "left_semi"), entries.join(changed, same(entries, changed), "left_semi"))
        state, before = checkpoint(state.join(changed, same(state, changed), "left_anti").unionByName(again)), entries


#: Name of the key where all rows are of one source.
ONE = "source_"


def accept_sweep(df: DataFrame, key: str, range_blocks: int = RANGE_BLOCKS) -> DataFrame:
    """key, block, start: the blocks kept by the ordered sweep. Input: key, block, constant, and claim_end (exclusive) or
    ``ranges`` (array of pos, len; null claims nothing).

    Left to right, a block is kept unless the claim of a kept block holds it; a constant run (``claim_end`` is its end) begins
    at the first block that no claim holds, and is dropped if that lies behind it.
    """
    own = [c for c in ("claim_end", "ranges") if c in df.columns]
    rows = df.where("block is not null").select(key, F.col("block").cast("long").alias("block"), "constant", *[F.col(c).cast("long" if c == "claim_end" else RANGES).alias(c) for c in own])
    rows = rows.withColumn("of", F.lit(-1).cast("long"))
    if "claim_end" in own:  # runs are cut at the borders of parts: nothing inside a run counts, so each piece is settled in its own part
        long_ = F.col("constant") & (F.col("claim_end") > F.col("block"))
        part = F.explode(F.sequence(F.expr(f"block div {range_blocks}"), F.expr(f"(claim_end - 1) div {range_blocks}")))
        cut = rows.where(long_).withColumn("part", part).withColumn("of", F.col("block")).withColumn("block", F.greatest("block", F.col("part") * range_blocks))
        cut = cut.withColumn("claim_end", F.least("claim_end", (F.col("part") + 1) * range_blocks)).drop("part")
        rows = rows.where(~F.coalesce(long_, F.lit(False))).unionByName(cut)
    begun = (F.col("of") >= 0) & (F.col("of") < F.col("block"))  # pieces of a run that began before go first
    rows = rows.select(key, "block", F.struct((~begun).alias("begins"), "constant", "of", *own).alias("arg"))

    @contextmanager
    def opened():
        def step(arg, block: int, covered: Covered):
            start, end = covered.free(block), arg.get("claim_end")
            if start != block and not (arg["constant"] and end is not None and end > start):
                return None
            if arg.get("ranges") is not None:
                return start, [(r["pos"], r["len"]) for r in arg["ranges"] if r["len"] > 0], arg["of"]
            return start, [(start, end - start)] if end is not None and end > start else [], arg["of"]

        yield step

    kept = fold_claims(rows, key, opened, range_blocks)
    whole = kept.where("extra >= 0").groupBy(key, F.col("extra").alias("block")).agg(F.min("start").alias("start"))
    return kept.where("extra < 0").select(key, "block", "start").unionByName(whole)


def emit_blocks(accepted: DataFrame, claims: DataFrame, key: str, owner: str) -> DataFrame:
    """One row per block: an accepted block shows itself, any other claimed block its owner."""
    own = accepted.select(key, "block", F.col("block").alias(owner), F.lit(False).alias("continued"))
    more = first_writer(claims.withColumn("order_", F.col(owner)), key, owner, "order_").join(accepted.select(key, "block"), [key, "block"], "left_anti")
    return own.unionByName(more.select(key, "block", owner, F.lit(True).alias("continued")))
