"""Following pointers: allocation chains, directory trees and chains of boot records, as joins in rounds.

Nothing is walked step by step in one task: chains are ranked by doubling (each round joins the places reached so far
with a table of jumps twice as long), trees and record chains grow by one level in each round, all sources at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.classifiers.mbr import EXTENDED
from strata.session import checkpoint


def little_endian(data: Column, at: Column | int, size: int = 4) -> Column:
    """An unsigned integer of up to seven bytes at a place of a binary; null where the binary ends before."""
    part = F.substring(data, (F.lit(at) if isinstance(at, int) else at) + 1, F.lit(size))
    h = F.hex(part)
    return F.when(F.octet_length(part) == size, F.conv(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(size))]), 16, 10).cast("long"))


def table_links(tables: DataFrame, key: str, part: str, table: str) -> DataFrame:
    """key, node, next of allocation tables of 32-bit entries. Input: one row per sector of the table with its place among them."""
    n = F.expr(f"octet_length({table}) div 4")
    rows = tables.where(n > 0).select(key, (F.col(part) * n).alias("first_"), table, F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("i_"))
    return rows.select(key, (F.col("first_") + F.col("i_")).cast("long").alias("node"), little_endian(F.col(table), F.col("i_") * 4).alias("next"))


def follow(links: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """key, start, rank (from 0), node: the nodes of the chain that begins at each start, in order.

    ``links`` has key, node (unique in its key), next; a next that is no node ends a chain, and so does one that the chain has
    visited. Chains may share their ends; a start that is no node has no chain; repeated starts count once. After k rounds the first 2^k nodes are known, so rounds grow with
    the logarithm of the longest chain.
    """
    jump = checkpoint(links.select(F.col(key).alias("k_"), F.col("node").alias("from_"), F.col("next").alias("to_")))
    nodes = jump.select(F.col("k_").alias("n_k_"), F.col("from_").alias("n_"))

    def sound(df: DataFrame, column: str) -> DataFrame:
        return df.join(nodes, F.col("k_").eqNullSafe(F.col("n_k_")) & (F.col(column) == F.col("n_")), "left_semi")

    jump = checkpoint(sound(jump, "to_"))
    found = checkpoint(sound(starts.select(F.col(key).alias("k_"), "start").distinct().withColumn("rank", F.lit(0).cast("long")).withColumn("node", F.col("start")), "node"))
    step, n = 1, found.count()
    while True:
        j = jump.select(F.col("k_").alias("j_k_"), "from_", "to_")
        more = found.join(j, F.col("k_").eqNullSafe(F.col("j_k_")) & (F.col("node") == F.col("from_"))).select("k_", "start", (F.col("rank") + step).alias("rank"), F.col("to_").alias("node"))
        found = checkpoint(found.unionByName(more).groupBy("k_", "start", "node").agg(F.min("rank").alias("rank")))
        now = found.count()
        if now == n:
            return found.select(F.col("k_").alias(key), "start", "rank", "node")
        n, step = now, step * 2
        again = jump.select(F.col("k_").alias("a_k_"), F.col("from_").alias("mid_"), F.col("to_").alias("far_"))
        jump = checkpoint(jump.join(again, F.col("k_").eqNullSafe(F.col("a_k_")) & (F.col("to_") == F.col("mid_"))).select("k_", "from_", F.col("far_").alias("to_")))


def directory_paths(entries: DataFrame, key: str, root: int = 0) -> DataFrame:
    """key, entry, path, kind of what the tree under each source's root entry holds; the root itself has no row.

    ``entries`` has key, entry (unique in its key), name, kind (1: holds others, 2: a stream), left, right, child. Siblings form a
    binary tree by left and right, ``child`` is the top one of those in a directory. An entry that is reached again, by a loop or twice, counts once:
    by the first round, then the least path.
    """
    rows = checkpoint(entries.select(F.col(key).alias("k_"), "entry", "name", "kind", "left", "right", "child"))
    wave = rows.where(F.col("entry") == root).select("k_", F.col("child").alias("at_"), F.lit("").alias("up_"))
    found = None
    while True:
        reached = wave.where("at_ is not null").groupBy(F.col("k_").alias("w_k_"), "at_").agg(F.min("up_").alias("up_"))
        new = reached.join(rows, F.col("k_").eqNullSafe(F.col("w_k_")) & (F.col("entry") == F.col("at_"))).where(F.col("entry") != root)
        new = new.select("k_", "entry", F.concat("up_", F.coalesce("name", F.lit(""))).alias("path"), "kind", "left", "right", "child", "up_")
        if found is not None:
            old = found.select(F.col("k_").alias("o_k_"), F.col("entry").alias("o_"))
            new = new.join(old, F.col("k_").eqNullSafe(F.col("o_k_")) & (F.col("entry") == F.col("o_")), "left_anti")
        new = checkpoint(new)
        if new.isEmpty():
            told = new if found is None else found
            return told.select(F.col("k_").alias(key), "entry", "path", "kind")
        found = new.select("k_", "entry", "path", "kind") if found is None else found.unionByName(new.select("k_", "entry", "path", "kind"))
        inner = F.when(F.col("kind") == 1, F.struct(F.col("child").alias("at_"), F.concat("path", F.lit("/")).alias("up_")))
        wave = new.select("k_", F.explode(F.array(F.struct(F.col("left").alias("at_"), "up_"), F.struct(F.col("right").alias("at_"), "up_"), inner)).alias("w")).where("w is not null").select("k_", "w.at_", "w.up_")


def boot_entries(sector: Column) -> Column:
    """The four entries of a boot record: boot, kind, chs_first, chs_last (packed), first, sectors."""

    def one(i: int) -> Column:
        byte = lambda k: little_endian(sector, 446 + 16 * i + k, 1)
        chs = lambda k: F.shiftleft(byte(k + 2).bitwiseOR(F.shiftleft(byte(k + 1).bitwiseAND(0xC0), 2)), 14).bitwiseOR(F.shiftleft(byte(k), 6)).bitwiseOR(byte(k + 1).bitwiseAND(0x3F))
        return F.struct(byte(0).alias("boot"), byte(4).alias("kind"), chs(1).alias("chs_first"), chs(5).alias("chs_last"), little_endian(sector, 446 + 16 * i + 8).alias("first"), little_endian(sector, 446 + 16 * i + 12).alias("sectors"))

    return F.array(*[one(i) for i in range(4)])


def is_empty(e: Column) -> Column:
    """Every byte of the entry is 0."""
    return (e["boot"] == 0) & (e["kind"] == 0) & (e["chs_first"] == 0) & (e["chs_last"] == 0) & (e["first"] == 0) & (e["sectors"] == 0)


def is_valid(e: Column) -> Column:
    """Empty, or of a known boot flag and with cylinders, heads and sectors in order."""
    return is_empty(e) | (e["boot"].isin(0, 0x80) & (e["chs_last"] >= e["chs_first"]))


def partition_chain(sectors: DataFrame, key: str) -> DataFrame:
    """key, record, level, slot, place, kind, start, sectors of the partitions that boot records (sector 0 of each source) and
    their extended records tell; ``place`` is the sector of the record, ``start`` that of the partition in the source.

    ``sectors`` has key, sector (unique in its key), data (512 bytes). Sources whose record has no magic, no entry or an invalid one
    have no rows; a chain ends at a record without magic, one that was seen, or a link that is no extended entry.
    """
    magic = F.hex(F.substring("data", 511, 2)) == "55AA"
    records = sectors.where(magic).select(F.col(key).alias("k_"), F.col("sector").alias("at_"), boot_entries(F.col("data")).alias("e_"))
    records = checkpoint(records)
    level = records.where("at_ = 0").where(F.forall("e_", is_valid) & F.exists("e_", lambda e: ~is_empty(e))).select("k_", F.lit(0).cast("long").alias("base"), "at_", "e_", F.lit(0).alias("slots"))
    found, seen, depth = None, None, 0
    while True:
        rows = level.select("k_", "base", "at_", F.posexplode("e_" if depth == 0 else F.slice("e_", 1, 1)).alias("slot", "e")).where(~is_empty(F.col("e")))
        rows = rows.select("k_", F.col("base").alias("record"), F.lit(depth).alias("level"), "slot", F.col("at_").alias("place"), "e.kind", (F.col("at_") + F.col("e.first")).alias("start"), "e.sectors")
        found = rows if found is None else found.unionByName(rows)
        links = level.select("k_", "base", "at_", F.explode("e_" if depth == 0 else F.slice("e_", 2, 1)).alias("e")).where(F.col("e.kind").isin(*EXTENDED))
        base = F.col("e.first") if depth == 0 else F.col("base")
        to = links.select(F.col("k_").alias("l_k_"), base.alias("base"), (F.col("e.first") if depth == 0 else F.col("base") + F.col("e.first")).alias("to_"))
        level = to.join(records, F.col("k_").eqNullSafe(F.col("l_k_")) & (F.col("at_") == F.col("to_"))).select("k_", "base", "at_", "e_").distinct()
        if seen is not None:
            old = seen.select(F.col("k_").alias("s_k_"), F.col("base").alias("s_b_"), F.col("at_").alias("s_"))
            level = level.join(old, F.col("k_").eqNullSafe(F.col("s_k_")) & (F.col("base") == F.col("s_b_")) & (F.col("at_") == F.col("s_")), "left_anti")
        level = checkpoint(level)
        if level.isEmpty():
            return found.withColumnRenamed("k_", key)
        own = level.select("k_", "base", "at_")
        seen, depth = own if seen is None else seen.unionByName(own), depth + 1
