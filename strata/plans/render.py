"""Rendering: nested descriptions, one line per block, one line per identified item."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.session import checkpoint


def nested_text(items: DataFrame, max_depth: int, every: bool = False) -> DataFrame:
    """node, shown: ``PDF-(TEXT ZLIB-(TEXT))``, of the items of depth 0 or of ``every`` one. Input: node, parent, depth, ord, brief, confidence.

    Items of no positive confidence are left out with all below them. Siblings are equal if their whole
    descriptions before collapsing are; the first of them stays. One round per level, deepest first.
    """
    own = items.where("confidence > 0")
    below = found = None
    for depth in range(max_depth, -1, -1):
        level = own.where(F.col("depth") == depth)
        if below is None:
            done = level.select("node", "parent", "ord", F.col("brief").alias("full"), F.col("brief").alias("shown"))
        else:
            first = below.groupBy("parent", "full").agg(F.min(F.struct("ord", "shown")).alias("m"))
            text = lambda c: F.concat(F.lit("-("), F.array_join(F.transform(F.array_sort(c), lambda x: x["t"]), " "), F.lit(")"))
            shown = first.groupBy("parent").agg(text(F.collect_list(F.struct(F.col("m.ord").alias("o"), F.col("m.shown").alias("t")))).alias("s"))
            full = below.groupBy("parent").agg(text(F.collect_list(F.struct(F.col("ord").alias("o"), F.col("full").alias("t")))).alias("f"))
            kids = shown.join(full, "parent").withColumnRenamed("parent", "of_")
            done = level.join(kids, level["node"] == kids["of_"], "left").select(
                "node", "parent", "ord", F.concat("brief", F.coalesce("f", F.lit(""))).alias("full"), F.concat("brief", F.coalesce("s", F.lit(""))).alias("shown")
            )
        below = checkpoint(done)
        found = below if found is None or not every else found.unionByName(below)
    return found.select("node", "shown")


def block_lines_column():
    """One line from the columns offset (bytes), brief, description, path, owner_offset (null if the block is its own)."""
    own = F.format_string("%13d %-12s # %s Path:%s", F.col("offset"), F.col("brief"), F.coalesce("description", F.lit("")), F.coalesce("path", F.lit("")))
    more = F.format_string("%13d %-12s # Continuation of data starting at block %d", F.col("offset"), F.col("brief"), F.col("owner_offset"))
    return F.when(F.col("owner_offset").isNull(), own).otherwise(more)


def block_lines(blocks: DataFrame) -> DataFrame:
    """offset, line of the rows that ``block_lines_column`` describes."""
    return blocks.select("offset", block_lines_column().alias("line"))


def with_header(lines: DataFrame, title: str) -> DataFrame:
    """The lines (offset, line) with a title and the names of the columns before them."""
    spark = lines.sparkSession
    head = spark.createDataFrame([(-2, title), (-1, "%13s %s" % ("Offset", "Description"))], "offset long, line string")
    return head.unionByName(lines.select(F.col("offset").cast("long").alias("offset"), "line"))


def tree_lines(items: DataFrame) -> DataFrame:
    """path, line: every item with its confidence, indented by depth; ordered by path they show the tree."""
    shown = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.format_string("%s (%d)", F.coalesce("brief", F.lit("?")), F.coalesce("confidence", F.lit(-1))))
    return items.select("path", shown.alias("line"))


def path_lines(items: DataFrame) -> DataFrame:
    """line per positively identified item; -1 where its place in the source is not known."""
    place = F.coalesce("abs_off", F.lit(-1).cast("long"))
    return items.where("confidence > 0").select("path", F.format_string("%d %s # %s Path:%s", place, F.col("brief"), F.coalesce("description", F.lit("")), F.col("path")).alias("line"))


def write_lines(lines: DataFrame, path: str, order: str = "offset") -> None:
    """Ordered text; the ranges of ``order`` are written by as many tasks as there are partitions, in order of their names."""
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.text(path)
