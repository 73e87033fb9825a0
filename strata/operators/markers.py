"""End markers of formats: where they are, and which one comes next.

All places of the markers are found once, while the blocks are detected, as a sorted relation; a candidate gets the
next ones at or behind its place by an as-of join. So nothing has to be read just to find out where it might end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.functions.types import BY_NAME
from strata.session import checkpoint

#: marker, bytes (fixed values)
MARKERS = {"pdf": b"%%EOF", "zip": b"PK\x05\x06", "jpg": b"\xff\xd9", "png": b"IEND"}
BIN_BYTES = 1 << 24


def places(window: Column, marker: bytes, block_size: int) -> Column:
    """Array of the places (from 0) at which the marker begins in the first ``block_size`` bytes; null for a null window.

    The window reaches over the block's end, so a marker that crosses it is found where it begins.
    """
    near = F.decode(F.substring(window, 1, block_size + len(marker) - 1), "ISO-8859-1")  # a character is a byte
    escaped = "".join(re.escape(chr(b)) if b < 128 else chr(b) for b in marker)
    sizes = F.transform(F.split(near, escaped), lambda x: F.length(x))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n + F.lit(len(marker)))))
    return F.transform(F.slice(ends, F.lit(2), F.size(ends) - 2), lambda x: x - F.lit(len(marker)))


def marked(window: Column, block_size: int = 512) -> Column:
    """Array of (marker, place from the block's beginning) of all end markers that begin in a block."""
    one = lambda name, b: F.transform(F.coalesce(places(window, b, block_size), F.array().cast("array<int>")), lambda at: F.struct(F.lit(name).alias("marker"), at.alias("at")))
    return F.concat(*[F.when(F.contains(window, F.lit(b)), one(name, b)).otherwise(F.array().cast("array<struct<marker:string,at:int>>")) for name, b in MARKERS.items()])


def end_markers(blocks: DataFrame, key: str, block_size: int = 512) -> DataFrame:
    """key, marker, pos (byte of the source) of all end markers. Input: key, block, and window (block and look-ahead) or ``marks`` (``marked`` of it)."""
    marks = F.col("marks") if "marks" in blocks.columns else marked(F.col("window"), block_size)
    each = blocks.select(key, "block", F.explode(marks).alias("m"))
    return each.select(key, F.col("m.marker").alias("marker"), (F.col("m.at") + F.col("block") * block_size).cast("long").alias("pos"))


def next_markers(candidates: DataFrame, markers: DataFrame, key: str, bin_bytes: int = BIN_BYTES) -> DataFrame:
    """The candidates (key, marker, pos, further columns) with ``end``: the least place of their marker at or behind ``pos``, null if there is none.

    An as-of join in two steps: inside bins of ``bin_bytes`` by a window over candidates and markers in order, and over
    the bins, of which only the first marker counts. So no task holds more than a bin, or one row for each bin of a source.
    """
    names = [c for c in candidates.columns if c not in (key, "marker", "pos")]
    both = candidates.select(key, "marker", "pos", F.lit(None).cast("long").alias("mark_"), F.struct(*names, F.lit(0).alias("c_")).alias("own_")).unionByName(
        markers.select(key, "marker", "pos", F.col("pos").alias("mark_")), allowMissingColumns=True
    )
    both = both.withColumn("bin_", F.expr(f"pos div {bin_bytes}"))
    here = Window.partitionBy(key, "marker", "bin_").orderBy("pos", F.col("mark_").isNull().desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    near = both.withColumn("near_", F.min("mark_").over(here)).where("own_ is not null")
    bins = markers.groupBy(key, "marker", F.expr(f"pos div {bin_bytes}").alias("bin_")).agg(F.min("pos").alias("first_"))
    asked = near.where("near_ is null").select(key, "marker", "bin_").distinct()
    along = asked.withColumn("first_", F.lit(None).cast("long")).unionByName(bins).groupBy(key, "marker", "bin_").agg(F.min("first_").alias("first_"))
    later = Window.partitionBy(key, "marker").orderBy("bin_").rowsBetween(1, Window.unboundedFollowing)
    after = along.withColumn("after_", F.min("first_").over(later)).where("after_ is not null").select(F.col(key).alias("k_"), F.col("marker").alias("m_"), F.col("bin_").alias("b_"), "after_")
    met = near.join(after, near[key].eqNullSafe(after["k_"]) & (near["marker"] == after["m_"]) & (near["bin_"] == after["b_"]), "left")
    return met.select(key, "marker", "pos", *[F.col(f"own_.{c}").alias(c) for c in names], F.coalesce("near_", "after_").alias("end"))


#: Type code to the marker that ends it.
ENDED_BY = {BY_NAME["PDF"]: "pdf", BY_NAME["ZIP"]: "zip", BY_NAME["JPG"]: "jpg", BY_NAME["PNG"]: "png"}


def with_ends(candidates: DataFrame, marks: DataFrame, key: str, block_size: int) -> DataFrame:
    """The candidates (key, block, types) with ``ends``: the next two places at which an end marker of one of their types
    begins, in order (fewer where there are no more); null for types without markers."""
    kinds = F.create_map(*[F.lit(x) for pair in ENDED_BY.items() for x in pair])
    asked = candidates.select(key, "block", F.explode(F.array_distinct(F.filter(F.transform("types", lambda t: kinds[t]), lambda m: m.isNotNull()))).alias("marker"))
    first = checkpoint(next_markers(asked.select(key, "marker", (F.col("block") * block_size).alias("pos"), "block"), marks, key))
    second = next_markers(first.where(F.col("end").isNotNull()).select(key, "marker", (F.col("end") + 1).alias("pos"), "block"), marks, key)
    ends = first.select(key, "block", "end").unionByName(second.select(key, "block", "end")).groupBy(key, "block").agg(F.sort_array(F.collect_set("end")).alias("ends"))
    return candidates.join(ends, [key, "block"], "left")
