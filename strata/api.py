"""``classify``: what every block of a file holds."""

from __future__ import annotations

import os
import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import config
from strata.functions import magic, text
from strata.functions.types import BY_NAME
from strata.operators import claims, expand, markers
from strata.operators.classifiers import MAX_DEPTH, VIEWED, Limits, Registry, Verdict, ask, registry
from strata.plans import render
from strata.session import checkpoint
from strata.sources import blocks as source
from strata.sources.views import Extents, Reader

#: Bytes of a root item that its classifier may see (fixed value: the most that a text may have); bounds a row, whatever
#: follows in the file. Classifiers that take views read what they need of the rest of the file.
MAX_ITEM = 104_857_600
#: Bytes that a classifier sees first; it is asked again with four times as much until the item's end lies inside.
HEAD = 4096
#: Classifiers whose refusal of the first bytes stands, whatever follows.
FIRM = {"zlib", "video", "compression", "partitiontable", "sleuth", "jbig", "text"}
#: Classifiers of formats with end markers, and bytes that are read behind a marker (a comment, a trailer).
ENDED = {"pdf", "compression", "image"}
AHEAD = 1 << 20
PRINTABLE = re.compile(text.PRINTABLE.encode())


def text_span(data: bytes) -> Verdict | None:
    """How far a text reaches. Every kind of text that the cascade gives has a confidence of 50 or more."""
    n = PRINTABLE.match(data).end()
    return Verdict("text", 100, "TEXT", "", n) if n >= text.MIN_TEXT else None


def _settled(v: Verdict, data: bytes) -> bool:
    """More bytes behind the data would not change the verdict."""
    if v.classifier == "zlib":
        return v.confidence == 100
    if v.classifier == "pdf":
        return data.count(b"%%EOF") > 1
    by_header = (v.classifier == "video" and "MP3" not in v.brief) or (v.classifier == "sleuth" and not v.length)
    return by_header or 0 < v.length < len(data)


def steps(at: int, max_item: int, ends: list[int] | None):
    """Numbers of bytes to try in turn: four times as many each, but up to behind the next end markers where there are such.

    No more than ``AHEAD`` bytes are tried where no (further) marker follows.
    """
    n = min(HEAD, max_item)
    yield n
    if ends is not None:
        for end in ends:
            if end - at >= max_item:
                return
            if end - at + AHEAD > n:
                n = min(max_item, end - at + AHEAD)
                yield n
        if len(ends) < 2:
            if n < AHEAD:
                yield min(AHEAD, max_item)
            return
    while n < max_item:
        n = min(max_item, n * 4)
        yield n


def span_at(reader: Reader, at: int, names: list[str], max_item: int, limits: Limits, reg: Registry | None = None, ends: list[int] | None = None) -> tuple[Verdict, int] | None:
    """The verdict on what begins at a place, and the bytes that it takes to give it; a weak one only without others. ``ends``: see ``markers.with_ends``."""
    chance = None
    for name in names:
        for n in steps(at, max_item, ends if name in ENDED else None):
            data = reader.read(at, n)
            whole = Extents(reader, [(at, reader.size - at)]) if name in VIEWED else None
            v = ask([name], data, {"text": text_span}, limits, None, reg, whole)
            if whole or n == max_item or at + len(data) >= reader.size or (name in FIRM if v is None else _settled(v, data)):
                break
        if v is not None and v.confidence > 0:
            if not v.weak:
                return v, len(data)
            chance = chance or (v, len(data))
    return chance


def claimed(v: Verdict, block: int, block_size: int, blocks: int) -> list[tuple[int, int]]:
    """Ranges (pos, len) of blocks that an item at a block claims: those whose first bytes it is made of, and its own block."""
    if not v.ranges:
        return [(block, max(1, -(-v.length // block_size)))]
    spans, out = {(block, block + 1)}, []
    for offset, n in v.ranges:
        first, last = block + -(-offset // block_size), block + (offset + n - 1) // block_size
        if block <= first <= last:
            spans.add((first, min(last + 1, blocks)))
    for first, end in sorted(x for x in spans if x[0] < x[1]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return [(first, end - first) for first, end in out]


def root_items(
    candidates: DataFrame, path: str, block_size: int, max_item: int, limits: Limits, thresholds: dict[str, int] | None, range_blocks: int, reg: Registry | None = None
) -> DataFrame:
    """block, claim_end (exclusive, of the range that the item's block is in), ranges, n_bytes (those that its classifier
    takes; -1: it takes a view) of the items that own blocks. Input: block, types, and maybe ends. See ``claims.fold_claims``."""
    size, reg = os.path.getsize(path), registry(reg, thresholds)
    blocks = -(-size // block_size)

    @contextmanager
    def opened():
        with open(path, "rb") as f:
            reader = Reader(f, size)

            def step(arg, block: int, covered: claims.Covered):
                if covered.free(block) != block:
                    return None
                found = span_at(reader, block * block_size, reg.asked(arg["types"]), max_item, limits, reg, arg["ends"])
                if not found:
                    return None
                return block, claimed(found[0], block, block_size, blocks), -1 if found[0].classifier in VIEWED else found[1]

            yield step

    ends = F.col("ends") if "ends" in candidates.columns else F.lit(None).cast("array<bigint>").alias("ends")
    rows = candidates.select(F.lit(path).alias(claims.ONE), "block", F.struct("types", ends).alias("arg"))
    kept = claims.fold_claims(rows, claims.ONE, opened, range_blocks)
    own = F.filter("ranges", lambda r: (r["pos"] <= F.col("block")) & (r["pos"] + r["len"] > F.col("block")))[0]
    return kept.select("block", (own["pos"] + own["len"]).alias("claim_end"), "ranges", F.col("extra").alias("n_bytes"))


def constant_runs(seen: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """block, claim_end of the runs of equal constant blocks; without the blocks that items claim, if they are given.

    Input: block and fill (what the block repeats, null if it is none); block and claim_end of the items' claims.
    """
    single = seen.where("fill is not null").select("fill", F.col("block").alias("pos"), F.lit(1).cast("long").alias("len"))
    runs = claims.merge_claims(single, "fill").select(F.col("pos").alias("block"), (F.col("pos") + F.col("len")).alias("claim_end"))
    if items is None:
        return runs
    both = [x.select(F.lit(0).alias("k"), F.lit(w).alias("w"), F.col("block").alias("pos"), (F.col("claim_end") - F.col("block")).alias("len")) for w, x in enumerate((items, runs))]
    owned = claims.owned_fragments(both[0].unionByName(both[1]).withColumn("o", F.col("w")), "k", "w", "o").where("w = 1")
    # runs of two fills may touch: their borders count
    cut = claims.binned(owned, claims.BIN).select("bin_", "pos", "len")
    parts = claims.binned(runs.select(F.col("block").alias("rpos"), F.col("block").alias("pos"), (F.col("claim_end") - F.col("block")).alias("len"))).select("bin_", F.col("pos").alias("a"), (F.col("pos") + F.col("len")).alias("b"))
    met = parts.join(cut, "bin_").where("a < pos + len and pos < b")
    return met.select(F.greatest("a", "pos").alias("block"), F.least("b", F.col("pos") + F.col("len")).alias("claim_end")).distinct()


def classify(
    spark: SparkSession, path: str, block_size: int = 512, start_block: int = 0, style: int = 0, max_item: int = MAX_ITEM,
    limits: Limits = Limits(), thresholds: dict[str, int] | None = None, range_blocks: int | None = None, reg: Registry | None = None, max_depth: int = MAX_DEPTH,  # noqa: B008  frozen
) -> DataFrame:
    """Lines of the report: style 0 one per block, style 1 one per identified item, style 2 one per item and constant run.

    Only blocks whose signatures a classifier of the registry claims and that no item before them holds are looked at, each with as
    many bytes as its end needs; constant blocks are settled by detection. Items that own blocks are classified and
    unfolded, and every block is shown with its owner: items and constant runs own what nothing before them claims. Members of an item that lie in
    the file as they are have lines at their own blocks. An item that ``max_item`` bytes do not hold says TRUNCATED.
    """
    source.register(spark)
    reg = registry(reg, thresholds)
    size = os.path.getsize(path)
    scanned = spark.read.format("blocks").option("path", path).option("blockSize", block_size).option("startBlock", start_block).load()
    constant = F.col("types") == F.array(F.lit(BY_NAME["CONSTANT"]))  # a text of one letter is a text
    seen = scanned.select("block", magic.detect(F.col("window"), block_size).alias("types"), F.hex(F.substring("window", 1, 4)).alias("fill"), markers.marked(F.col("window"), block_size).alias("marks"))
    seen = checkpoint(seen.withColumn("fill", F.when(constant, F.col("fill"))))
    wanted = sorted({t for _, t, _, _ in reg.rows()} - {BY_NAME["UNIDENTIFIED"], BY_NAME["CONSTANT"]})
    candidates = seen.where(F.arrays_overlap("types", F.array(*[F.lit(t) for t in wanted])) & ~constant)
    ended = markers.with_ends(candidates.select(F.lit(path).alias(claims.ONE), "block", "types"), markers.end_markers(seen.select(F.lit(path).alias(claims.ONE), "block", "marks"), claims.ONE, block_size), claims.ONE, block_size)
    kept = checkpoint(root_items(ended, path, block_size, max_item, limits, None, range_blocks or max(1, max_item // block_size), reg))
    offset = F.col("block") * block_size
    extent = F.array(F.struct(offset.alias("pos"), F.when(F.col("n_bytes") < 0, size - offset).otherwise(F.col("n_bytes")).alias("len")))
    placed = kept.select("block", F.lit(None).cast("binary").alias("payload"), extent.alias("extents"), F.when(F.col("n_bytes") < 0, HEAD).otherwise(F.col("n_bytes")).cast("long").alias("take"))
    items = expand.roots(placed, "block", "payload", "extents", "take")
    found = checkpoint(expand.expand(items, max_depth, limits, None, reg, path))
    top = found.where("depth = 0 and confidence > 0").select(F.col("root").alias("block"), "length", "brief", "description", "path", "confidence")
    whole = kept.select("block", (F.col("n_bytes") == max_item).alias("full"))
    bounded = F.col("full") & ((F.col("length") == 0) | (F.col("length") >= max_item)) & ~F.contains("description", F.lit("TRUNCATED"))
    owners = checkpoint(top.join(whole, "block").withColumn("description", F.when(bounded, F.concat("description", F.lit(" TRUNCATED"))).otherwise(F.col("description"))))
    if style == 1:
        marked = found.join(owners.select("path", F.col("description").alias("own")), "path", "left")
        return render.path_lines(marked.select("path", "brief", F.coalesce("own", "description").alias("description"), "confidence", "abs_off")).orderBy("path")
    # who owns which blocks: items by their ranges and constant runs, in the order of their first blocks
    of_items = kept.join(owners.select("block"), "block").select("block", F.lit(0).alias("constant"), F.explode("ranges").alias("r")).select("block", "constant", "r.pos", "r.len")
    of_runs = constant_runs(seen).select("block", F.lit(1).alias("constant"), F.col("block").alias("pos"), (F.col("claim_end") - F.col("block")).alias("len"))
    fragments = of_items.unionByName(of_runs).select(F.lit(path).alias("source"), (F.col("block") * 2 + F.col("constant")).alias("w"), F.col("block").alias("order"), "pos", "len")
    fragments = checkpoint(claims.owned_fragments(fragments, "source", "w", "order").select("source", F.expr("w div 2").alias("owner"), (F.col("w") % 2 == 1).alias("constant"), "pos", "len"))
    if style == 2:
        of_items = fragments.where("not constant").groupBy("owner").agg(F.sum("len").alias("len")).join(owners.select(F.col("block").alias("owner"), "brief"), "owner").select(F.col("owner").alias("pos"), "len", "brief")
        rows = of_items.unionByName(fragments.where("constant").select("pos", "len", F.lit("Constant").alias("brief")))
        return rows.select((F.col("pos") * block_size).alias("offset"), F.format_string("%13d %-12s # %d blocks", F.col("pos") * block_size, "brief", "len").alias("line")).orderBy("offset")
    depth = found.agg(F.max("depth")).first()[0] or 0
    ordered = found.withColumn("ord", F.element_at(F.split("node", "/"), -1).cast("long"))
    shown = render.nested_text(ordered, depth, every=True).withColumnRenamed("node", "path")
    told = owners.join(shown, "path", "left").select(F.col("block").alias("owner"), F.lit(False).alias("constant"), F.coalesce("shown", "brief").alias("brief"), "description", "path")
    members = ordered.select(F.lit(path).alias("source"), "node", "parent", F.expr(f"abs_off div {block_size}").alias("block"), "ord")
    promoted = claims.promoted_members(members, "source").select("node", "block").join(ordered.select("node", "path", F.col("brief").alias("own_brief"), "description"), "node").join(shown, "path", "left")
    promoted = promoted.select("block", F.coalesce("shown", "own_brief").alias("m_brief"), F.col("description").alias("m_description"), F.col("path").alias("m_path"))
    held = claims.binned(fragments).select("bin_", "pos", "len", "owner", "constant")
    at = seen.withColumn("bin_", F.expr(f"block div {claims.BIN}"))
    mine = (at["bin_"] == held["bin_"]) & (at["block"] >= held["pos"]) & (at["block"] < held["pos"] + held["len"])
    first = F.when(F.col("constant"), F.col("pos")).otherwise(F.col("owner"))  # a run begins where nothing before it claims it
    rows = at.join(held, mine, "left").select("block", "types", "owner", "constant", first.alias("first")).join(told, ["owner", "constant"], "left").join(promoted, "block", "left").select(
        (F.col("block") * block_size).alias("offset"),
        F.coalesce("m_brief", "brief", F.when(F.col("constant") | (F.col("types") == F.array(F.lit(BY_NAME["CONSTANT"]))), "Constant").otherwise("Unidentified")).alias("brief"), F.coalesce("m_description", "description").alias("description"),
        F.coalesce("m_path", "path", F.concat(F.lit("/src/"), F.col("block").cast("string"))).alias("path"),
        F.when(F.col("m_path").isNull() & (F.col("first") != F.col("block")), F.col("first") * block_size).alias("owner_offset"),
    )
    return render.block_lines(rows).orderBy("offset")


def report(spark: SparkSession, path: str, out: str, title: str = "Contents by block", settings: dict[str, str] | None = None, **options) -> None:
    """Writes the lines of ``classify`` as ordered text; those by block begin with a title and the names of their columns.

    ``settings``: configuration as ``config.load`` gives it; ``options`` go before it.
    """
    options = (config.options(settings) if settings else {}) | options
    lines = classify(spark, path, **options)
    style = options.get("style", 0)
    render.write_lines(render.with_header(lines, title) if style == 0 else lines, out, "path" if style == 1 else "offset")
