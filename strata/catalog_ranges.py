"""Queries over ranges, items and their tree: what a block is to a set of ranges, checks, constant runs, emission."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata import api
from strata.functions.types import BY_NAME
from strata.operators import chains, claims, markers, routing
from strata.operators.classifiers import Verdict
from strata.plans import render
from strata.sources import blocks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- ranges: those of an order's line items --------------------------------------------------------------

_RANGES = "r AS (SELECT l_orderkey, CAST(l_partkey AS BIGINT) AS pos, CAST(l_quantity AS BIGINT) AS len, l_linenumber FROM lineitem)"


def _ranges(spark, d) -> DataFrame:
    rows = read(spark, d, "lineitem").select("l_orderkey", F.struct(F.col("l_partkey").cast("long").alias("pos"), F.col("l_quantity").cast("long").alias("len")).alias("r"))
    return rows.groupBy("l_orderkey").agg(F.collect_list("r").alias("ranges"))


@query(
    f"WITH {_RANGES}, b AS (SELECT o_orderkey, CAST(o_custkey % 2000 AS BIGINT) AS block FROM orders) SELECT l_orderkey, any_value(block) AS block, "
    "bool_and(block < pos) AS is_before, bool_or(block >= pos AND block < pos + len) AS is_within, bool_and(block >= pos + len) AS is_after, max(pos + len - 1) AS last_block "
    "FROM r JOIN b ON l_orderkey = o_orderkey GROUP BY l_orderkey"
)
def range_positions(spark, d):
    at = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 2000).cast("long").alias("block"))
    rows, block, ranges = _ranges(spark, d).join(at, "l_orderkey"), F.col("block"), F.col("ranges")
    return rows.select(
        "l_orderkey", "block", claims.before_ranges(block, ranges).alias("is_before"), claims.within_ranges(block, ranges).alias("is_within"),
        claims.after_ranges(block, ranges).alias("is_after"), claims.last_block(ranges).alias("last_block"),
    )


@query(f"WITH {_RANGES} SELECT a.l_orderkey, a.l_linenumber AS inner_line, b.l_linenumber AS outer_line, a.pos >= b.pos AND a.pos + a.len < b.pos + b.len AS inside FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1")
def range_within_range(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct(F.col("l_partkey").cast("long").alias("pos"), F.col("l_quantity").cast("long").alias("len")).alias("r"))
    outer = rows.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("r").alias("o"))
    found = rows.join(outer, ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", F.col("l_linenumber").alias("inner_line"), (F.col("l_linenumber") + 1).alias("outer_line"), claims.range_inside(F.col("r"), F.col("o")).alias("inside"))


@query(
    "WITH i AS (SELECT l_orderkey * 10 + l_linenumber AS item, l_orderkey * 10 + l_linenumber // 2 AS parent, CAST(l_partkey AS BIGINT) AS pos, CAST(l_quantity * 20 AS BIGINT) AS len FROM lineitem) "
    "SELECT c.item, c.parent, c.pos, c.len FROM i c JOIN i p ON c.parent = p.item WHERE c.pos < p.pos OR c.pos + c.len > p.pos + p.len"
)
def child_outside_parent(spark, d):
    key = F.col("l_orderkey") * 10
    items = read(spark, d, "lineitem").select((key + F.col("l_linenumber")).alias("item"), (key + F.expr("l_linenumber div 2")).alias("parent"), F.col("l_partkey").cast("long").alias("pos"), (F.col("l_quantity") * 20).cast("long").alias("len"))
    return claims.outside_parent(items, "item", "parent")


@query("SELECT path, arg_min(l_linenumber, k) AS l_linenumber, min(k) AS k FROM (SELECT concat(l_orderkey, '/', l_suppkey % 3) AS path, l_linenumber, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY path")
def distinct_children(spark, d):
    rows = read(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", F.col("l_suppkey") % 3).alias("path"), "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"))
    return routing.distinct_children(rows, "path", "k")


_KIND = "CASE l_linenumber % 3 WHEN 0 THEN [97] WHEN 1 THEN [1, 97] ELSE [96] END"


@query(f"WITH t AS (SELECT l_orderkey, l_linenumber, {_KIND} AS types, CAST(l_partkey % 3 - 1 AS INTEGER) AS confidence, l_suppkey % 2 + 1 AS results FROM lineitem) SELECT l_orderkey, l_linenumber, confidence <= 0 AND list_contains(types, 97) AS shown, results = 1 AND types = [97] AS prunable FROM t")
def constant_nodes(spark, d):
    types = F.expr("CASE l_linenumber % 3 WHEN 0 THEN array(97) WHEN 1 THEN array(1, 97) ELSE array(96) END")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", types.alias("types"), (F.col("l_partkey") % 3 - 1).cast("int").alias("confidence"), (F.col("l_suppkey") % 2 + 1).alias("results"))
    code = BY_NAME["CONSTANT"]
    return rows.select("l_orderkey", "l_linenumber", routing.shown_as_constant(F.col("confidence"), F.col("types"), code).alias("shown"), routing.prunable_constant(F.col("results"), F.col("types"), code).alias("prunable"))


# --- sweep with constant runs, and what is emitted -------------------------------------------------------

_SWEEP = (
    "c AS (SELECT o_custkey, CAST(o_orderkey % 1000 AS BIGINT) AS block, max(o_orderkey % 1000 + 1 + o_orderkey % 97) AS claim_end, min(o_orderkey) % 3 = 0 AS constant FROM orders GROUP BY 1, 2), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY block) AS n FROM c), "
    "k AS (SELECT o_custkey, n, block, block AS start, claim_end AS covered, true AS kept FROM r WHERE n = 1 UNION ALL "
    "SELECT r.o_custkey, r.n, r.block, greatest(r.block, k.covered), CASE WHEN r.block >= k.covered OR (r.constant AND r.claim_end > k.covered) THEN greatest(k.covered, r.claim_end) ELSE k.covered END, "
    "r.block >= k.covered OR (r.constant AND r.claim_end > k.covered) FROM k JOIN r ON r.o_custkey = k.o_custkey AND r.n = k.n + 1)"
)


def _sweep_rows(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    rows = read(spark, d, "orders").select("o_custkey", (key % 1000).cast("long").alias("block"), (key % 1000 + 1 + key % 97).alias("claim_end"), "o_orderkey")
    return rows.groupBy("o_custkey", "block").agg(F.max("claim_end").alias("claim_end"), (F.min("o_orderkey") % 3 == 0).alias("constant"))


@query(f"WITH RECURSIVE {_SWEEP} SELECT o_custkey, block, start FROM k WHERE kept")
def constant_run_split(spark, d):
    return claims.accept_sweep(_sweep_rows(spark, d), "o_custkey")


@query(
    f"WITH RECURSIVE {_SWEEP}, a AS (SELECT o_custkey, block FROM k WHERE kept), e AS (SELECT c.o_custkey, c.block AS owner, unnest(range(c.block, c.claim_end)) AS b FROM c JOIN a ON a.o_custkey = c.o_custkey AND a.block = c.block) "
    "SELECT o_custkey, block, block AS owner, false AS continued FROM a UNION ALL "
    "SELECT o_custkey, b AS block, min(owner) AS owner, true AS continued FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.o_custkey = e.o_custkey AND a.block = e.b) GROUP BY o_custkey, b"
)
def emitted_blocks(spark, d):
    rows = _sweep_rows(spark, d)
    kept = claims.accept_sweep(rows, "o_custkey").select("o_custkey", "block")
    own = rows.join(kept, ["o_custkey", "block"]).select("o_custkey", F.col("block").alias("pos"), (F.col("claim_end") - F.col("block")).alias("len"), F.col("block").alias("owner"))
    return claims.emit_blocks(kept, own, "o_custkey", "owner")


@query("SELECT doc_id, md5(substring(h, 201)) AS tail, md5(substring(h, 201, 100)) AS part FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL) UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE text IS NULL")
def raw_views(spark, d):
    data = F.encode("text", "UTF-8")
    show = lambda c: F.md5(F.hex(c).cast("binary"))
    return read(spark, d, "documents").select("doc_id", show(blocks.raw_view(data, 100)).alias("tail"), show(blocks.raw_view(data, 100, 50)).alias("part"))


# --- claims of several ranges, fragments, members -----------------------------------------------------------

_MANY = "m AS (SELECT CAST(o_custkey % 40 AS BIGINT) AS src, CAST(o_orderkey * 13 % 20011 AS BIGINT) AS block, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)"


def _many(spark, d) -> DataFrame:
    """Items of forty sources, each with a range from its block on and two further ones behind it."""
    rows = read(spark, d, "orders").select((F.col("o_custkey") % 40).cast("long").alias("src"), (F.col("o_orderkey") * 13 % 20011).cast("long").alias("block"), "o_orderkey")
    rows = rows.groupBy("src", "block").agg(F.min("o_orderkey").alias("k"))
    span = lambda pos, n: F.struct((F.col("block") + pos).cast("long").alias("pos"), F.expr(n).cast("long").alias("len"))
    return rows.withColumn("ranges", F.array(span(F.lit(0), "1 + k % 3"), span(10 + F.col("k") % 40, "k % 30"), span(200 + F.col("k") % 900, "k % 61")))


@query(
    f"WITH RECURSIVE {_MANY}, r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY block) AS n, [[block, block + 1 + k % 3], [block + 10 + k % 40, block + 10 + k % 40 + k % 30], [block + 200 + k % 900, block + 200 + k % 900 + k % 61]] AS own FROM m), "
    "s AS (SELECT src, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS block, CAST([] AS BIGINT[][]) AS held, false AS kept FROM r GROUP BY src UNION ALL "
    "SELECT src, n, block, CASE WHEN free THEN list_concat(ahead, own) ELSE ahead END, free FROM (SELECT r.src, r.n, r.block, own, list_filter(s.held, lambda x: x[2] > r.block) AS ahead, len(list_filter(s.held, lambda x: x[1] <= r.block AND x[2] > r.block)) = 0 AS free FROM s JOIN r ON r.src = s.src AND r.n = s.n + 1)) "
    "SELECT src, block FROM s WHERE kept"
)
def multi_range_sweep(spark, d):
    """Which items are kept, from left to right, if each kept one claims three ranges; folded in parts of 4,096 blocks."""
    rows = _many(spark, d).withColumn("constant", F.lit(False))
    return claims.accept_sweep(rows, "src", 4096).select("src", "block")


_CLAIMS = "c AS (SELECT l_suppkey % 7 AS src, l_orderkey * 10 + l_linenumber AS writer, CAST(l_partkey * 3 % 5000 AS BIGINT) AS pos, CAST(l_quantity * 2 AS BIGINT) AS len FROM lineitem WHERE l_suppkey % 3 = 0)"


@query(
    f"WITH {_CLAIMS}, p AS (SELECT src, pos AS x FROM c UNION SELECT src, pos + len FROM c), e AS (SELECT src, x, lead(x) OVER (PARTITION BY src ORDER BY x) AS y FROM p), "
    "o AS (SELECT e.src, x, y, min(writer) AS writer FROM e JOIN c ON c.src = e.src AND x >= pos AND x < pos + len GROUP BY 1, 2, 3), "
    "g AS (SELECT *, sum(new) OVER (PARTITION BY src ORDER BY x) AS g FROM (SELECT *, CASE WHEN lag(writer) OVER w = writer AND lag(y) OVER w = x THEN 0 ELSE 1 END AS new FROM o WINDOW w AS (PARTITION BY src ORDER BY x))) "
    "SELECT src, any_value(writer) AS writer, min(x) AS pos, max(y) - min(x) AS len FROM g GROUP BY src, g"
)
def owned_fragments(spark, d):
    """Stretches of blocks by owner, if the first writer keeps a block; swept in bins of 512 blocks."""
    rows = read(spark, d, "lineitem").where("l_suppkey % 3 = 0").select((F.col("l_suppkey") % 7).alias("src"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("writer"), (F.col("l_partkey") * 3 % 5000).cast("long").alias("pos"), (F.col("l_quantity") * 2).cast("long").alias("len"))
    return claims.owned_fragments(rows.withColumn("o", F.col("writer")), "src", "writer", "o", 512)


_MEMBERS = (
    "i AS (SELECT o_custkey % 20 AS src, concat('/', o_orderkey) AS node, min(CAST(o_orderkey * 4 AS BIGINT)) AS block FROM orders GROUP BY 1, 2), "
    "a AS (SELECT o_custkey % 20 AS src, concat('/', l_orderkey) AS parent, concat('/', l_orderkey, '/', l_linenumber) AS node, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_orderkey * 4 + (l_partkey % 400 - 40) * 2 + 1 AS BIGINT) END AS block, CAST(l_linenumber AS BIGINT) AS ord FROM lineitem JOIN orders ON o_orderkey = l_orderkey), "
    "b AS (SELECT src, node AS parent, concat(node, '/0') AS node, block + (ord - 2) * 6 + 1 AS block, CAST(0 AS BIGINT) AS ord FROM a)"
)


@query(
    f"WITH {_MEMBERS}, pa AS (SELECT a.src, a.block, min((i.block, a.ord, a.node)) AS m FROM a JOIN i ON i.src = a.src AND i.node = a.parent WHERE a.block > i.block GROUP BY 1, 2), "
    "pb AS (SELECT b.src, b.block, min((pa.block, b.ord, b.node)) AS m FROM b JOIN pa ON pa.src = b.src AND pa.m[3] = b.parent WHERE b.block > pa.block GROUP BY 1, 2) "
    "SELECT src, m[3] AS node, block, m[1] AS up FROM pa UNION ALL SELECT src, m[3], block, m[1] FROM pb"
)
def promoted_members(spark, d):
    """Members and members of members at blocks of their own: odd blocks for the former, even ones for the latter."""
    orders = read(spark, d, "orders").select((F.col("o_custkey") % 20).alias("src"), "o_orderkey")
    items = orders.select("src", F.concat(F.lit("/"), "o_orderkey").alias("node"), F.lit(None).cast("string").alias("parent"), (F.col("o_orderkey") * 4).cast("long").alias("block"), F.lit(0).cast("long").alias("ord"))
    place = F.when(F.col("l_linenumber") != 7, (F.col("l_orderkey") * 4 + (F.col("l_partkey") % 400 - 40) * 2 + 1).cast("long"))
    lines = read(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    up = F.concat(F.lit("/"), "l_orderkey")
    one = lines.select("src", F.concat(up, F.lit("/"), "l_linenumber").alias("node"), up.alias("parent"), place.alias("block"), F.col("l_linenumber").cast("long").alias("ord"))
    two = F.struct(F.concat("node", F.lit("/0")).alias("node"), F.col("node").alias("parent"), (F.col("block") + (F.col("ord") - 2) * 6 + 1).alias("block"), F.lit(0).cast("long").alias("ord"))
    both = one.select("src", F.inline(F.array(F.struct("node", "parent", "block", "ord"), two)))  # the lines are joined once
    return claims.promoted_members(items.unionByName(both), "src")


# --- end markers --------------------------------------------------------------------------------------------

_MARKED = "coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN '%%EOF' || coalesce(text, '') || '%%EOF' WHEN 1 THEN 'IEND%%EOF' ELSE '' END"


@query(
    f"WITH t AS (SELECT doc_id, {_MARKED} AS s, hex(encode({_MARKED})) AS h FROM documents), n AS (SELECT doc_id, h, len(h) // 2 AS n FROM t WHERE len(h) > 0), "
    "w(marker, m) AS (VALUES ('pdf', '2525454F46'), ('zip', '504B0506'), ('jpg', 'FFD9'), ('png', '49454E44')), "
    "f AS (SELECT doc_id, marker, CAST(p AS BIGINT) AS pos FROM (SELECT doc_id, h, unnest(range(n)) AS p FROM n WHERE doc_id % 4 < 2), w WHERE substring(h, CAST(2 * p + 1 AS BIGINT), len(m)) = m), "
    "c AS (SELECT doc_id, marker, CAST(unnest(range(0, n, 512)) AS BIGINT) AS pos FROM n, w WHERE marker IN ('pdf', 'png')) "
    'SELECT c.doc_id, c.marker, c.pos, min(f.pos) AS "end" FROM c LEFT JOIN f ON f.doc_id = c.doc_id AND f.marker = c.marker AND f.pos >= c.pos GROUP BY 1, 2, 3'
)
def next_end_marker(spark, d):
    """The next end marker of two formats at or behind every block of texts that hold some; bins of 4,096 bytes."""
    text = F.coalesce("text", F.lit(""))
    more = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("%%EOF"), text, F.lit("%%EOF"))).when(F.col("doc_id") % 4 == 1, "IEND%%EOF").otherwise("")
    docs = read(spark, d, "documents").select("doc_id", F.encode(F.concat(text, more), "UTF-8").alias("data"))
    cut = blocks.column_blocks(docs, "doc_id", "data", look_ahead=1024).select("doc_id", "block", "window")
    asked = cut.select("doc_id", F.explode(F.array(F.lit("pdf"), F.lit("png"))).alias("marker"), (F.col("block") * 512).alias("pos"))
    return markers.next_markers(asked, markers.end_markers(cut, "doc_id"), "doc_id", 4096)


# --- chains and trees ------------------------------------------------------------------------------------------

_LINKS = "l AS (SELECT o_custkey % 40 AS src, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS node, count(*) OVER (PARTITION BY o_custkey % 40) AS n, o_orderkey FROM orders), t AS (SELECT src, node, CASE WHEN node % 16 = 15 THEN n + 7 WHEN node % 97 = 40 THEN node - 9 ELSE node + 1 + node % 3 * 16 END AS nxt, o_orderkey FROM l)"


def _numbered(spark, d, sources: int) -> DataFrame:
    """src, node (place of an order among those of its source), n, o_orderkey."""
    orders = read(spark, d, "orders").select((F.col("o_custkey") % sources).alias("src"), "o_orderkey")
    w = Window.partitionBy("src").orderBy("o_orderkey")
    return orders.withColumn("node", (F.row_number().over(w) - 1).cast("long")).withColumn("n", F.count("*").over(Window.partitionBy("src")))


@query(
    f"WITH RECURSIVE {_LINKS}, w AS (SELECT src, node AS start, 0 AS rank, node, [node] AS seen FROM t WHERE node % 29 = 0 UNION ALL "
    "SELECT w.src, start, rank + 1, u.node, list_append(seen, u.node) FROM w JOIN t ON t.src = w.src AND t.node = w.node JOIN t u ON u.src = t.src AND u.node = t.nxt WHERE NOT list_contains(seen, u.node)) "
    "SELECT w.src, start, count(*) AS n_sectors, md5(string_agg(CAST(o_orderkey AS VARCHAR), '' ORDER BY rank)) AS digest FROM w JOIN t ON t.src = w.src AND t.node = w.node GROUP BY 1, 2"
)
def allocation_chains(spark, d):
    """Chains of sectors in forty allocation tables with ends, shared ends and loops; digest of what the sectors hold, in order."""
    rows = _numbered(spark, d, 40)
    node = F.col("node")
    links = rows.select("src", "node", F.when(node % 16 == 15, F.col("n") + 7).when(node % 97 == 40, node - 9).otherwise(node + 1 + node % 3 * 16).alias("next"), F.col("o_orderkey").cast("string").alias("data"))
    found = chains.follow(links, links.where("node % 29 = 0").select("src", F.col("node").alias("start")), "src")
    whole = found.join(links.select("src", "node", "data"), ["src", "node"]).groupBy("src", "start").agg(F.count("*").alias("n_sectors"), F.array_sort(F.collect_list(F.struct("rank", "data"))).alias("parts"))
    return whole.select("src", "start", "n_sectors", F.md5(F.array_join(F.transform("parts", lambda x: x["data"]), "")).alias("digest"))


@query(
    "WITH RECURSIVE e AS (SELECT o_custkey % 30 AS src, row_number() OVER (PARTITION BY o_custkey % 30 ORDER BY o_orderkey) - 1 AS entry, concat('n', o_orderkey) AS name, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS kind FROM orders), "
    "p AS (SELECT src, CAST(3 AS BIGINT) AS entry, '' AS up FROM e WHERE entry = 0 UNION ALL "
    "SELECT p.src, n.entry, n.up FROM p JOIN e ON e.src = p.src AND e.entry = p.entry, LATERAL (SELECT 3 * p.entry + 1 AS entry, up UNION ALL SELECT 3 * p.entry + 2, up UNION ALL SELECT 3 * p.entry + 3, concat(up, name, '/') WHERE kind = 1) n) "
    "SELECT e.src, e.entry, concat(up, name) AS path, CAST(kind AS INTEGER) AS kind FROM p JOIN e ON e.src = p.src AND e.entry = p.entry"
)
def directory_paths(spark, d):
    """Paths in thirty directory trees of some hundred entries; entries are the places of a tree in which each has two siblings and a child."""
    rows, at = _numbered(spark, d, 30), F.col("node")
    kind = F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1)
    entries = rows.select("src", at.alias("entry"), F.concat(F.lit("n"), "o_orderkey").alias("name"), kind.alias("kind"), (at * 3 + 1).alias("left"), (at * 3 + 2).alias("right"), (at * 3 + 3).alias("child"))
    return chains.directory_paths(entries, "src")


@query(
    "WITH s AS (SELECT s_suppkey AS k, unnest(range(0, s_suppkey % 6 + 1)) AS i FROM supplier WHERE s_suppkey % 9 <> 0) "
    "SELECT k AS s_suppkey, CAST(0 AS BIGINT) AS record, 0 AS level, 0 AS slot, CAST(0 AS BIGINT) AS place, CAST(131 AS BIGINT) AS kind, CAST(1 AS BIGINT) AS start, k + 1 AS sectors FROM s WHERE i = 0 UNION ALL "
    "SELECT k, 0, 0, 1, 0, CASE WHEN k % 2 = 0 THEN 5 ELSE 15 END, 2, 7 FROM s WHERE i = 0 UNION ALL "
    "SELECT k, 2, CAST(i + 1 AS INTEGER), 0, 2 + i * 2, 11, 2 + i * 2 + 1, k + i FROM s"
)
def partition_chain(spark, d):
    """Partitions told by boot records and their chains of extended records, which lie at computed sectors; a ninth of the records is invalid."""

    @F.pandas_udf("binary")
    def disk(keys: pd.Series) -> pd.Series:
        entry = lambda boot, kind, first, n: struct.pack("<8B2I", boot, 1, 1, 0, kind, 254, 255, 255, first, n)

        def one(k: int) -> bytes:
            out = bytearray(512 * 16)
            put = lambda at, own: out.__setitem__(slice(at * 512, at * 512 + 512), bytes(446) + own.ljust(64, b"\0") + b"\x55\xaa")
            put(0, entry(0x80 if k % 9 else 0x13, 0x83, 1, k + 1) + entry(0, 0x05 if k % 2 == 0 else 0x0F, 2, 7))
            last = k % 6
            for i in range(last + 1):  # the last record of some links back to the first
                more = entry(0, 0x05, 2 * (i + 1), 9) if i < last else entry(0, 0x0F, 0, 9) if k % 4 == 1 else b""
                put(2 + 2 * i, entry(0, 0x0B, 1, k + i) + more)
            return bytes(out)

        return keys.map(one)

    disks = read(spark, d, "supplier").select("s_suppkey", disk("s_suppkey").alias("data"))
    return chains.partition_chain(blocks.column_blocks(disks, "s_suppkey", "data").select("s_suppkey", F.col("block").alias("sector"), "data"), "s_suppkey")


# --- rendering -------------------------------------------------------------------------------------------

_TREE = (
    "t AS (SELECT concat('/', r_regionkey) AS path, 0 AS depth, r_name AS brief, CAST(NULL AS INTEGER) AS confidence FROM region UNION ALL "
    "SELECT concat('/', n_regionkey, '/', n_nationkey), 1, n_name, CAST(n_nationkey AS INTEGER) FROM nation UNION ALL "
    "SELECT concat('/', n_regionkey, '/', n_nationkey, '/', s_suppkey), 2, s_name, 100 FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
)


@query(f"WITH {_TREE} SELECT path, concat(repeat('  ', depth), brief, ' (', coalesce(confidence, -1), ')') AS line FROM t")
def tree_lines(spark, d):
    nation = read(spark, d, "nation")
    top = read(spark, d, "region").select(F.concat(F.lit("/"), "r_regionkey").alias("path"), F.lit(0).alias("depth"), F.col("r_name").alias("brief"), F.lit(None).cast("int").alias("confidence"))
    mid = nation.select(F.concat(F.lit("/"), "n_regionkey", F.lit("/"), "n_nationkey"), F.lit(1), "n_name", F.col("n_nationkey").cast("int"))
    low = read(spark, d, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # nations: a fixed table of 25 rows
    low = low.select(F.concat(F.lit("/"), "n_regionkey", F.lit("/"), "n_nationkey", F.lit("/"), "s_suppkey"), F.lit(2), "s_name", F.lit(100))
    return render.tree_lines(top.union(mid).union(low))


@query(
    "SELECT CAST(-2 AS BIGINT) AS \"offset\", 'Blocks' AS line UNION ALL SELECT -1, '       Offset Description' UNION ALL "
    "SELECT CAST(o_orderkey AS BIGINT), concat(lpad(CAST(o_orderkey AS VARCHAR), 13, ' '), ' ', rpad(o_orderstatus, 12, ' '), ' # ', coalesce(o_orderpriority, ''), ' Path:/', o_custkey) FROM orders"
)
def report_with_header(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("offset"), F.col("o_orderstatus").alias("brief"), F.col("o_orderpriority").alias("description"), F.concat(F.lit("/"), "o_custkey").alias("path"), F.lit(None).cast("long").alias("owner_offset"))
    return render.with_header(render.block_lines(rows), "Blocks")


# --- thresholds that reach the engine --------------------------------------------------------------------


@query(
    "WITH t AS (SELECT s_suppkey, CAST(s_suppkey % 101 AS INTEGER) AS a, CAST(s_suppkey * 7 % 101 AS INTEGER) AS b FROM supplier) "
    "SELECT s_suppkey, CASE WHEN a >= 80 THEN 'first' WHEN b >= 50 THEN 'second' ELSE 'none' END AS classifier, CASE WHEN a >= 80 THEN a WHEN b >= 50 THEN b ELSE -1 END AS confidence FROM t"
)
def thresholds_per_classifier(spark, d):
    """Two classifiers are asked in order through ``classifiers.ask``; the first has a threshold of its own."""

    def run(batches):
        import pyarrow as pa

        from strata.operators.classifiers import ask

        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                extra = {"first": lambda _, k=k: Verdict("first", k % 101, "A", ""), "second": lambda _, k=k: Verdict("second", k * 7 % 101, "B", "")}
                out.append(ask(["first", "second"], b"", extra, thresholds={"first": 80}) or Verdict("none", -1, "", ""))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([v.classifier for v in out]), pa.array([v.confidence for v in out], pa.int32())], names=["s_suppkey", "classifier", "confidence"])

    return read(spark, d, "supplier").select("s_suppkey").mapInArrow(run, "s_suppkey long, classifier string, confidence int")


_FILL = "CASE WHEN event_id % 50 = 0 THEN NULL ELSE CAST({div} % 3 AS VARCHAR{n}) END"


@query(
    f"WITH s AS (SELECT event_id AS b, {_FILL.format(div='(event_id // 7)', n='')} AS fill FROM events), r AS (SELECT min(b) AS b, max(b) + 1 AS e FROM (SELECT fill, b, b - row_number() OVER (PARTITION BY fill ORDER BY b) AS g FROM s WHERE fill IS NOT NULL) GROUP BY fill, g), "
    "i AS (SELECT event_id AS pos, event_id + 1 + (event_id // 50) % 40 AS e FROM events WHERE event_id % 50 = 0) SELECT * FROM (SELECT coalesce(i.e, r.b) AS block, r.e AS claim_end FROM r LEFT JOIN i ON r.b >= i.pos AND r.b < i.e) WHERE block < claim_end"
)
def unclaimed_constant_runs(spark, d):
    """Runs of equal constant blocks that no item claims, cut where an item reaches into them."""
    events = read(spark, d, "events")
    seen = events.select(F.col("event_id").alias("block"), F.expr(_FILL.format(div="(event_id div 7)", n="(2)")).alias("fill"))
    items = events.where("event_id % 50 = 0").select(F.col("event_id").alias("block"), F.expr("event_id + 1 + (event_id div 50) % 40").alias("claim_end"))
    return api.constant_runs(seen, items)
