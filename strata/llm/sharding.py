"""Feistel sharding: a computable shuffle of all rows into shards of equal row counts.

Law ``rows``: every row gets a global row number (ascending id; ties by checksum and size), a keyed
Feistel permutation maps row numbers 0..N-1 onto 0..N-1, and the permuted number p gives
shard = p mod shards and slot = p div shards. So shard sizes differ by one row at most, slots are
gapless, and shard and slot of any row number can be computed without a table.

Cases: a null text has size 1 and the checksum of no bytes; null ids come first; rows that are equal
in id and text are interchangeable; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import checkpoint, table

#: Modulus of the round function (prime, so that products of two residues fit in a long).
PRIME = 2147483647
ROUNDS = 6
#: Steps outside the row numbers that are tried first (``longest_walk``).
WALKS = 8


def round_keys(seed: int) -> list[tuple[int, int]]:
    keys, x = [], seed % PRIME
    for _ in range(ROUNDS):
        x = (x * 48271 + 11) % PRIME
        y = x = (x * 48271 + 11) % PRIME
        x = (x * 48271 + 11) % PRIME
        keys.append((y, x))
    return keys


def domain(n: int) -> tuple[int, int]:
    """Sides a, b of the smallest grid near a square that holds n numbers."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(number: Column, n: int, seed: int, walks: int = WALKS) -> Column:
    """The keyed permutation of 0..n-1 as one expression: Feistel rounds over a grid, at most ``walks`` times until below n.

    ``number`` may also be a value of the grid from n on; if its walk comes back to it, it stays there.
    """
    a, b = domain(n)
    k1 = F.array(*[F.lit(k).cast("long") for k, _ in round_keys(seed)])
    k2 = F.array(*[F.lit(k).cast("long") for _, k in round_keys(seed)])

    def one_round(s: Column, i: Column) -> Column:
        r = s["r"]
        f = ((r + F.get(k1, i)) % PRIME) * ((r + F.get(k2, i)) % PRIME) % PRIME
        side = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b)).cast("long")
        return F.struct(r.alias("l"), ((s["l"] + f) % side).alias("r"))

    def once(x: Column) -> Column:
        side = F.lit(b).cast("long")
        start = F.struct(F.call_function("div", x, side).alias("l"), (x % side).alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    start = number.cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.lit(walks)), start, lambda x, i: F.when((i == 1) | ((x >= n) & (x != start)), once(x)).otherwise(x))


def longest_walk(spark: SparkSession, n: int, seed: int, first: int = WALKS) -> int:
    """A number of walks after which every row number has arrived below n.

    A walk only passes values of the grid from n on, which are fewer than the square root of n and one: all of them
    are walked, twice as far each time, until each has arrived or come back to itself (no row number leads there).
    """
    a, b = domain(n)
    outside, walks = spark.range(n, a * b), first
    while outside.where((permuted(F.col("id"), n, seed, walks) >= n) & (permuted(F.col("id"), n, seed, walks) != F.col("id"))).limit(1).count():
        walks *= 2
    return walks + 1


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_number`` (0..N-1 in the given order) without ever sorting all rows in one task.

    Rows are dealt by ranges of the order and numbered inside each range; only one count per range
    meets in one place (their number is that of the shuffle partitions).
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("mid_", F.monotonically_increasing_id())
    dealt = checkpoint(dealt.withColumn("range_", F.shiftright("mid_", 33)).withColumn("at_", F.col("mid_").bitwiseAND(F.expr("8589934591L"))))
    counts = {r["range_"]: r["n"] for r in dealt.groupBy("range_").agg(F.count("*").alias("n")).collect()}
    start, starts = 0, []
    for k in range(max(counts, default=-1) + 1):
        starts.append(start)
        start += counts.get(k, 0)
    base = F.get(F.array(*[F.lit(s).cast("long") for s in starts or [0]]), F.col("range_").cast("int"))
    return dealt.withColumn("row_number", base + F.col("at_")).drop("mid_", "range_", "at_"), start


def shard_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, seed: int = 20240229) -> DataFrame:
    """id, size, text_crc32, row_number, shard and slot of every row. Native: DataFrame functions only."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    light = df.select(F.col(f"`{id_col}`").alias("id_"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows, n = numbered(light, ["id_", "text_crc32", "size"])
    p = permuted(F.col("row_number"), n, seed, longest_walk(df.sparkSession, n, seed))
    return rows.withColumn("p_", p).select(F.col("id_").alias(id_col), "size", "text_crc32", "row_number", (F.col("p_") % shards).cast("int").alias("shard"), F.expr(f"p_ div {shards}").cast("long").alias("slot"))


def op9_feistel_shards(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot under law ``rows``."""
    return shard_rows(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_sql(shards: int = 8, seed: int = 20240229) -> str:
    keys = round_keys(seed)
    k1, k2 = ([k[j] for k in keys] for j in (0, 1))
    return f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, text,
         row_number() OVER (ORDER BY doc_id, strlen(coalesce(text, ''))) - 1 AS rn FROM documents),
n_ AS (SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM rows_),
g_ AS (SELECT n, a, (n + a - 1) // a AS b FROM n_),
walk AS (
  SELECT rn, rn // b AS l, rn % b AS r, 0 AS i FROM rows_, g_
  UNION ALL
  SELECT rn, r, (l + ((r + list_extract({k1}, i % {ROUNDS} + 1)) % {PRIME}) * ((r + list_extract({k2}, i % {ROUNDS} + 1)) % {PRIME}) % {PRIME})
                 % CASE WHEN i % 2 = 0 THEN a ELSE b END, i + 1
  FROM walk, g_ WHERE NOT (i > 0 AND i % {ROUNDS} = 0 AND l * b + r < n)),
done AS (SELECT rn, l * b + r AS p FROM walk, g_ WHERE i > 0 AND i % {ROUNDS} = 0 AND l * b + r < n),
bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS t FROM (SELECT unnest(range(256)) AS i)),
crc_table AS (SELECT list(t ORDER BY i) AS t FROM bits),
bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM rows_),
crc AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda k: CAST('0x' || h[2 * k + 1:2 * k + 2] AS BIGINT))),
  lambda c, x: xor(c // 256, list_extract(t, CAST(xor(c % 256, x) + 1 AS BIGINT)))), 4294967295) AS text_crc32 FROM bytes, crc_table)
SELECT r.doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law,
       CAST(p % {shards} AS INTEGER) AS shard, CAST(p // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM rows_ r JOIN done d USING (rn) JOIN crc c USING (doc_id)"""
