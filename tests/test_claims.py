from __future__ import annotations

import random

from pyspark.sql import functions as F

from strata.operators import claims


def test_from_bytes(spark):
    df = spark.createDataFrame([(0, 512), (100, 512), (0, 0), (100, 100), (512, 513)], "off long, n long")
    got = [r["c"] and tuple(r["c"]) for r in df.select(claims.claim_of_bytes(F.col("off"), F.col("n")).alias("c")).collect()]
    assert got == [(0, 0), (1, 1), None, None, (1, 2)]
    compat = df.limit(1).select(claims.claim_of_bytes(F.col("off"), F.col("n"), compat=True).alias("c")).first()["c"]
    assert tuple(compat) == (0, 1)


def test_from_length(spark):
    df = spark.createDataFrame([(1024, 1000, True), (-1, 10, True), (0, 0, True), (0, 10, False)], "a long, n long, c boolean")
    got = [r["c"] and tuple(r["c"]) for r in df.select(claims.claim_of_length(F.col("a"), F.col("n"), F.col("c")).alias("c")).collect()]
    assert got == [(2, 2), None, None, None]


def rows_of(seed):
    r = random.Random(seed)
    return [(r.randrange(3), r.randrange(60), r.randrange(1, 9)) for _ in range(40)]


def test_merge_matches_a_set_of_blocks(spark):
    for seed in range(4):
        rows = rows_of(seed)
        got = claims.merge_claims(spark.createDataFrame(rows, "k int, pos long, len long"), "k").collect()
        for k in {x[0] for x in rows}:
            want = {b for kk, p, n in rows if kk == k for b in range(p, p + n)}
            own = sorted((r["pos"], r["len"]) for r in got if r["k"] == k)
            assert {b for p, n in own for b in range(p, p + n)} == want
            assert all(p + n < q for (p, n), (q, _) in zip(own, own[1:], strict=False))


def test_joins_match_a_set_of_blocks(spark):
    rows = rows_of(9)
    c = spark.createDataFrame(rows, "k int, pos long, len long")
    b = spark.createDataFrame([(k, x) for k in range(3) for x in range(70)], "k int, block long")
    inside = {(k, x) for k, p, n in rows for x in range(p, p + n)}
    out = {(r["k"], r["block"]) for r in claims.blocks_outside(b, c, "k", bin_size=16).collect()}
    assert out == {(k, x) for k in range(3) for x in range(70)} - inside
    hit = [(r["k"], r["block"]) for r in claims.blocks_inside(b, c, "k", bin_size=16).collect()]
    assert sorted(hit) == sorted((k, x) for k, p, n in rows for x in range(p, p + n) if x < 70)


def test_first_writer(spark):
    rows = rows_of(5)
    df = spark.createDataFrame([(k, p, n, i) for i, (k, p, n) in enumerate(rows)], "k int, pos long, len long, w int")
    want = {}
    for i, (k, p, n) in enumerate(rows):
        for b in range(p, p + n):
            want.setdefault((k, b), i)
    assert {(r["k"], r["block"]): r["w"] for r in claims.first_writer(df, "k", "w", "w").collect()} == want


def test_sweep(spark):
    ends = {0: 4, 2: 8, 5: 7}
    df = spark.createDataFrame([(1, b, ends.get(b, b + 1), False) for b in range(10)], "k int, block long, claim_end long, constant boolean")
    assert sorted(r["block"] for r in claims.accept_sweep(df, "k").collect()) == [0, 4, 5, 7, 8, 9]
    cut = spark.createDataFrame([(1, 0, 6, False), (1, 4, 10, True), (2, 0, 6, False), (2, 4, 6, True)], "k int, block long, claim_end long, constant boolean")
    assert sorted((r["k"], r["block"], r["start"]) for r in claims.accept_sweep(cut, "k").collect()) == [(1, 0, 0), (1, 4, 6), (2, 0, 0)]


def test_runs(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("aabbba")], "k int, i int, v string")
    assert sorted((r["start"], r["v"], r["n"]) for r in claims.runs(df, "k", ["i"], "v").collect()) == [(0, "a", 2), (2, "b", 3), (5, "a", 1)]
