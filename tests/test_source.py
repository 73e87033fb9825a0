"""The block source: what it reads, and that filters on blocks keep it from reading more."""

from __future__ import annotations

import random

import pytest

from strata.sources import blocks


@pytest.mark.parametrize(("n", "size"), [(1, 512), (511, 512), (2048, 512), (70_001, 512), (5000, 4096), (9000, 1024)])
def test_windows(spark, tmp_path, n, size):
    data = random.Random(n).randbytes(n)
    (tmp_path / "f").write_bytes(data)
    blocks.register(spark)
    rows = spark.read.format("blocks").option("path", str(tmp_path / "f")).option("blockSize", size).option("blocksPerPartition", 50).load().orderBy("block").collect()
    look = max(2048, size)
    assert [(r["block"], r["window_len"], bytes(r["window"])) for r in rows] == [(i, len(w), w) for i in range(-(-n // size)) for w in [data[i * size : i * size + look]]]
    assert {r["source_id"] for r in rows} == {str(tmp_path / "f")}


def test_filters_choose_the_partitions(spark, tmp_path):
    (tmp_path / "f").write_bytes(bytes(512 * 1000))
    blocks.register(spark)
    df = spark.read.format("blocks").option("path", str(tmp_path / "f")).option("blocksPerPartition", 100).load()
    assert df.rdd.getNumPartitions() == 10
    for condition, want in (("block >= 250 and block < 420", range(250, 420)), ("block = 7", [7]), ("block > 995", range(996, 1000)), ("block <= 2 and window_len > 0", range(3)), ("block > 2000", []), ("block in (3, 900)", [3, 900])):
        got = df.where(condition)
        assert [r["block"] for r in got.orderBy("block").select("block").collect()] == list(want)
    assert df.where("block >= 250 and block < 420").rdd.getNumPartitions() == 2
    plan = df.where("block >= 250")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan or "Filter (" not in plan.split("BatchScan")[0]
