from __future__ import annotations

import io
import os
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from strata import api, config
from strata.functions import types
from strata.operators import expand, routing
from strata.plans import render
from strata.streaming import logs


def test_routing(spark):
    reg = types.registry(spark)
    items = spark.createDataFrame([(1, [0x60]), (2, [0x01, 0x31]), (3, [0x24, 0x30])], "i int, types array<int>")
    got = sorted((r["i"], r["rank"], r["classifier"]) for r in routing.route(items, reg, "i").collect())
    assert got == [(2, 1, "ole"), (2, 2, "text"), (3, 1, "pdf"), (3, 2, "zlib")]
    assert [(r["i"], r["type_code"], r["confidence"]) for r in routing.unsupported(items, reg, "i").collect()] == [(1, 0x60, -1)]


def test_arbitration(spark):
    v = spark.createDataFrame([(1, "text", 40, 1, 50), (1, "text", 70, 2, 50), (1, "text", 70, 3, 50), (1, "ole", 50, 1, 50), (2, "text", 40, 1, 50)], "i int, classifier string, confidence int, ord int, threshold int")
    best = routing.best_verdicts(v, "i")
    assert sorted((r["classifier"], r["confidence"], r["ord"]) for r in best.collect()) == [("ole", 50, 1), ("text", 70, 3)]
    assert [(r["i"], r["classifier"]) for r in routing.first_satisfied(best, types.registry(spark), "i").collect()] == [(1, "ole")]


def tree(spark, rows):
    return spark.createDataFrame(rows, "node string, parent string, depth int, ord int, brief string, confidence int")


def test_nested_text(spark):
    rows = [("r", None, 0, 0, "PDF", 100), ("a", "r", 1, 0, "TEXT", 100), ("b", "r", 1, 1, "TEXT", 90), ("c", "r", 1, 2, "ZLIB", 100), ("d", "c", 2, 0, "TEXT", 100), ("e", "r", 1, 3, "JPG", 0), ("f", "e", 2, 0, "TEXT", 100)]
    assert {r["node"]: r["shown"] for r in render.nested_text(tree(spark, rows), 2).collect()}["r"] == "PDF-(TEXT ZLIB-(TEXT))"


def test_siblings_compare_before_collapsing(spark):
    rows = [("r", None, 0, 0, "ZIP", 100), ("a", "r", 1, 0, "PDF", 100), ("b", "r", 1, 1, "PDF", 100), ("a1", "a", 2, 0, "TEXT", 100), ("b1", "b", 2, 0, "TEXT", 100), ("b2", "b", 2, 1, "TEXT", 100)]
    assert {r["node"]: r["shown"] for r in render.nested_text(tree(spark, rows), 2).collect()}["r"] == "ZIP-(PDF-(TEXT) PDF-(TEXT))"


def test_expansion(spark):
    inner = zlib.compress(b"A text with some words, w x y z, in it. " * 3)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("in ner.z", inner)
    df = spark.createDataFrame([(7, bytearray(out.getvalue())), (8, bytearray(bytes(600)))], "id long, data binary")
    got = {r["path"]: (r["brief"], r["depth"], r["name"]) for r in expand.expand(expand.roots(df, "id", "data")).collect()}
    assert got == {"/src/7": ("ZIP", 0, None), "/src/7:mnt-compressed/0": ("ZLIB", 1, "in ner.z"), "/src/7:mnt-compressed/0:mnt-zlib/0": ("TEXT", 2, "decompressed_zlib"), "/src/8": ("Constant", 0, None)}


def image() -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + bytes(4)
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 2, 0, 0, 0)) + chunk(b"IDAT", bytes(range(1, 201)) * 3) + chunk(b"IEND", b"")
    return bytes(1024) + png + b"\x91" * (-len(png) % 512) + (b"Some words in a text, with w x y z. " * 40)[:1024]


def test_classify_an_image(spark, tmp_path):
    (tmp_path / "disk").write_bytes(image())
    lines = [r["line"] for r in api.classify(spark, str(tmp_path / "disk")).collect()]
    assert [line.split()[1] for line in lines] == ["Constant", "Constant", "PNG", "PNG", "TEXT", "TEXT"]
    assert lines[3] == f"{1536:13d} {'PNG':<12s} # Continuation of data starting at block 1024" and [int(x.split()[0]) for x in lines] == [512 * i for i in range(6)]
    assert len(api.classify(spark, str(tmp_path / "disk"), start_block=4).collect()) == 2
    assert [r["line"].split()[:2] for r in api.classify(spark, str(tmp_path / "disk"), style=1).collect()] == [["1024", "PNG"], ["2048", "TEXT"]]


def test_lines_are_written_in_order(spark, tmp_path):
    df = spark.range(50).select((F.lit(50) - F.col("id")).alias("offset"), F.format_string("%03d", F.lit(50) - F.col("id")).alias("line"))
    render.write_lines(df, str(tmp_path / "out"))
    parts = sorted(p for p in os.listdir(tmp_path / "out") if p.startswith("part"))
    lines = [x for p in parts for x in (tmp_path / "out" / p).read_text().split()]
    assert lines == [f"{i:03d}" for i in range(1, 51)]


def test_log_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", i % 5 + 1, i, f"m{i}") for i in range(20)], "sender_id string, severity int, s int, message string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = logs.start(stream, str(tmp_path / "out"), str(tmp_path / "cp"), least=2)
    q.awaitTermination(60)
    got = spark.read.text(str(tmp_path / "out"))
    assert got.where("sink = 'severe'").count() == 4 and got.where("sink = 'general'").count() == 12


def test_config(tmp_path):
    (tmp_path / "b.conf").write_text("[general]\nroot = /data\nkey = late\n[text]\npath = ${root}/x\n")
    (tmp_path / "A.conf").write_text("[general]\nkey = early\nloop = ${loop}\n")
    (tmp_path / "c.txt").write_text("[general]\nkey = no\n")
    c = config.load(str(tmp_path), {"text.own": "1"})
    assert (config.get(c, "text", "path"), config.get(c, "text", "key"), config.get(c, "text", "own"), config.get(c, "x", "none", "d")) == ("/data/x", "late", "1", "d")
    assert config.get(c, "general", "loop") == "${loop}"


@pytest.mark.parametrize("name", ["document_types", "claim_block_membership", "accept_sweep", "text_verdict", "magic_types_by_signature", "zlib_expand", "path_lines"])
def test_catalogue_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    from strata import catalog

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "lineitem", "orders", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    want = con.sql(catalog.ORACLE_SQL[name])
    got = catalog.QUERIES[name](spark, d)
    order = sorted(want.columns)
    rows = lambda xs, cols: sorted(str([dict(zip(cols, x, strict=True))[c] for c in order]) for x in xs)
    assert sorted(got.columns) == order and rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_plans_stay_in_the_jvm(spark):
    """Detection and the text cascade need no Python and no shuffle; the interval join is an equi-join."""
    from strata import catalog

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    plan = lambda n: catalog.QUERIES[n](spark, d)._jdf.queryExecution().executedPlan().toString()
    for n in ("magic_text_flags", "magic_types_by_signature", "text_verdict", "block_scan"):
        assert "Python" not in plan(n) and "Arrow" not in plan(n) and "Exchange" not in plan(n), n
    assert "NestedLoop" not in plan("claim_block_membership") and "Cartesian" not in plan("claim_block_join_bucketed")
