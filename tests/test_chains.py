"""Chains, trees and record chains against plain walks, and against the classifiers that read them from bytes."""

from __future__ import annotations

import random
import struct

from pyspark.sql import functions as F

from strata import catalog_formats as make
from strata.operators import chains
from strata.operators.classifiers import mbr, ole
from strata.sources import blocks


def walk(links: dict, start):
    out = []
    while start in links and start not in out:
        out.append(start)
        start = links[start]
    return out


def test_chains_match_a_walk(spark):
    r = random.Random(3)
    links = {k: {i: r.choice([i + 1, i + 1, i + 1, r.randrange(90), None, 5000]) for i in range(80)} for k in (None, 1, 2)}
    rows = [(k, i, n) for k, own in links.items() for i, n in own.items()]
    starts = [(k, s) for k in links for s in range(0, 100, 7)] + [(1, 0), (9, 3), (1, None)]
    got = chains.follow(spark.createDataFrame(rows, "k int, node long, next long"), spark.createDataFrame(starts, "k int, start long"), "k").collect()
    found: dict = {}
    for x in sorted(got, key=lambda x: x["rank"]):
        found.setdefault((x["k"], x["start"]), []).append(x["node"])
    assert found == {(k, s): w for k, s in set(starts) if k in links and (w := walk(links[k], s))}


def test_streams_of_compound_documents(spark):
    """Allocation table, directory and streams read natively give what the classifier reads."""
    streams = [("Small", b"abc" * 30), ("Large", bytes(range(250)) * 60), ("Other", b"xyz" * 2000)]
    docs = [(k, bytearray(make.ole(streams[: k + 1]))) for k in range(3)]
    sectors = blocks.column_blocks(spark.createDataFrame(docs, "k int, data binary"), "k", "data").select("k", (F.col("block") - 1).alias("sector"), "data")
    links = chains.table_links(sectors.where("sector = 0").withColumn("part", F.lit(0)), "k", "part", "data")
    at = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("entry")
    entries = sectors.where("sector = 1").select("k", at, "data").select("k", "entry", F.substring("data", F.col("entry") * 128 + 1, F.lit(128)).alias("e"))
    byte4 = lambda place: chains.little_endian(F.col("e"), place)
    name = F.decode(F.substring("e", F.lit(1), F.greatest(F.lit(0), chains.little_endian(F.col("e"), 64, 2) - 2).cast("int")), "UTF-16LE")
    kind = chains.little_endian(F.col("e"), 66, 1)
    tree = entries.select("k", "entry", name.alias("name"), F.when(kind == 2, 2).otherwise(1).alias("kind"), byte4(68).alias("left"), byte4(72).alias("right"), byte4(76).alias("child"), byte4(116).alias("first"), byte4(120).alias("size"))
    paths = chains.directory_paths(tree, "k").join(tree.select("k", "entry", "first", "size"), ["k", "entry"]).where("kind = 2 and size >= 4096")
    found = chains.follow(links, paths.select("k", F.col("first").alias("start")), "k").join(sectors.select("k", F.col("sector").alias("node"), "data"), ["k", "node"])
    bodies: dict = {}
    for x in found.orderBy("rank").collect():
        bodies[x["k"], x["start"]] = bodies.get((x["k"], x["start"]), b"") + bytes(x["data"])
    got = {(x["k"], x["path"], bodies[x["k"], x["first"]][: x["size"]]) for x in paths.collect()}
    assert got == {(k, n, b) for k, d in docs for n, b in ole.classify(bytes(d)).children if len(b) >= 4096} and len(got) == 3


def test_trees_with_loops(spark):
    rows = [
        (1, 0, "root", 1, None, None, 3), (1, 3, "b", 1, 2, 4, 5), (1, 2, "a", 2, None, None, None), (1, 4, "c", 2, 3, 99, None), (1, 5, "d", 1, 5, None, 0), (1, 7, "lost", 2, None, None, None),
        (2, 0, "root", 1, None, None, None), (None, 0, "r", 1, None, None, 1), (None, 1, None, 2, None, None, 9),
    ]
    df = spark.createDataFrame(rows, "k int, entry long, name string, kind int, left long, right long, child long")
    got = {(r["k"], r["entry"], r["path"], r["kind"]) for r in chains.directory_paths(df, "k").collect()}
    assert got == {(1, 3, "b", 1), (1, 2, "a", 2), (1, 4, "c", 2), (1, 5, "b/d", 1), (None, 1, "", 2)}
    assert chains.directory_paths(df.limit(0), "k").count() == 0


def test_records_match_the_classifier(spark):
    r = random.Random(6)

    def entry(broken=0):
        kind = r.choice([0, 0x83, 0x0B, 0x05, 0x0F, 0x42])
        return bytes(16) if not kind else struct.pack("<8B2I", 0x13 if r.random() < broken else r.choice([0, 0x80]), 1, 1, 0, kind, 254, 255, 255, r.randrange(12), r.randrange(9))

    disks = []
    for k in range(40):
        data = bytearray(512 * 12)
        for s in range(12):
            if s == 0 or r.random() < 0.7:
                data[512 * s : 512 * s + 512] = bytes(446) + b"".join(entry(0.1 if s == 0 else 0) for _ in range(4)) + (b"\x55\xaa" if r.random() < 0.9 else b"\0\0")
        disks.append((k, data))
    sectors = blocks.column_blocks(spark.createDataFrame(disks, "k int, data binary"), "k", "data").select("k", F.col("block").alias("sector"), "data")
    got: dict = {}
    for x in chains.partition_chain(sectors, "k").collect():
        got.setdefault(x["k"], []).append(f"{mbr.NAMES.get(x['kind'], 'Unknown')} ({x['sectors']} sectors)")
    for k, data in disks:
        v = mbr.classify(bytes(data))
        told = v.description.split(", ") if v.confidence and not v.description.startswith("invalid") else []
        assert sorted(set(got.get(k, []))) == sorted(set(told))
