"""Items of several ranges, whose gaps hold other items; fragments; members at their own blocks."""

from __future__ import annotations

import gzip
import random
import struct

import pytest
from pyspark.sql import functions as F

from strata import api, config
from strata import catalog_formats as make
from strata.operators import claims, classifiers, expand
from strata.operators.classifiers import Limits, Registry, Verdict
from strata.sources.views import Extents, Held, Reader


@pytest.mark.parametrize(("seed", "size"), [(1, 1000), (2, 16), (3, 9)])
def test_sweep_of_many_ranges(spark, seed, size):
    """Equal to a walk with a set of blocks, for parts of every size."""
    r = random.Random(seed)
    rows, want = [], set()
    for k in (None, 1, 2):
        held: set[int] = set()
        for block in sorted(r.sample(range(120), 50)):
            ranges = [(block, 1)] + [(block + r.randrange(1, 40), r.randrange(0, 9)) for _ in range(r.randrange(4))]
            constant = r.random() < 0.2
            end = block + r.randrange(1, 12) if constant else None
            rows.append((k, block, constant, end, None if constant else ranges))
            start = next(b for b in range(block, 10_000) if b not in held)
            if start != block and not (constant and end > start):
                continue
            want.add((k, block, start))
            held |= set(range(start, end)) if constant else {b for p, n in ranges for b in range(p, p + n)}
    df = spark.createDataFrame(rows, "k int, block long, constant boolean, claim_end long, ranges array<struct<pos:long,len:long>>")
    assert {(x["k"], x["block"], x["start"]) for x in claims.accept_sweep(df, "k", size).collect()} == want


def test_fragments_match_a_walk(spark):
    r = random.Random(4)
    rows = [(r.choice([None, 1, 2]), w, r.randrange(300), r.randrange(0, 60)) for w in range(120)] + [(1, 200, None, 5)]
    df = spark.createDataFrame(rows, "k int, w int, pos long, len long").withColumn("o", -F.col("w"))
    want = {}
    for k, w, pos, n in sorted(rows, key=lambda x: -x[1]):
        for b in range(pos or 0, (pos or 0) + (n if pos is not None else 0)):
            want.setdefault((k, b), w)
    for size in (7, 64, 1000):
        found = [tuple(x) for x in claims.owned_fragments(df, "k", "w", "o", size).select("k", "w", "pos", "len").collect()]
        assert {(k, b): w for k, w, p, n in found for b in range(p, p + n)} == want and sum(n for *_, n in found) == len(want)
        ends = {(k, w, p + n) for k, w, p, n in found}
        assert not any((k, w, p) in ends for k, w, p, _ in found)  # stretches that touch are one


def disk() -> tuple[bytes, dict[str, int]]:
    """A boot record whose extended records lie far behind it, and a volume with a text and a gzip in free clusters."""
    entry = lambda boot, kind, first, n: struct.pack("<8B2I", boot, 1, 1, 0, kind, 254, 255, 255, first, n)
    far, further = 200, 40
    head = bytes(446) + entry(0x80, 0x0B, 2, 100) + entry(0, 0x05, far, 90) + bytes(32) + b"\x55\xaa"
    volume = bytearray(make.fat12([("A       TXT", b"the words of a file " * 60), ("B       GZ ", gzip.compress(b"packed words " * 300, mtime=0))]))
    free = 4 * 512 + 512 * 40
    volume[free - 512 : free - 512 + 1024] = (b"words that no file holds " * 50)[:1024]
    first = bytes(446) + entry(0, 0x0B, 1, 5) + entry(0, 0x05, further, 9) + bytes(32) + b"\x55\xaa"
    second = bytes(446) + entry(0, 0x83, 1, 3) + bytes(48) + b"\x55\xaa"
    out = bytearray(512 * 300)
    out[: len(head)] = head
    out[1024 : 1024 + len(volume)] = volume
    out[512 * far : 512 * (far + 1)] = first
    out[512 * (far + further) : 512 * (far + further + 1)] = second
    return bytes(out), {"volume": 2, "free": 2 + (free - 512) // 512, "first": far, "second": far + further}


@pytest.mark.parametrize("range_blocks", [64])
def test_gaps_are_looked_at(spark, tmp_path, range_blocks):
    data, at = disk()
    (tmp_path / "disk").write_bytes(data)
    lines = {int(x["line"][:13]) // 512: x["line"][14:] for x in api.classify(spark, str(tmp_path / "disk"), range_blocks=range_blocks).collect()}
    assert len(lines) == 300
    assert lines[0].startswith("PART") and "W95 FAT32 (5 sectors)" in lines[0] and "Linux (3 sectors)" in lines[0]
    for far in (at["first"], at["second"]):
        assert lines[far].endswith("Continuation of data starting at block 0") and lines[far].startswith("PART")
    assert lines[at["volume"]].startswith("FAT12-(")
    assert lines[at["free"]].startswith("TEXT") and lines[at["free"] + 1].startswith("TEXT")  # slack of the volume is looked at
    # files have lines at their own blocks: after boot record, table and directory come the clusters
    files = {b: x for b, x in lines.items() if ":mnt-fat12" in x}
    assert sorted(files) == [at["volume"] + 3, at["volume"] + 6] and files[at["volume"] + 3].startswith("TEXT") and files[at["volume"] + 6].startswith("GZIP-(TEXT)")
    items = [x["line"] for x in api.classify(spark, str(tmp_path / "disk"), style=1).collect()]
    assert any(x.startswith(f"{(at['volume'] + 3) * 512} TEXT") for x in items)
    owned = [x["line"] for x in api.classify(spark, str(tmp_path / "disk"), style=2).collect()]
    assert sum(int(x.split("# ")[1].split()[0]) for x in owned if " Unidentified" not in x) <= 300
    assert any(" PART" in x and "# 3 blocks" in x for x in owned)


def test_members_of_members(spark):
    rows = [
        ("a", "i", None, 10, 0), ("a", "i/0", "i", 14, 0), ("a", "i/1", "i", 14, 1), ("a", "i/2", "i", 9, 2), ("a", "i/3", "i", None, 3), ("a", "i/4", "i", 20, 4),
        ("a", "i/1/0", "i/1", 30, 0), ("a", "i/0/0", "i/0", 20, 0), ("a", "i/0/1", "i/0", 31, 1), ("a", "i/2/0", "i/2", 40, 0), ("b", "i", None, 0, 0), ("b", "i/0", "i", 14, 0),
    ]
    df = spark.createDataFrame(rows, "k string, node string, parent string, block long, ord long")
    got = {(r["k"], r["node"], r["block"], r["up"]) for r in claims.promoted_members(df, "k").collect()}
    assert got == {("a", "i/0", 14, 10), ("a", "i/4", 20, 10), ("a", "i/0/1", 31, 14), ("b", "i/0", 14, 0)}
    assert claims.promoted_members(df.limit(0), "k").count() == 0


def test_members_are_looked_at_once(spark, monkeypatch):
    """Members that take no block from one another are written twice at most, however deep they lie; others settle as they did."""
    written = []
    monkeypatch.setattr(claims, "checkpoint", lambda df, own=claims.checkpoint: written.append(own(df)) or written[-1])
    schema = "k int, node string, parent string, block long, ord long"
    deep = [(k, f"{k}/{n}/{i}", f"{k}/{n}/{i - 1}" if i else None, 10 * n + i, 0) for k in range(4) for n in range(50) for i in range(6)]
    got = claims.promoted_members(spark.createDataFrame(deep, schema), "k")
    assert {(r["node"], r["up"]) for r in got.collect()} == {(n, b - 1) for _, n, p, b, _ in deep if p}
    # the rows, each round's rest and what counts: 1200 + (1000 + 800 + 600 + 400 + 200) + 1000
    assert sum(df.count() for df in written) <= 1200 + 3000 + 1000 + 1000
    r = random.Random(3)
    rows = [(1, f"n{i}", f"n{r.randrange(i)}" if i > 5 else None, r.randrange(40) if r.random() < 0.9 else None, r.randrange(3)) for i in range(200)]
    told = {n: b for _, n, p, b, _ in rows if p is None}
    want: dict = {}
    for block in range(40):
        at = [(told[p], o, n) for _, n, p, b, o in rows if p in told and b == block and told[p] is not None and told[p] < block]
        if at:
            told[min(at)[2]] = block
            want[min(at)[2]] = (block, min(at)[0])
    assert {x["node"]: (x["block"], x["up"]) for x in claims.promoted_members(spark.createDataFrame(rows, schema), "k").collect()} == want


def test_views(tmp_path):
    (tmp_path / "f").write_bytes(bytes(range(256)))
    with open(tmp_path / "f", "rb") as f:
        v = Extents(Reader(f, 256), [(10, 5), (100, 3), (0, 2)])
        assert v.read(0, 99) == bytes([10, 11, 12, 13, 14, 100, 101, 102, 0, 1]) and v.read(4, 3) == bytes([14, 100, 101]) and v.read(50, 2) == b""
        assert v.places(3, 4) == [(13, 2), (100, 2)] and v.size == 10
    assert Held(b"abc").read(1, 9) == b"bc" and Held(b"abc").read(7, 1) == b""


def test_what_is_registered_reaches_executors(spark, monkeypatch):
    """Functions travel with the query by value; claims, order, thresholds and what is off too."""
    monkeypatch.setattr(classifiers, "_registered", {})
    monkeypatch.setattr(classifiers, "_claimed", {})
    rows = spark.createDataFrame([(1, b"%PDF-1.4 %%EOF" + b"\x91" * 60), (2, b"words of a text that is long enough to be one")], "id long, data binary")
    items = expand.roots(rows, "id", "data")
    told = lambda **o: {r["root"]: (r["classifier"], r["brief"]) for r in expand.expand(items, **o).where("depth = 0").collect()}
    assert told() == {1: ("pdf", "PDF"), 2: ("text", "TEXT")}
    classifiers.register("mine", lambda data: Verdict("mine", 60, "MINE", f"{len(data)} bytes"), types=(0x30, 0x01))

    def crash(data):
        raise RuntimeError("broken")

    def hang(data):
        while True:
            pass

    assert told() == {1: ("pdf", "PDF"), 2: ("text", "TEXT")}  # asked last
    assert told(reg=Registry(precedence=("mine",))) == {1: ("mine", "MINE"), 2: ("mine", "MINE")}
    assert told(reg=Registry(precedence=("mine",), thresholds={"mine": 61})) == {1: ("pdf", "PDF"), 2: ("text", "TEXT")}
    assert told(reg=Registry(off=frozenset({"pdf", "text"}))) == {1: ("mine", "MINE"), 2: ("mine", "MINE")}
    broken = Registry(functions={"crash": crash, "hang": hang}, claims={"crash": (0x30,), "hang": (0x30,)}, precedence=("crash", "hang", "pdf"))
    assert told(reg=broken, limits=Limits(timeouts={"hang": 0.3}))[1] == ("pdf", "PDF")
    assert ("mine", 0x30, 2147483646, 50) in classifiers.registry().rows()


def test_configuration_reaches_classify(spark, tmp_path):
    (tmp_path / "conf").mkdir()
    (tmp_path / "conf" / "a.conf").write_text("[general]\nblock_size = 1024\noutput_style = 2\nsubcontractor_precedence = subcontractor_text, subcontractor_pdf\nsubcontractor_timeout = 5000\nlimit = 101\n")
    (tmp_path / "conf" / "b.conf").write_text("[subcontractor_text]\nsubcontractor_confidence_threshold = ${limit}\n[subcontractor_sleuth]\nsubcontractor_timeout = -1\n[subcontractor_pdf]\nsubcontractor_timeout = 250\n")
    loaded = config.load(str(tmp_path / "conf"))
    loaded["subcontractor_text.subcontractor_confidence_threshold"] = config.get(loaded, "subcontractor_text", "subcontractor_confidence_threshold")
    got = config.options(loaded)
    assert (got["block_size"], got["start_block"], got["style"]) == (1024, 0, 2) and got["reg"].precedence == ("text", "pdf") and got["reg"].least("text") == 101 and got["reg"].least("pdf") == 50
    assert got["limits"].timeout == 5.0 and got["limits"].timeouts["sleuth"] is None and got["limits"].timeouts["pdf"] == 0.25
    (tmp_path / "disk").write_bytes(b"words of a text " * 200 + gzip.compress(b"x" * 4000))
    assert [x["line"] for x in api.classify(spark, str(tmp_path / "disk"), **got).collect()] == []  # text is not believed, gzip begins inside a block
    api.report(spark, str(tmp_path / "disk"), str(tmp_path / "out"), "Title", block_size=512)
    text = [x["value"] for x in spark.read.text(str(tmp_path / "out")).collect()]
    assert "Title" in text and any("TEXT" in x for x in text) and len(text) == 2 + -(-(tmp_path / "disk").stat().st_size // 512)


def test_depth_is_marked(spark):
    data = b"the words at the bottom of it all, and more of them"
    for _ in range(5):
        data = gzip.compress(data, mtime=0)
    items = expand.roots(spark.createDataFrame([(1, data)], "id long, data binary"), "id", "data")
    assert expand.expand(items).where("description like '%NOT UNFOLDED'").count() == 0 and expand.expand(items).count() == 6
    cut = {r["depth"]: r["description"] for r in expand.expand(items, max_depth=3).collect()}
    assert sorted(cut) == [0, 1, 2, 3] and [d for d, x in cut.items() if x.endswith("NOT UNFOLDED")] == [3]
