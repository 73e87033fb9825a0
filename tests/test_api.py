"""A file of many kinds of items, against a plain walk from left to right."""

from __future__ import annotations

import bz2
import gzip
import io
import random
import zipfile
import zlib

import pytest

from strata import api
from strata.functions import magic
from strata.operators import expand, markers
from strata.operators.classifiers import Limits


def kinds(rng: random.Random) -> list[bytes]:
    words = lambda n: " ".join(rng.choice(["some", "words", "of", "text", "w x y z"]) for _ in range(n)).encode()
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_STORED) as z:
        z.writestr("a.txt", words(900))
        z.writestr("b.bin", rng.randbytes(6000))
    pdf = b"%PDF-1.4\n/Type /Page \n1 0 obj\nstream\n" + zlib.compress(words(200)) + b"\nendstream\n%%EOF\n"
    return [
        bytes(512 * rng.randint(1, 9)), b"\xaa\xbb\xcc\xdd" * 128 * rng.randint(1, 3), words(10), words(3000), words(40) + bytes(700), rng.randbytes(1700), zlib.compress(rng.randbytes(3000)),
        zlib.compress(words(5000)), gzip.compress(words(400)), gzip.compress(rng.randbytes(20000)), gzip.compress(rng.randbytes(9000))[:-700], bz2.compress(words(3000)), packed.getvalue(), packed.getvalue()[:9000],
        pdf, pdf[:-8], b"\xff\xfb\x90\x64" + rng.randbytes(600), b"\xff\xd8\xff\xe0" + rng.randbytes(900), b"RIFF\x00\x08\x00\x00AVI " + rng.randbytes(2040), bytes(510) + b"\x55\xaa",
    ]


def image(seed: int, n: int) -> bytes:
    rng = random.Random(seed)
    out = b""
    for _ in range(n):
        piece = rng.choice(kinds(rng))
        out += piece + rng.choice([b"\0", b"\x91"]) * (-len(piece) % 512)
    return out


def walk(spark, data: bytes) -> list[tuple[int, int]]:
    """(block, claim_end) of the items: each block in turn with all that follows it."""
    windows = [(i, bytearray(data[i * 512 : i * 512 + 2048])) for i in range(-(-len(data) // 512))]
    seen = spark.createDataFrame(windows, "block long, window binary").select("block", magic.detect(magic.F.col("window")).alias("types")).orderBy("block").collect()
    kept, covered = [], 0
    for r in seen:
        names = expand.asked(r["types"])
        if r["block"] < covered or not names or r["types"] == [0x61]:
            continue
        v = api.ask(names, data[r["block"] * 512 :], {"text": api.text_span}, Limits())
        if v is not None and v.confidence > 0:
            covered = r["block"] + max(1, -(-v.length // 512))
            kept.append((r["block"], covered))
    return kept


@pytest.mark.parametrize(("seed", "range_blocks"), [(2, 24), (3, 64), (4, 1 << 17)])
def test_items_own_the_blocks_that_a_walk_gives_them(spark, tmp_path, seed, range_blocks):
    data = image(seed, 60)
    path = tmp_path / "disk"
    path.write_bytes(data)
    windows = [(i, bytearray(data[i * 512 : i * 512 + 2048])) for i in range(-(-len(data) // 512))]
    seen = spark.createDataFrame(windows, "block long, window binary").select("block", magic.detect(magic.F.col("window")).alias("types"))
    candidates = seen.where("types != array(97) and types != array(96)")
    kept = api.root_items(candidates, str(path), 512, api.MAX_ITEM, Limits(), None, range_blocks).collect()
    assert sorted((r["block"], r["claim_end"]) for r in kept) == walk(spark, data)


def test_lines_of_items_runs_and_blocks(spark, tmp_path):
    data = image(1, 40)
    path = tmp_path / "disk"
    path.write_bytes(data)
    want = walk(spark, data)
    lines = [r["line"] for r in api.classify(spark, str(path), style=2).collect()]
    got = [(int(x.split()[0]) // 512, int(x.split()[0]) // 512 + int(x.split("# ")[1].split()[0])) for x in lines if " Constant " not in x]
    assert got == want
    blocks = [r["line"] for r in api.classify(spark, str(path)).collect()]
    assert len(blocks) == -(-len(data) // 512) == len({x[:13] for x in blocks})
    owned = {b for a, e in want for b in range(a, e)}
    shown = {int(x[:13]) // 512 for x in blocks if x.split()[1] not in ("Constant", "Unidentified")}
    assert shown == owned & set(range(len(blocks)))
    runs = [(int(x.split()[0]) // 512, int(x.split("# ")[1].split()[0])) for x in lines if " Constant " in x]
    constant = {int(x[:13]) // 512 for x in blocks if x.split()[1] == "Constant"}
    assert {b for a, n in runs for b in range(a, a + n)} == constant and sum(n for _, n in runs) == len(constant)


def test_bytes_that_are_read(tmp_path):
    """A long text is looked at once, with at most a third more than its bytes and one read ahead."""
    path = tmp_path / "text"
    path.write_bytes(b"words of a text " * 500_000)
    read = 0

    class Counted(api.Reader):
        def read(self, at, n):
            nonlocal read
            read += n
            return super().read(at, n)

    with open(path, "rb") as f:
        v, n = api.span_at(Counted(f, 8_000_000), 0, ["text"], 64 << 20, Limits())
    assert v.length == n == 8_000_000 and read < 30_000_000


def test_bytes_that_damaged_items_take(tmp_path):
    """Without an end marker ahead no more than a megabyte is read, with one no more than up to a megabyte behind it."""
    rng = random.Random(5)
    noise = rng.randbytes(1 << 20).replace(b"%%EOF", b"").replace(b"PK", b"").replace(b"\xff\xd9", b"") * 40
    pdf = b"%PDF-1.4\n/Type /Page \n"
    for name, head, tail, ends in (("pdf", pdf, b"", []), ("compression", b"PK\x03\x04" + bytes(60), b"", []), ("image", make_jpg(), b"", []), ("pdf", pdf, b"%%EOF", [2_000_000])):
        data = head + noise[: 2_000_000 - len(head)] + tail + noise
        (tmp_path / "f").write_bytes(data)
        most = 0

        class Counted(api.Reader):
            def read(self, at, n):
                nonlocal most
                most = max(most, n)
                return super().read(at, n)

        with open(tmp_path / "f", "rb") as f:
            found = api.span_at(Counted(f, len(data)), 0, [name], 64 << 20, Limits(), None, ends)
        assert most <= (ends[0] if ends else 0) + (1 << 20) and (not ends or found[0].length == 2_000_005)


def make_jpg() -> bytes:
    from strata.catalog_formats import jpg

    return jpg(8, 9)[:-2]


def test_markers_across_borders(spark):
    """Every marker is found once, at the block in which it begins, and the next one for every place."""
    rng = random.Random(8)
    data = bytearray(rng.randbytes(9000).replace(b"\xff\xd9", b"  "))
    want = {("pdf", p) for p in (0, 509, 600, 1024, 3000)} | {("zip", p) for p in (40, 2046)} | {("jpg", p) for p in (1535, 5000, 5002)} | {("png", 8996)}
    for name, p in want:
        data[p : p + len(markers.MARKERS[name])] = markers.MARKERS[name]
    rows = [("a", i, bytearray(data[i * 512 : i * 512 + 1024])) for i in range(-(-len(data) // 512))] + [("b", 0, bytearray(b"nothing")), (None, 0, None)]
    marks = markers.end_markers(spark.createDataFrame(rows, "k string, block long, window binary"), "k")
    assert {(r["marker"], r["pos"]) for r in marks.collect()} == want and marks.count() == len(want)
    asked = [("a", m, p, p) for m in markers.MARKERS for p in range(0, 9000, 50)] + [("b", "pdf", 0, 1)]
    for size in (64, 1000, 1 << 24):
        got = markers.next_markers(spark.createDataFrame(asked, "k string, marker string, pos long, mine long"), marks, "k", size).collect()
        assert {(r["k"], r["marker"], r["pos"], r["mine"]): r["end"] for r in got} == {(k, m, p, x): min((e for n, e in want if n == m and e >= p and k == "a"), default=None) for k, m, p, x in asked}
        assert len(got) == len(asked)


def test_an_item_beyond_the_bound_says_so(spark, tmp_path):
    (tmp_path / "text").write_bytes(b"words of a text " * 4096)
    lines = [r["line"] for r in api.classify(spark, str(tmp_path / "text"), max_item=16384, style=1).collect()]
    assert len(lines) == 4 and all("TRUNCATED" in x for x in lines[:3])
