"""Bounds on what items unfold to, and what is registered."""

from __future__ import annotations

import bz2
import gzip
import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from strata.operators import classifiers, expand
from strata.operators.classifiers import WHOLE, Limits, Verdict, archive, ask, zlib_

BIG = b"sound data " * (70_000_000 // 11)


@pytest.mark.parametrize("pack", [lambda d: gzip.compress(d, 1), bz2.compress], ids=["gzip", "bzip2"])
def test_sound_streams_beyond_the_bound(pack):
    data = pack(BIG)
    v = archive.classify(data + b"tail")
    assert v.confidence == 100 and v.length == len(data) and v.description.endswith("TRUNCATED")
    assert len(v.children[0][1]) == 64 << 20
    whole = archive.classify(data, WHOLE)
    assert whole.children[0][1] == BIG and "TRUNCATED" not in whole.description
    broken = archive.classify(data[: len(data) // 2])
    assert broken.confidence == 70 and "CORRUPTED" in broken.description


def test_large_member_is_marked():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 5000)
        z.writestr("b", b"y")
    v = archive.classify(out.getvalue(), Limits(child_bytes=1000))
    assert v.confidence == 100 and "TRUNCATED" in v.description and [len(c) for _, c in v.children] == [1000, 1]


def test_zip_in_zip_is_whole():
    inner, out = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.txt", "inner")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("b.txt", "outer")
    v = archive.classify(out.getvalue() + b"more")
    assert v.length == len(out.getvalue()) and [n for n, _ in v.children] == ["in.zip", "b.txt"]


def test_zlib_ratio():
    data = zlib.compress(b"a" * 100_000)
    assert "TRUNCATED" in zlib_.classify(data).description
    v = zlib_.classify(data, WHOLE)
    assert v.confidence == 100 and v.children[0][1] == b"a" * 100_000 and v.length == len(data)


def test_base85_skips_other_characters():
    import base64

    body = base64.a85encode(b"some bytes to read").decode()
    assert expand.decode_text("BASE85", f"<~{body[:7]}\x7f\u00e9{body[7:]}~>") == b"some bytes to read"


def test_register_and_thresholds(monkeypatch):
    monkeypatch.setattr(classifiers, "_registered", {})
    classifiers.register("mine", lambda data: Verdict("mine", 60, "MINE", "made"))
    assert ask(["mine"], b"x").brief == "MINE"
    assert ask(["mine"], b"x", thresholds={"mine": 70}) is None

    def crash(data):
        raise RuntimeError("broken")

    classifiers.register("first", crash)
    assert ask(["first", "mine"], b"x").classifier == "mine"


def test_items_without_payload(spark):
    rows = spark.createDataFrame([(1, None), (2, b""), (3, zlib.compress(bytes(range(32, 120))))], "id long, data binary")
    found = expand.expand(expand.roots(rows, "id", "data"), limits=WHOLE)
    got = {r["root"]: r["confidence"] for r in found.where("depth = 0").collect()}
    assert got == {1: -1, 2: -1, 3: 100} and found.where(F.col("depth") == 1).count() == 1
    assert expand.expand(expand.roots(rows.limit(0), "id", "data")).count() == 0


def test_a_hanging_classifier_is_left(monkeypatch):
    import time

    monkeypatch.setattr(classifiers, "_registered", {})

    def hang(data):
        while True:
            time.sleep(0.01)

    classifiers.register("hang", hang)
    classifiers.register("mine", lambda data: Verdict("mine", 60, "MINE", "made"))
    began = time.monotonic()
    assert ask(["hang", "mine"], b"x", limits=Limits(timeouts={"hang": 0.2})).classifier == "mine"
    assert time.monotonic() - began < 5
