"""Compressed bytes bear the marks of boot records and volumes by chance: they are unfolded all the same."""

from __future__ import annotations

import gzip
import hashlib
import io
import random
import zipfile
import zlib

import pytest

from strata.operators import expand
from strata.operators.classifiers import ask, fat, registry

MARKS = {"PART": (510, b"\x55\xaa"), "EXT": (0x438, b"\x53\xef")}


def packed(kind: str, body: bytes) -> bytes:
    """The body in a container that holds it as it is."""
    if kind == "zlib":
        return b"\x78\x9c" + zlib.compress(body, 0)[2:]
    if kind == "gzip":
        return gzip.compress(body, compresslevel=0, mtime=0)
    if kind == "pdf":
        return b"%PDF-1.4\n\xe2\xe3\xcf\xd3\n1 0 obj\nstream\n" + body + b"\nendstream\n%%EOF\n"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo("a.bin"), body)
    return out.getvalue()


def marked(kind: str, mark: str) -> tuple[bytes, bytes]:
    at, digits = MARKS[mark]
    body = bytes(random.Random(at).choices(range(0x80, 0xF0), k=3000))
    at -= packed(kind, body).index(body)
    body = body[:at] + digits + body[at + 2 :]
    return packed(kind, body), body


@pytest.mark.parametrize("mark", sorted(MARKS))
def test_containers_with_marks_are_unfolded(spark, mark):
    made = {k: marked(n, mark) for k, n in enumerate(("zlib", "gzip", "pdf", "zip"))}
    items = expand.roots(spark.createDataFrame([(k, bytearray(p)) for k, (p, _) in made.items()], "k long, payload binary"), "k", "payload")
    assert all(x["is"] for x in expand.classify_items(items).selectExpr(f"exists(types, t -> t = {0x55 if mark == 'PART' else expand.BY_NAME['EXT']}) AS is").collect())
    found = {(x["root"], x["depth"]): x for x in expand.expand(items).collect()}
    assert [found[k, 0]["classifier"] for k in range(4)] == ["zlib", "compression", "pdf", "compression"]
    assert [found[k, 1]["digest"] for k in range(4)] == [hashlib.md5(body).hexdigest() for _, body in made.values()]


def test_marks_alone_are_still_told():
    filler = bytes(random.Random(1).choices(range(0x80, 0xF0), k=510))
    alone = filler + b"\x55\xaa"
    v = ask(["partitiontable", "compression"], alone, reg=registry())
    assert v.classifier == "partitiontable" and v.confidence == 50
    volume = bytearray(2048)
    volume[0x438:0x43C] = b"\x53\xef\x01\x00"
    volume[0x418] = 2
    assert fat.classify(bytes(volume)).brief == "EXT"
