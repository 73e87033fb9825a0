from __future__ import annotations

import base64
import bz2
import gzip
import io
import struct
import tarfile
import zipfile
import zlib

import pytest

from strata import catalog_formats as make
from strata.operators.classifiers import Verdict, archive, ask, av, fat, image, jbig, mbr, ole, pdf, zlib_
from strata.operators.expand import decode_text


def zipped(**members: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, b in members.items():
            z.writestr(n.replace("__", "/"), b)
    return out.getvalue()


def test_zlib():
    body = bytes(range(256)) * 4
    v = zlib_.classify(zlib.compress(body) + b"tail")
    assert (v.confidence, v.children) == (100, [("decompressed_zlib", body)])
    assert zlib_.classify(zlib.compress(bytes(i * i % 251 for i in range(3000)))[:-9]).confidence == 75
    with pytest.raises(zlib.error):
        zlib_.classify(b"\x78\x9cnothing of the kind")


def test_archives():
    v = archive.classify(zipped(**{"a.txt": b"text", "b.bin": b"\1\2"}) + b"trailing bytes")
    assert v.confidence == 100 and v.children == [("a.txt", b"text"), ("b.bin", b"\1\2")] and v.length == len(zipped(**{"a.txt": b"text", "b.bin": b"\1\2"}))
    docx = archive.classify(zipped(**{"[Content_Types].xml": b"x", "_rels__.rels": b"x", "word__document.xml": b"x"}))
    assert (docx.brief, docx.description) == ("DOCX", "OfficeX Document")
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w") as t:
        info = tarfile.TarInfo("x")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert archive.classify(gzip.compress(tar.getvalue())).children == [("x", b"abc")]
    assert archive.classify(bz2.compress(b"abc")).children == [("data", b"abc")]
    cut = archive.classify(gzip.compress(bytes(i * i % 251 for i in range(5000)))[:-20])
    assert cut.confidence == 70 and cut.description.endswith("CORRUPTED")
    assert archive.classify(zipped(a=b"b")[:20]).confidence == 60


def test_pdf():
    body = b"%PDF-1.4\n<< /Type /Page >> << /Type /Pages >>\nstream\nabc\nendstream stream\r\ndef\r\nendstream\n%%EOF"
    v = pdf.classify(body + b" more")
    assert (v.confidence, v.description, v.children, v.length) == (100, "Valid PDF document. 1 pages", [("0", b"abc"), ("1", b"def")], len(body))
    assert pdf.classify(body.replace(b"%%EOF", b"")) is None and pdf.classify(b"%PDF %%EOF").confidence == 50
    assert pdf.classify(b"%PDF /Encrypt %%EOF").confidence == 75


def test_images():
    for b, size in ((make.png(7, 9, b"x" * 300), "7x9"), (make.gif(7, 9), "7x9"), (make.jpg(7, 9), "7x9")):
        v = image.classify(b + b"\x91" * 50)
        assert v.description.startswith(size) and v.length == len(b) and v.confidence == 100
    assert image.classify(b"\xff\xd8\xff\xe0") is None


def test_audio_and_video():
    assert av.classify(make.mp3(5) + bytes(40)).length == 5 * 417
    assert av.classify(make.mp3(1)).confidence == 25 and av.classify(b"RIFF" + struct.pack("<I", 4) + b"AVI ").confidence == 100
    assert av.classify(b"FLV\x01\x05") is not None and av.classify(bytes(100)) is None


def test_jbig():
    head = struct.pack(">BBBBIIIBBBB", 0, 5, 1, 0, 30, 40, 16, 8, 0, 0, 0)
    assert jbig.classify(head).description == "20B, 30x40, 1 plane(s)"
    assert jbig.classify(head[:10]) is None and jbig.classify(bytes(20)) is None


def test_ole():
    v = ole.classify(make.ole([("Small", b"abc" * 30), ("Large", b"xyz" * 2000)]))
    assert v.confidence == 100 and dict(v.children) == {"Small": b"abc" * 30, "Large": b"xyz" * 2000}
    assert ole.classify(bytes(512)).confidence == 0 and ole.classify(ole.MAGIC).confidence == 50
    assert ole.chain([1, 0], 0) == [0, 1]  # a loop ends


def test_boot_record():
    def entry(boot, kind, first, n):
        return struct.pack("<8B2I", boot, 1, 1, 0, kind, 254, 255, 255, first, n)

    own = bytes(446) + entry(0x80, 0x83, 1, 10) + entry(0, 0x05, 2, 20) + bytes(32) + b"\x55\xaa"
    inner = bytes(446) + entry(0, 0x0B, 1, 5) + bytes(48) + b"\x55\xaa"
    v = mbr.classify(own + bytes(512) + inner)
    assert v.confidence == 100 and v.description == "Linux (10 sectors), Extended (20 sectors), W95 FAT32 (5 sectors)"
    assert mbr.classify(own).confidence == 100 and mbr.classify(own + bytes(1024)).confidence == 50
    assert mbr.classify(bytes(512)).confidence == 0 and mbr.classify(bytes(510) + b"\x55\xaa").confidence == 50


def test_fat():
    v = fat.classify(make.fat12([("A       TXT", b"hello"), ("B       BIN", b"z" * 1500)]))
    assert v.brief == "FAT12" and [n for n, _ in v.stored] == ["A.TXT", "B.BIN"] and v.stored[1][1][0][1] == 1500
    v = ask(["sleuth"], make.fat12([("A       TXT", b"hello"), ("B       BIN", b"z" * 1500)]))
    assert v.children == [("A.TXT", b"hello"), ("B.BIN", b"z" * 1500)]
    assert fat.classify(b"\xeb\x52\x90NTFS    " + bytes(600)).confidence == 100 and fat.classify(bytes(600)).confidence == 0


def test_decoders():
    assert decode_text("BASE64", base64.b64encode(b"abc").decode() + "\n") == b"abc" and decode_text("BASE64", "%%") == b""
    assert decode_text("BASE85", "<~" + base64.a85encode(b"abcd    ", foldspaces=True).decode() + "~>") == b"abcd    "
    assert decode_text("HEX", "41 42\n4") == b"AB" and decode_text("TEXT", "x") == b""


def test_faults_go_to_the_next():
    def crash(data):
        raise MemoryError

    ok = lambda data: Verdict("text", 80, "T", "t", 1, "text", [("none", b""), ("some", b"x")])
    low = lambda data: Verdict("low", 40, "L", "l")
    v = ask(["crash", "low", "absent", "ok"], b"", {"crash": crash, "low": low, "ok": ok})
    assert v.classifier == "text" and v.children == [("some", b"x")]
    assert ask(["crash"], b"", {"crash": crash}) is None
