from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from strata.functions import bytes as by
from strata.functions import magic, types

FILL = bytes(0x80 + i * 7 % 101 for i in range(4096))


def codes(*names):
    return [types.BY_NAME[n] for n in names]


def at(offset: int, digits: str, size: int = 2048) -> bytes:
    b = bytes.fromhex(digits)
    return FILL[:offset] + b + FILL[offset + len(b) : size]


CASES = [
    (b"x" * 16, codes("UNIDENTIFIED")),
    (bytes(512), codes("CONSTANT")),
    (bytes([1, 2, 3, 4]) * 128, codes("CONSTANT")),
    ((bytes([1, 2, 3, 4, 5]) * 200)[:512], codes("UNIDENTIFIED")),
    (b" " * 512, codes("TEXT", "BASE64", "BASE85", "HEX", "CONSTANT")),
    (b"0123456789abcdefABCDEF0123456789" + FILL[:480], codes("TEXT", "BASE64", "BASE85", "HEX", "UNIDENTIFIED")),
    (b"Hello, plain sentence with a comma" + FILL[:478], codes("TEXT", "UNIDENTIFIED")),
    (at(0, "89504E470D0A1A0A"), codes("UNIDENTIFIED", "PNG")),
    (at(0, "FFD8FFE0"), codes("UNIDENTIFIED", "JPG")),
    (at(0, "FFFB9064"), codes("UNIDENTIFIED", "MP3")),
    (at(0, "000001B3"), codes("UNIDENTIFIED", "MPEG")),
    (at(0, "789C"), codes("UNIDENTIFIED", "ZLIB")),
    (at(0, "504B0304"), codes("UNIDENTIFIED", "ZIP")),
    (at(54, "46415431"), codes("FAT12", "FAT16", "UNIDENTIFIED")),
    (at(0x438, "53EF"), codes("EXT", "UNIDENTIFIED")),
    (at(0x438, "53EF")[:512], codes("UNIDENTIFIED")),
    (at(510, "55AA"), codes("UNIDENTIFIED", "PART")),
    (at(0, "255044462D"), codes("UNIDENTIFIED", "PDF")),
    (at(1020, "25504446"), codes("UNIDENTIFIED", "PDF")),
    (at(1021, "25504446"), codes("UNIDENTIFIED")),
]


def test_detect(spark):
    df = spark.createDataFrame([(i, bytearray(w)) for i, (w, _) in enumerate(CASES)], "i int, w binary")
    got = {r["i"]: r["t"] for r in df.select("i", magic.detect(F.col("w")).alias("t")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert got[i] == want, (i, got[i], want)


def test_names():
    assert types.type_code("pdf") == 0x30 and types.type_code("nothing") == -1
    assert types.type_human(0x22) == "Gzip" and types.type_human(0xFE) == "Unknown"


def test_integers_and_paths(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02\x03\x04\xff"), "/src/7:mnt-zip/4:mnt-pdf/5", "a b\x07.txt")], "b binary, p string, n string")
    r = df.select(
        by.be_uint(F.col("b"), 0, 4).alias("be"), by.le_uint(F.col("b"), 1, 4).alias("le"), by.path_depth(F.col("p")).alias("d"), by.path_streams(F.col("p")).alias("s"),
        by.path_kinds(F.col("p")).alias("k"), by.basename(F.col("p")).alias("base"), by.safe_name(F.col("n")).alias("n"), by.hex_decode(F.lit("4 1-42 4")).alias("h"), by.base64_decode(F.lit("QU\nJD")).alias("b64"),
    ).first()
    assert (r["be"], r["le"], r["d"], r["s"], r["k"], r["base"]) == (0x01020304, 0xFF040302, 2, ["7", "4", "5"], ["zip", "pdf"], "5")
    assert r["n"] == "a.b..txt" and bytes(r["h"]) == b"AB" and bytes(r["b64"]) == b"ABC"


@pytest.mark.parametrize("block,start", [(512, 0), (512, 2), (1024, 1)])
def test_block_source(spark, tmp_path, block, start):
    from strata.sources import blocks

    data = bytes(i * 31 % 251 for i in range(5000))
    (tmp_path / "image").write_bytes(data)
    blocks.register(spark)
    got = spark.read.format("blocks").option("path", str(tmp_path / "image")).option("blockSize", block).option("startBlock", start).option("blocksPerPartition", 2).load().collect()
    want = {i: data[i * block : i * block + 2048] for i in range(start, -(-len(data) // block))}
    assert {r["block"]: bytes(r["window"]) for r in got} == want and all(r["window_len"] == len(want[r["block"]]) for r in got)


def test_source_without_data(spark, tmp_path):
    from strata.sources.blocks import BlockReader

    (tmp_path / "none").write_bytes(b"")
    with pytest.raises(ValueError):
        BlockReader({"path": str(tmp_path / "none")}).partitions()
