from __future__ import annotations

import base64

from pyspark.sql import functions as F

from strata.functions import text

HTML = "<html><head><title>x</title></head><body><p>w</p></body></html>"
CASES = [
    (" \n" * 20, ("WHITESPACE", 100)),
    ("<a><b>x</b><c>y</c><d>z</d></a>  ", ("XML", 80)),
    (HTML, ("HTML", 62)),
    ("0123456789abcdef" * 4, ("HEX", 100)),
    (base64.b64encode(bytes(range(200, 248))).decode(), ("BASE64", 100)),
    ("a,b,c\n" * 10, ("BASE85", 100)),
    ("x,y,z\n" * 10, ("CSV", 100)),
    ("2024-01-01 00:00:01 message\n" * 10, ("BASE85", 100)),
    ("2024-01-01 00:00:01 why\n" * 10, ("CSV", 100)),
    ("".join(f"2024-01-01 00:00:01 {'w ' * (i * i % 37)}why\n" for i in range(20)), ("LOG", 100)),
    ("[ 12.5] one line of a log with w and no break", ("TEXT", 100)),
    ("a" * 31, None),
    ("One line of prose with a letter v, w, x.", ("TEXT", 100)),
]


def test_cascade(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["v"] for r in df.select("i", text.verdict(F.col("t")).alias("v")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert (tuple(got[i]) if got[i] else None) == want, (i, got[i], want)


def test_prefix(spark):
    df = spark.createDataFrame([(bytearray("abc\tdéf".encode()),), (bytearray(b"\x00x"),)], "b binary")
    assert [r["p"] for r in df.select(text.printable_prefix(F.col("b")).alias("p")).collect()] == ["abc\td", ""]
