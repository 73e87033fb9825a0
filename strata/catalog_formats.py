"""Queries over containers and formats: bytes are made from keys, then classified and unfolded."""

from __future__ import annotations

import base64
import bz2
import gzip
import io
import struct
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strata.operators import expand
from strata.operators.classifiers import WHOLE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def built(df: DataFrame, key: str, source: str, make) -> DataFrame:
    """key, payload: ``make(key, source)``. A small file is one task whatever its rows cost, so they are dealt by key first;
    what is made goes on in batches of bounded size."""
    schema = T.StructType([df.schema[key], T.StructField("payload", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            rows = ((k.as_py(), make(k.as_py(), s.as_py())) for k, s in zip(b.column(0), b.column(1), strict=True))
            for part in expand.bounded(rows, lambda row: len(row[1] or b"")):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), arrow, strict=True)], schema=arrow)

    dealt = df.select(key, source).repartition(2 * df.sparkSession.sparkContext.defaultParallelism, key)
    return dealt.mapInArrow(run, schema)


def made(df: DataFrame, key: str, source: str, make) -> DataFrame:
    """Root items whose payload is ``make(key, source)``."""
    return expand.roots(built(df, key, source, make), key, "payload")


def level_digests(items: DataFrame, key: str) -> DataFrame:
    """key, depth, name, digest of all that the items unfold to, without bounds: every row that ``expand`` gives."""
    found = expand.expand(items, limits=WHOLE)
    return found.select(F.col("root").alias(key), "depth", "name", "brief", "digest")


#: Stands before every text, so that also null, empty and short ones make items that are long enough to be looked at.
LEAD = "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ. "
_LEAF = f"md5('{LEAD}' || coalesce(text, ''))"


def led(s: str | None) -> bytes:
    return (LEAD + (s or "")).encode()


@query(f"SELECT doc_id, CAST(1 AS INTEGER) AS depth, 'decompressed_zlib' AS name, {_LEAF} AS digest FROM documents")
def zlib_expand(spark, d):
    """Everything that compressed texts unfold to."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    return level_digests(made(docs, "doc_id", "text", lambda k, s: zlib.compress(led(s), 6)), "doc_id").where("depth > 0").drop("brief")


def _archive(k: int, s: str) -> bytes:
    """By turns gzip, bzip2, a zip, and a zip stored in a zip."""
    if k % 4 == 0:
        return gzip.compress(led(s), mtime=0)
    if k % 4 == 1:
        return bz2.compress(led(s))
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("a.txt"), led(s))
    if k % 4 == 2:
        return inner.getvalue()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo("in.zip"), inner.getvalue())
        z.writestr(zipfile.ZipInfo("b.txt"), LEAD.encode() + led(s)[::-1])
    return out.getvalue()


_BACK = f"md5(unhex(hex(encode('{LEAD}')) || array_to_string(list_reverse(regexp_extract_all(hex(encode('{LEAD}' || coalesce(text, ''))), '..')), '')))"


@query(
    f"SELECT doc_id, CAST(CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 1 END AS INTEGER) AS depth, CASE WHEN doc_id % 4 < 2 THEN 'data' ELSE 'a.txt' END AS name, {_LEAF} AS digest FROM documents "
    f"UNION ALL SELECT doc_id, CAST(1 AS INTEGER), 'b.txt', {_BACK} FROM documents WHERE doc_id % 4 = 3 UNION ALL SELECT doc_id, CAST(1 AS INTEGER), 'in.zip', NULL FROM documents WHERE doc_id % 4 = 3"
)
def archive_expand(spark, d):
    """All members of all levels with their names; the digest of the zip in a zip, which SQL cannot make, is left out by its name."""
    docs = read(spark, d, "documents").select("doc_id", "text")
    found = level_digests(made(docs, "doc_id", "text", _archive), "doc_id").where("depth > 0")
    return found.select("doc_id", "depth", "name", F.when(F.col("name") != "in.zip", F.col("digest")).alias("digest"))


_MEMBER = "concat('m ', p_partkey, chr(233), CASE WHEN p_partkey % 3 = 0 THEN chr(9) ELSE '' END, '.txt')"


@query(
    f"WITH m AS (SELECT p_partkey, {_MEMBER} AS name, 'view the first member of part ' || p_name AS body FROM part) "
    "SELECT p_partkey, CAST(0 AS BIGINT) AS ord, name, regexp_replace(name, '[^\x21-\x7E]', '.', 'g') AS safe_name, md5(body) AS digest FROM m UNION ALL "
    "SELECT p_partkey, 1, 'dir/second.txt', 'dir/second.txt', md5(reverse(body)) FROM m"
)
def children_listing(spark, d):
    """What archives hold, as rows: order, name, sanitised name and digest."""

    def pack(k: int, s: str) -> bytes:
        body, out = f"view the first member of part {s}", io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(f"m {k}\u00e9{chr(9) if k % 3 == 0 else ''}.txt"), body.encode())
            z.writestr(zipfile.ZipInfo("dir/second.txt"), body[::-1].encode())
        return out.getvalue()

    found = expand.expand(made(read(spark, d, "part"), "p_partkey", "p_name", pack), limits=WHOLE)
    return expand.listing(found).select(F.col("root").alias("p_partkey"), "ord", "name", "safe_name", "digest")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def base85_decode(spark, d):
    def there_and_back(_, s: str | None) -> bytes | None:
        return None if s is None else expand.decode_text("BASE85", f"<~{base64.a85encode(s.encode(), wrapcol=76).decode()}~>")

    return built(read(spark, d, "documents"), "doc_id", "text", there_and_back).select("doc_id", F.md5("payload").alias("digest"))


@query(
    "WITH t AS (SELECT *, unnest(range(0, doc_id % 4 + 1)) AS depth FROM documents) "
    f"SELECT doc_id, CAST(depth AS INTEGER) AS depth, CASE WHEN depth < doc_id % 4 THEN CASE WHEN (doc_id % 4 - depth) % 2 = 1 THEN 'ZLIB' ELSE 'GZIP' END END AS wrapper, CASE WHEN depth = doc_id % 4 THEN {_LEAF} END AS digest FROM t"
)
def nested_fixpoint(spark, d):
    """Texts wrapped zero to three times, in turn by zlib and gzip, unfolded until nothing new appears: what is at every level?"""

    def wrap(k: int, s: str) -> bytes:
        data = led(s)
        for i in range(k % 4):
            data = zlib.compress(data, 6) if i % 2 == 0 else gzip.compress(data, mtime=0)
        return data

    docs = read(spark, d, "documents").select("doc_id", "text")
    inside = F.col("depth") < F.col("doc_id") % 4
    return level_digests(made(docs, "doc_id", "text", wrap), "doc_id").select("doc_id", "depth", F.when(inside, F.col("brief")).alias("wrapper"), F.when(~inside, F.col("digest")).alias("digest"))


def _verdicts(items: DataFrame, key: str) -> DataFrame:
    v = expand.classify_items(items)
    return v.select(F.col("root").alias(key), "classifier", "confidence", "brief", "description", "length", F.size("children").alias("n_children"), F.array_join(F.transform("children", lambda c: F.md5(c["payload"])), " ").alias("digests"))


def png(w: int, h: int, body: bytes) -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def gif(w: int, h: int) -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", w, h, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"," + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x02\x02\x44\x01\0" + b";"


def jpg(w: int, h: int) -> bytes:
    return b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + bytes(9) + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03" + bytes(9) + b"\xff\xda\x00\x08" + bytes(6) + b"\x12\x34\xff\xd9"


_AREA = "CAST(p_size AS VARCHAR) || 'x' || CAST(p_partkey % 500 + 1 AS VARCHAR)"


@query(f"SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'GIF' ELSE 'JPG' END AS brief, 100 AS confidence, {_AREA} || CASE p_partkey % 3 WHEN 0 THEN ', 8 bit' WHEN 1 THEN ', 1 frame(s)' ELSE ', No Exif' END AS description, CAST(CASE p_partkey % 3 WHEN 0 THEN 77 WHEN 1 THEN 35 ELSE 53 END AS BIGINT) AS length FROM part")
def image_headers(spark, d):
    def make(k, s):
        w, h = int(s), k % 500 + 1
        return (png(w, h, bytes(20)), gif(w, h), jpg(w, h))[k % 3] + b"\x91" * 100

    return _verdicts(made(read(spark, d, "part"), "p_partkey", "p_size", make), "p_partkey").select("p_partkey", "brief", "confidence", "description", "length")


def ole(streams: list[tuple[str, bytes]]) -> bytes:
    """A compound document of 512-byte sectors: allocation table, directory, mini table, mini streams, large streams."""
    large = [(n, b) for n, b in streams if len(b) >= 4096]
    small = [(n, b) for n, b in streams if len(b) < 4096]
    mini, mini_fat, starts = b"", [], {}
    for n, b in small:
        k = -(-len(b) // 64)
        starts[n] = len(mini_fat)
        mini_fat += [*range(len(mini_fat) + 1, len(mini_fat) + k), 0xFFFFFFFE]
        mini += b + bytes(-len(b) % 64)
    sectors: list[bytes] = [b"", b"", b""]  # 0 table, 1 directory (up to 4 entries), 2 mini table
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE]

    def add(b: bytes) -> int:
        at, n = len(sectors), -(-len(b) // 512)
        sectors.extend(b[i * 512 : i * 512 + 512].ljust(512, b"\0") for i in range(n))
        fat.extend([*range(at + 1, at + n), 0xFFFFFFFE])
        return at

    mini_at = add(mini) if mini else 0xFFFFFFFE
    for n, b in large:
        starts[n] = add(b)

    def entry(name: str, kind: int, right: int, child: int, start: int, size: int) -> bytes:
        raw = name.encode("utf-16-le")
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, 0xFFFFFFFF, right, child) + bytes(36) + struct.pack("<III", start, size, 0)

    names = streams[:3]
    rows = [entry("Root Entry", 5, 0xFFFFFFFF, 1 if names else 0xFFFFFFFF, mini_at, len(mini))]
    rows += [entry(n, 2, i + 2 if i + 1 < len(names) else 0xFFFFFFFF, 0xFFFFFFFF, starts[n], len(b)) for i, (n, b) in enumerate(names)]
    sectors[1] = b"".join(rows).ljust(512, b"\0")
    sectors[2] = struct.pack("<128I", *(mini_fat + [0xFFFFFFFF] * (128 - len(mini_fat))))
    sectors[0] = struct.pack("<128I", *(fat + [0xFFFFFFFF] * (128 - len(fat))))
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    return head + b"".join(sectors)


@query("SELECT s_suppkey, 100 AS confidence, 'compound document, ' || CASE WHEN s_suppkey % 2 = 0 THEN '2' ELSE '1' END || ' stream(s)' AS description, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS n_children, CASE WHEN s_suppkey % 2 = 0 THEN md5(repeat(s_name, 300)) || ' ' ELSE '' END || md5(repeat(s_name, 3)) AS digests FROM supplier")
def ole_streams(spark, d):
    def make(k, s):
        own = [("Small", s.encode() * 3)] + ([("Large", s.encode() * 300)] if k % 2 == 0 else [])
        return ole(own)

    return _verdicts(made(read(spark, d, "supplier"), "s_suppkey", "s_name", make), "s_suppkey").select("s_suppkey", "confidence", "description", "n_children", "digests")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 75 WHEN doc_id % 3 = 0 THEN 50 ELSE 100 END AS confidence, CASE WHEN doc_id % 5 = 0 THEN 'Encrypted PDF document' WHEN doc_id % 3 = 0 THEN 'PDF document' ELSE 'Valid PDF document. 2 pages' END AS description, 2 AS n_children, md5('q w') AS second FROM documents")
def pdf_streams(spark, d):
    def make(k, s):
        pages = b"" if k % 3 == 0 else b"<< /Type /Pages >> << /Type /Page >> << /Type/Page >>\n"
        body = zlib.compress((s or "").encode())
        return b"%PDF-1.4\n\xe2\xe3\xcf\xd3\n" + pages + (b"/Encrypt 1 0 R\n" if k % 5 == 0 else b"") + b"1 0 obj\nstream\n" + body + b"\nendstream\nstream\nq w\nendstream\n%%EOF\n" + b"\x91" * 64

    return _verdicts(made(read(spark, d, "documents"), "doc_id", "text", make), "doc_id").select("doc_id", "confidence", "description", "n_children", F.substring_index("digests", " ", -1).alias("second"))


def mp3(frames: int) -> bytes:
    return b"".join(b"\xff\xfb\x90\x64" + b"\x55" * 413 for _ in range(frames))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'VIDEO (AVI)' WHEN 1 THEN 'AUDIO (MP3)' WHEN 2 THEN 'VIDEO (WMV)' WHEN 3 THEN 'VIDEO (FLV)' ELSE 'VIDEO (MPEG)' END AS brief, CASE WHEN p_partkey % 5 < 2 THEN 100 ELSE 80 END AS confidence FROM part")
def av_detect(spark, d):
    def make(k, s):
        tail = str(s).encode() + b"\x91" * 64
        heads = (b"RIFF" + struct.pack("<I", 92) + b"AVI ", mp3(2 + k % 4), bytes.fromhex("3026B275"), b"FLV\x01\x05", b"\x00\x00\x01\xb3")
        return heads[k % 5] + (b"" if k % 5 == 1 else tail)

    return _verdicts(made(read(spark, d, "part"), "p_partkey", "p_size", make), "p_partkey").select("p_partkey", "brief", "confidence")


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE '60B, ' || CAST(p_size AS VARCHAR) || 'x' || CAST(p_partkey % 300 + 1 AS VARCHAR) || ', 1 plane(s)' END AS description FROM part")
def jbig_header(spark, d):
    """JBIG has no signature, so the classifier is asked directly."""
    from strata.operators.classifiers import jbig

    @F.pandas_udf("string")
    def ask(k: pd.Series, s: pd.Series) -> pd.Series:
        found = [jbig.classify(struct.pack(">BBBBIIIBBBB", 0, 5, 0 if a % 4 == 0 else 1, 0, int(b), a % 300 + 1, 16, 8, 0, 0, 0) + bytes(40)) for a, b in zip(k, s, strict=True)]
        return pd.Series([v.description if v else None for v in found])

    return read(spark, d, "part").select("p_partkey", ask("p_partkey", "p_size").alias("description"))


def fat12(files: list[tuple[str, bytes]], deleted: str = "GONE") -> bytes:
    """A file system of 64 one-sector clusters with one table and sixteen root entries."""
    boot = b"\xeb\x3c\x90MAKEFAT " [:11] + struct.pack("<HBHBHHBH", 512, 1, 1, 1, 16, 67, 0xF8, 1) + bytes(8) + struct.pack("<II", 0, 0) + bytes(14) + b"FAT12   "
    boot = boot[:54] + b"FAT12   " + bytes(448) + b"\x55\xaa"
    table, root, data, c = [0xFF8, 0xFFF], b"", b"", 2
    for name, body in files:
        n = -(-len(body) // 512)
        root += name.ljust(11).encode() + b"\x20" + bytes(14) + struct.pack("<HI", c, len(body))
        table += [*range(c + 1, c + n), 0xFFF]
        data += body.ljust(n * 512, b"\0")
        c += n
    root += b"\xe5" + deleted.ljust(10).encode() + b"\x20" + bytes(14) + struct.pack("<HI", 60, 100)
    packed = bytearray(512)
    for i, v in enumerate(table):
        at = i * 3 // 2
        if i & 1:
            packed[at] |= v << 4 & 0xF0
            packed[at + 1] = v >> 4
        else:
            packed[at], packed[at + 1] = v & 0xFF, packed[at + 1] | v >> 8
    return boot + bytes(packed) + root.ljust(512, b"\0") + data.ljust(64 * 512, b"\0")


@query("SELECT s_suppkey, 'FAT12' AS brief, '34304 bytes (64 units of 512 size)' AS description, 2 AS n_children, md5(s_name) || ' ' || md5(repeat(s_name, CAST(s_suppkey % 200 + 1 AS BIGINT))) AS digests FROM supplier")
def fat_walk(spark, d):
    return _verdicts(made(read(spark, d, "supplier"), "s_suppkey", "s_name", lambda k, s: fat12([("A       TXT", s.encode()), ("B       BIN", s.encode() * (k % 200 + 1))])), "s_suppkey").select("s_suppkey", "brief", "description", "n_children", "digests")
