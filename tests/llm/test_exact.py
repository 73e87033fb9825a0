"""Exact duplicates by the stream against a grouping in plain Python."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strata.llm import streamdedup
from tests.llm import helpers

ROWS = [*helpers.documents(), (30, " one\ttwo\x0b\n"), (31, "one  two  "), (32, "onetwo"), (33, "one two"), (34, None), (35, ""), (2, "again"), (2, "again"), (None, "again "), (None, None)]
ROWS = [r if len(r) == 5 else (*r, "en", "s", len(r[1] or "")) for r in ROWS]


def grouped(rows):
    """(id, keep_id, group_size, kept) of every row, sorted."""
    groups = defaultdict(list)
    for at, (i, t, *_) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, at, i))
    out = []
    for g in groups.values():
        g.sort()
        out += [(x[4], g[0][4], len(g), k == 0) for k, x in enumerate(g)]
    return sorted(out, key=str)


def table(spark, path, rows, parts=3):
    helpers.clashing(helpers.frame(spark, rows)).withColumn("digest", F.lit("x")).withColumn("file", F.lit("x")).repartition(parts).write.mode("append").parquet(str(path))


def found(df):
    return sorted([(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect()], key=str)


@pytest.mark.parametrize("digest", [streamdedup.sha256, lambda c: F.pmod(F.crc32(c), F.lit(3)).cast("string")], ids=["sha256", "three digests"])
def test_groups(spark, tmp_path, digest):
    """With three digests for all texts only the check of full bytes tells them apart."""
    table(spark, tmp_path / "t", ROWS)
    assert found(streamdedup.deduplicate(spark, str(tmp_path / "t"), digest=digest)) == grouped(ROWS)


def test_without_broadcasts(spark, tmp_path, monkeypatch):
    table(spark, tmp_path / "t", ROWS)
    monkeypatch.setattr(streamdedup, "BROADCAST_ROWS", 0)
    for digest in (streamdedup.sha256, lambda c: F.pmod(F.crc32(c), F.lit(3)).cast("string")):
        assert found(streamdedup.deduplicate(spark, str(tmp_path / "t"), digest=digest)) == grouped(ROWS)


def test_state_goes_on(spark, tmp_path):
    """A second run reads new files only, one a micro-batch, and later rows may take the place of earlier ones."""
    source, at = str(tmp_path / "t"), str(tmp_path / "state")
    table(spark, source, ROWS)
    streamdedup.ingest(spark, source, at, files_per_trigger=1)
    more = [(50, "one two" + " " * 40, "en", "s", 0), (51, "new", "en", "s", 0)]
    table(spark, source, more, 1)
    assert found(streamdedup.deduplicate(spark, source, at, files_per_trigger=1)) == grouped(ROWS + more)
    assert streamdedup.held(spark, at).agg(F.sum("n")).first()[0] == len(ROWS) + 2
    first = [x for x in streamdedup.held(spark, at).collect() if x["keep_id"] == 50]
    assert len(first) == 1 and first[0]["keep_row"] == 0 and first[0]["keep_file"].endswith(".parquet")


def test_empty_and_hot(spark, tmp_path):
    table(spark, tmp_path / "none", [])
    assert found(streamdedup.deduplicate(spark, str(tmp_path / "none"))) == []
    rows = [(k, "the same text" + " " * (k % 7), "en", "s", 0) for k in range(3000)] + [(5000 + k, f"text {k // 2}", "en", "s", 0) for k in range(400)]
    table(spark, tmp_path / "hot", rows, 5)
    assert found(streamdedup.deduplicate(spark, str(tmp_path / "hot"))) == grouped(rows)


def test_contract(spark, tmp_path):
    import hashlib

    helpers.frame(spark, [(1, "a b", "en", "s", 3), (2, None, "en", "s", 0)]).write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in streamdedup.op11_stream_dedup(spark, str(tmp_path)).collect()}
    assert rows[1]["text_sha256"] == hashlib.sha256(b"ab").hexdigest() and rows[2]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[1]["kept"] and rows[1]["group_size"] == 1 and rows[1]["keep_id"] == 1
