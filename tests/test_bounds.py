"""Work is dealt to tasks whatever the size of its file, and what a Python worker holds does not grow with the table."""

from __future__ import annotations

from pyspark.sql import functions as F

from strata import catalog_formats as make
from strata.operators import claims, expand


def test_batches_are_bounded():
    assert [len(p) for p in expand.bounded([b"x" * (3 << 20)] * 5 + [b"y" * (20 << 20)] + [b""] * 3, len)] == [2, 2, 1, 1, 3]
    assert list(expand.bounded([], len)) == []


def test_rows_of_one_file_are_many_tasks(spark, tmp_path):
    spark.range(400).withColumn("s", F.lit("name")).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert one.select(F.spark_partition_id().alias("p")).distinct().count() == 1
    made = make.made(one, "id", "s", lambda k, s: bytes(1000))
    assert made.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and made.count() == 400


def test_base85_keeps_nulls(spark, tmp_path):
    spark.createDataFrame([(1, "some text"), (2, None), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["digest"] for r in make.base85_decode(spark, str(tmp_path)).collect()}
    want = {r["doc_id"]: r["digest"] for r in spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", F.md5("text").alias("digest")).collect()}
    assert got == want


def test_tasks_grow_with_the_claims(spark, monkeypatch):
    monkeypatch.setattr(claims, "TASK_ROWS", 50, raising=False)
    rows = spark.range(1000).selectExpr("id % 7 AS k", "id AS w", "id * 3 % 900 AS pos", "id % 5 + 1 AS len")
    got = claims.owned_fragments(rows, "k", "w", "w")
    assert got.rdd.getNumPartitions() == 20
    want: dict = {}
    for k, w, pos, n in rows.orderBy("w").collect():
        for b in range(pos, pos + n):
            want.setdefault((k, b), w)
    assert {(r["k"], b): r["w"] for r in got.collect() for b in range(r["pos"], r["pos"] + r["len"])} == want
