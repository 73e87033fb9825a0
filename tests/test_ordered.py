"""Lines that come in any order leave in the order of their blocks, also over a restart."""

from __future__ import annotations

import random

from strata.streaming import ordered

SCHEMA = "source string, block long, end long, line string"


def test_shuffled_micro_batches_and_a_restart(spark, tmp_path):
    r = random.Random(2)
    rows, at = [], {"a": 0, "b": 0}
    for _ in range(60):
        s = r.choice("ab")
        end = at[s] + r.choice([1, 1, 3])
        rows.append((s, at[s], end, f"{s}{at[s]}"))
        at[s] = end
    gap = next(x for x in rows if x[0] == "b" and x[1] > at["b"] // 2)
    mixed = [x for x in rows if x != gap]
    r.shuffle(mixed)
    source, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))

    def put(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        try:
            ordered.start(stream, out, cp).awaitTermination()
        finally:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        return sorted((x["source"], x["block"], x["end"], x["line"]) for x in spark.read.parquet(out).collect())

    for part in (mixed[:20], mixed[20:40]):
        put([*part, part[0]])
    first = run()
    for s in "ab":  # a contiguous prefix
        own = [x for x in first if x[0] == s]
        assert [x[1] for x in own] == [0, *[x[2] for x in own]][: len(own)]
    put(mixed[40:])
    put([(None, 1, 2, "no source"), ("a", None, 3, "no place")])
    assert run() == sorted(x for x in rows if x[0] == "a" or x[1] < gap[1])
    put([gap, rows[0]])  # what was missing, and a row that came before
    assert run() == sorted(rows)
