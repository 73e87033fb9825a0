"""The prefix tree against one that holds every node in a dictionary."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strata.llm import prefixtree
from tests.llm import helpers

SCHEMA = "conv_id long, turn long, role string, text string"


def key(role, text):
    r, t = (role or "").encode(), (text or "").encode()
    return hashlib.sha256(str(len(r)).encode() + b":" + r + t).hexdigest()


def nodes(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - c % 5 if c >= 0 else c + (-c) % 5
        seqs[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1].encode()) if s else 0
    out = []
    for s, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(s))))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(seed: int, convs: int, most: int, kinds: int):
    r = random.Random(seed)
    out = [(c, t, r.choice(["user", "assistant", None]), r.choice(["x", "é", "long text"]) * r.randrange(kinds)) for c in range(convs) if c % 7 != 5 for t in range(r.randrange(1, most))]
    out += [(c, t, "user", f"the same {t}") for c in range(convs, convs + 60) for t in range(9)]  # one conversation many times
    out += [(c, t, "user", f"the same {t}") for c in range(convs + 60, convs + 70) for t in range(9 + c % 3)]
    out += [(9000, None, "user", None), (9000, 3, None, ""), (9000, 3, "user", "tie"), (9000, 3, "user", "tie"), (None, 1, "user", "no one's"), (-7, 0, "user", "negative"), (-5, 0, "user", "below zero")]
    out += [(9100, t, "user", f"turn {t}") for t in range(500)] + [(9101, t, "user", f"turn {t}") for t in range(400)]
    r.shuffle(out)
    return out


def found(df):
    return sorted([tuple(r[c] for c in prefixtree.NODES) for r in df.collect()], key=str)


@pytest.mark.parametrize(("segment", "parts"), [(20_000, 1), (1, 3), (2, 8), (7, 5), (40, 16)])
def test_tree(spark, monkeypatch, segment, parts):
    """Equal for every size of segments and number of partitions, from one row each to all rows in one."""
    monkeypatch.setattr(prefixtree, "SEGMENT", segment)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        made = rows(segment, 90, 7, 3)
        df = helpers.clashing(spark.createDataFrame(made, SCHEMA)).repartition(parts)
        assert found(prefixtree.prefix_tree(prefixtree.rebuilt(prefixtree.turns(df)))) == nodes(made)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_small_trees(spark):
    for made in ([], [(3, 0, "user", "one")], [(c, 0, "user", "one") for c in range(20)], [(None, 0, "a", "b")], [(4, None, None, None)] * 12):
        df = spark.createDataFrame(made, SCHEMA)
        assert found(prefixtree.prefix_tree(prefixtree.rebuilt(prefixtree.turns(df)))) == nodes(made)


def test_shared_turns():
    a = [bytes([k]) * prefixtree.TURN for k in range(1, 9)]
    for n in range(9):
        assert prefixtree.shared_turns(b"".join(a), b"".join(a[:n] + [b"\0" * prefixtree.TURN])) == n
    assert prefixtree.shared_turns(b"", b"".join(a)) == 0


def test_contract(spark, tmp_path):
    made = rows(3, 40, 6, 2)
    spark.createDataFrame(made, SCHEMA).withColumn("seg", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(prefixtree.op12_prefix_tree(spark, str(tmp_path))) == nodes(made)
