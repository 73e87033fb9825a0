"""Ranked search against scoring every document for every item."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strata.llm import wavelet
from strata.llm.common import word_hashes
from tests.llm import helpers

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=10):
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs]
    n_all, l_all = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    w = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n_all // l_all if l_all else 0
            s = sum(w[t] * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t in terms(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed=5, n=300):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdé") for _ in range(r.randrange(1, 4))) for _ in range(80)]
    text = lambda m: " ".join(vocabulary[min(int(r.expovariate(0.08)), 79)] for _ in range(m))
    docs = helpers.documents() + [(100 + k, text(r.randrange(1, 60)), "en", "s", 0) for k in range(n)]
    docs += [(1000 + k, "equal Texts, many-times equal", "en", "s", 0) for k in range(80)] + [(7, "again seven", "en", "s", 0), (7, "again seven", "en", "s", 0), (-3, "again minus", "en", "s", 0)]
    docs += [(5000, text(5000), "en", "s", 0), (5001, "!!! ... ---", "en", "s", 0), (None, "again null", "en", "s", 0)]
    items = [(k, text(r.randrange(1, 25))) for k in range(40)] + [(50, None), (51, ""), (52, "zzz unknown"), (53, "equal"), (54, "again again AGAIN"), (55, "one_two-ÉA 3x"), (53, "texts"), (None, "equal texts")]
    return docs, items


def found(df):
    return sorted([(r["item"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()], key=str)


@pytest.mark.parametrize(("shard", "best", "items", "k"), [(2048, 8, 1024, 10), (1, 1, 3, 10), (16, 2, 7, 3), (100, 64, 1024, 25)])
def test_search(spark, monkeypatch, shard, best, items, k):
    """Equal for every size of shards, of the steps taken at once and of blocks of queries."""
    monkeypatch.setattr(wavelet, "SHARD_DOCS", shard)
    monkeypatch.setattr(wavelet, "BEST", best)
    monkeypatch.setattr(wavelet, "BLOCK_ITEMS", items)
    docs, asked = corpus(n=300 if shard > 1 else 60)
    df = helpers.clashing(helpers.frame(spark, docs)).repartition(3)
    queries = spark.createDataFrame(asked, "item_id long, text string").withColumn("score", F.lit("x"))
    assert found(wavelet.ranked_search(df, queries, k)) == ranked(docs, asked, k)


def test_nothing(spark):
    queries = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert found(wavelet.ranked_search(helpers.frame(spark, []), queries)) == []
    assert found(wavelet.ranked_search(helpers.frame(spark, [(1, " .,", "en", "s", 0)]), queries)) == []
    assert found(wavelet.ranked_search(helpers.frame(spark), queries.where("item_id > 1"))) == []


def test_terms_of_a_column():
    texts = ["Ab a1-b_c", None, "", "é,É x\x00y", "...", "z" * 3000, "a"]
    hashes, first = word_hashes(pa.array(texts), wavelet.BETWEEN, wavelet.VALUES)
    assert np.diff(first).tolist() == [len(terms(t)) for t in texts] == wavelet.term_counts(pa.array(texts)).tolist()
    flat = [t for x in texts for t in terms(x)]
    assert len(set(hashes.tolist())) == len(set(flat)) and (hashes[:, None] == hashes[None, :]).tolist() == [[a == b for b in flat] for a in flat]


def test_shard_is_dual_sorted():
    """A term's postings fall by impact at the root and within every node of every level, and lead to the document's number."""
    r = np.random.default_rng(3)
    n = r.integers(1, 30, 90)
    hashes = r.integers(0, 25, n.sum()).astype(np.uint64)
    ids = r.permutation(90)
    shard = wavelet.Shard(*wavelet.build(ids, np.zeros(90, bool), n, hashes, 90, int(n.sum())))
    assert shard.ids.tolist() == sorted(ids.tolist())
    held = {(t, i): c for i, h in zip(ids, np.split(hashes, np.cumsum(n)[:-1]), strict=True) for t, c in Counter(h.tolist()).items()}

    def walk(level, lo, hi, number):
        impacts = shard.impacts[level, lo:hi]
        assert (np.diff(impacts.astype(np.int64)) <= 0).all()
        if level == shard.depth:
            return [(number, hi - lo)]
        a, b, z = shard.ones[level, lo], shard.ones[level, hi], shard.zeros[level]
        return (walk(level + 1, lo - a, hi - b, number * 2) if hi - b > lo - a else []) + (walk(level + 1, z + a, z + b, number * 2 + 1) if b > a else [])

    for k, t in enumerate(shard.terms.tolist()):
        leaves = walk(0, int(shard.first[k]), int(shard.first[k + 1]), 0)
        assert [x for _, x in leaves] == [1] * len(leaves)
        assert [shard.ids[d] for d, _ in leaves] == sorted(i for u, i in held if u == t)
