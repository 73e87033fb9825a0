"""Operators that work row by row: quality, toxicity, tokens, packing, sharding."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import bpe, packing, pfor, quality, sharding, toxicity
from tests.llm import helpers
from strata.llm.tokens import ChunkEncoder
from tests.llm.helpers import SCHEMA, clashing, documents, frame, prose, quality_counts

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")


def library_ids(name):
    t = tokenizers.Tokenizer.from_file(P.path(name))
    return t, {i: t.encode(x or "", add_special_tokens=False).ids for i, x, *_ in documents()}


def test_quality_counts_and_verdicts(spark):
    found = quality.apply_rules(clashing(frame(spark)), keep=["doc_id"]).select("row_.doc_id", *[f"m_.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], "base_failed", "kept").collect()
    assert len(found) == len(documents())
    for r in found:
        text = next(t for i, t, *_ in documents() if i == r["doc_id"])
        want = quality_counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, r["doc_id"]
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in found if r["kept"]}
    assert {1, 2, 3, 4, 5, 12, None} <= kept and not kept & {6, 7, 8, 9, 14, 15, 16}


def test_quality_order_changes_nothing(spark):
    df = frame(spark)
    m, c = quality.measures(df, keep=["doc_id"]), quality.measured()
    orders = [[{"rule": r} for r in rules] for rules in (quality.rules(), quality.rules()[::-1])]
    one, two = ([(r[0], r[1]) for r in m.select("row_.doc_id", quality.verdict(o, c, quality.base_failed(c))).collect()] for o in orders)
    assert sorted(one, key=str) == sorted(two, key=str)
    kept = {r["doc_id"] for r in quality.filter_quality(df).select("doc_id").collect()}
    assert kept == {i for i, k in one if k}


def test_costly_rules_come_last(spark):
    """Of two rules that reject the same, the costly one is always asked second, and rejected rows never reach it."""
    rows = [(k, f"{'bad' if k % 2 else 'good'} {prose(k, 300)}", "en", "s", 0) for k in range(60)]
    bad = lambda c: F.startswith(c["text"], F.lit("bad"))
    slow = lambda c: bad(c) & (F.size(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2(F.concat(c["text"], i.cast("string")), 512)))) > 0)
    asked = [quality.Rule("a_slow", slow), quality.Rule("cheap", bad)]
    for _ in range(10):
        assert [x["rule"].name for x in quality.cascade_order(frame(spark, rows), asked=asked)] == ["cheap", "a_slow"]
    trap = quality.Rule("trap", lambda c: F.when(bad(c), F.raise_error(F.lit("asked"))).otherwise(False).cast("boolean"))
    c = quality.counts(F.col("text"), F.col("w"))
    rows_ = quality._rows(frame(spark, rows), "text", ["doc_id"])
    got = rows_.select(quality.verdict([{"rule": asked[1]}, {"rule": trap}], c, c["n_words"] < 10).alias("k")).where("k").count()
    assert got == 30


def test_quality_filter_keeps_columns_and_rows(spark):
    df = clashing(frame(spark, documents() * 2))
    kept = quality.filter_quality(df)
    assert kept.columns == df.columns and kept.where("doc_id = 1").count() == 2
    assert quality.filter_quality(frame(spark, [])).count() == 0


def test_sharding(spark):
    rows = documents() * 3
    out = sharding.shard_rows(clashing(frame(spark, rows)), shards=4).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert len(out) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    text = {i: t or "" for i, t, *_ in documents()}
    assert all(r["size"] == len(text[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) for r in out)
    assert sharding.shard_rows(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 100, 1021])
def test_permutation_is_one(spark, n):
    got = [r["p"] for r in spark.range(n).select(sharding.permuted(F.col("id"), n, 5).alias("p")).collect()]
    assert sorted(got) == list(range(n)) and (n < 50 or got != sorted(got))


@pytest.mark.parametrize("n", [2, 5, 17, 101, 1021, 2026])
def test_walks_go_on_until_all_have_arrived(spark, n):
    """Whatever number of steps is tried first, no row is left outside, and the order is that of very long walks."""
    for seed in (5, 6, 7):
        walks = sharding.longest_walk(spark, n, seed, first=1)
        rows = spark.range(n).select(sharding.permuted(F.col("id"), n, seed, walks).alias("p"), sharding.permuted(F.col("id"), n, seed, 200).alias("q")).collect()
        assert sorted(r["p"] for r in rows) == list(range(n)) and all(r["p"] == r["q"] for r in rows)


def test_block_codec():
    r = np.random.default_rng(1)
    for n in (0, 1, 127, 128, 129, 1000):
        for hi in (1, 2, 50_000, 2**32 - 1):
            ids = r.integers(0, hi, n)
            ids[r.random(n) < 0.05] = 4_000_000_000
            data = pfor.encode_ids(ids)
            assert (pfor.decode_ids(data) == ids).all()
            assert all((pfor.decode_block(data, k) == ids[k * 128 : k * 128 + 128]).all() for k in range(-(-n // 128)))
    with pytest.raises(ValueError):
        pfor.decode_segment(b"nonsense")


def test_token_files(spark, tmp_path):
    _, ids = library_ids("word_bpe_49k.json")
    pfor.write_token_files(clashing(frame(spark)), str(tmp_path / "t"), P.path("word_bpe_49k.json"))
    back = {r["doc_id"]: r for r in pfor.read_token_files(spark, str(tmp_path / "t")).collect()}
    start = 0
    for i in sorted(ids, key=lambda x: (x is not None, x)):
        want = np.array([*ids[i], 2], "<u4").tobytes()
        assert (back[i]["start"], bytes(back[i]["ids"])) == (start, want), i
        start += len(want) // 4
    pfor.write_token_files(frame(spark, []), str(tmp_path / "none"), P.path("word_bpe_49k.json"))
    assert pfor.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_chunks_like_the_library():
    t = tokenizers.Tokenizer.from_file(P.path("word_bpe_49k.json"))
    e = ChunkEncoder(P.path("word_bpe_49k.json"), limit=20)
    odd = ["it's DON'T 12 3a ﬁ İstanbul ΑΣ Σ", "a\xa0b c", "x\x00y \x01", "<|endoftext|> a", "naïve CAFÉ é ̧", "日本語 テスト", *[x[1] or "" for x in documents()]]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.batch([s.encode() for s in odd])] == [t.encode(s, add_special_tokens=False).ids for s in odd]


def test_packing_loses_nothing(spark):
    _, ids = library_ids("word_bpe_49k.json")
    got = packing.pack_texts(clashing(frame(spark)), P.path("word_bpe_49k.json")).collect()
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r["id"]].append((r["start"], bytes(r["ids"])))
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: b"".join(x for _, x in sorted(v)) for i, v in docs.items()} == {i: np.array([*x, 2], "<u4").tobytes() for i, x in ids.items()}
    for v in seqs.values():
        at = 0
        for offset, n in sorted(v):
            assert offset == at
            at += n
        assert at <= 4096 and at & at - 1 == 0
    assert packing.pack_texts(frame(spark, []), P.path("word_bpe_49k.json")).count() == 0


def test_closest_multiset_matches_brute_force():
    r = random.Random(3)
    for _ in range(200):
        capacity = r.randrange(5, 40)
        counts = {r.randrange(1, capacity + 1): r.randrange(1, 4) for _ in range(r.randrange(1, 5))}
        first = max(counts)
        sums = {first}
        for k, n in counts.items():
            n -= k == first
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= capacity}
        got = packing.closest_multiset(counts, capacity, first)
        assert sum(k * n for k, n in got.items()) == max(sums) and got[first] >= 1 and all(n <= counts[k] for k, n in got.items())


def test_bpe_round_trip_and_library(spark):
    t, ids = library_ids("byte_bpe_50k.json")
    path = P.path("byte_bpe_50k.json")
    back = {r["id"]: r for r in bpe.decode(bpe.encode(clashing(frame(spark)).withColumn("id", F.lit("clash")), path), path).collect()}
    for i, text, *_ in documents():
        assert back[i]["ids"] == ids[i] and back[i]["text"] == (text or "") == t.decode(ids[i], skip_special_tokens=False), i
    assert bpe.encode(frame(spark, []), path).count() == 0


def test_lexicon(tmp_path):
    r = random.Random(1)
    entries = {prose(k, 1).encode() + bytes([97 + k % 7]): [k, k * 2][: r.randrange(3)] for k in range(300)}
    data = bpe.compile_lexicon(entries)
    (tmp_path / "l").write_bytes(data)
    lex = bpe.Lexicon(str(tmp_path / "l"))
    assert all(lex.get(w) == v for w, v in entries.items()) and lex.get(b"zz") is None and lex.get(b"") is None
    # suffixes are shared: fewer states than a trie has nodes
    nodes = {w[:i] for w in entries for i in range(len(w) + 1)}
    assert len(lex.first) - 1 < len(nodes)
    (tmp_path / "e").write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(tmp_path / "e")).get(b"a") is None


def test_merges_agree():
    b = bpe.Bpe(P.path("byte_bpe_50k.json"))

    def slowly(word):
        ids = [b.byte_ids[x] for x in word]
        while found := [(b.merges[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in b.merges]:
            (_, new), i = min(found)
            ids[i : i + 2] = [new]
        return ids

    assert b.merge(b"") == []
    for w in [b"a", b" the", b"ab" * 100, "né日本".encode(), *[prose(k, 1).encode() for k in range(100)], *["".join(prose(k, 30).split()).encode() for k in range(10)]]:
        assert b.merge(w) == slowly(w)


def toxic_rows(n, seed):
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = prose(seed * 1000 + k, 60).split()
        bad = k % 3 == 0
        if bad:
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(["vurgle", "vurgles", "zonkish", "zonkishy"])
        out.append((" ".join(w), int(bad)))
    return out


def test_toxicity_held_out():
    model = toxicity.fit(toxic_rows(300, 1))
    words = toxicity.Words(model.bucket)

    def score(text):
        v = toxicity.words_of(words, text.encode().split())
        return 1 / (1 + np.exp(-(model.scale * (toxicity.worst_window(v) + model.bias) + model.shift)))

    test = [(score(t), y) for t, y in toxic_rows(150, 2)]
    assert np.mean([(s >= 0.7) == bool(y) for s, y in test]) > 0.95
    clean = prose(99, 60)
    assert score(clean + " vurglee") > score(clean)  # a spelling that was never seen
    assert toxicity.fit([("a", 0)]).bias == -30.0


def test_toxicity_rows(spark):
    rows = [(i, t, "en", "s", 0) for i, (t, _) in enumerate(toxic_rows(120, 3))] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (902, "!!! ...", "en", "s", 0)]
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(toxic_rows(120, 3))], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, SCHEMA)
    chosen = toxicity.training_rows(df, labels, per_class=20)
    assert sum(y for _, y in chosen) == 20 and len(chosen) == 40
    model = toxicity.train(df, labels)
    scored = {r["id"]: r["score"] for r in toxicity.score(clashing(df), model).collect()}
    assert len(scored) == 123 and scored[900] == scored[901] == scored[902] == 0.0 and all(0 <= s <= 1 for s in scored.values())
    kept = toxicity.filter_toxic(clashing(df), model)
    assert kept.columns == clashing(df).columns and {r["doc_id"] for r in kept.collect()} == {i for i, s in scored.items() if s < 0.7}
    assert toxicity.score(df.limit(0), model).count() == 0
    held = {r["doc_id"] for r in df.where(toxicity.held_out("doc_id")).collect()}
    assert held == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}


def test_digests(spark, tmp_path):
    t, ids = library_ids("byte_bpe_50k.json")
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in bpe.op5_bpe_lexicon(spark, str(tmp_path)).collect()}
    assert len(got) == len(ids)
    for i, x in ids.items():
        text = t.decode(x, skip_special_tokens=False)
        want = (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == want, i


def test_closest_multisets_are_used():
    """Every sequence starts from the multiset closest to the capacity; only what fills its slack is cut."""
    r = np.random.default_rng(4)
    for lengths in (r.integers(1, 900, 20), r.integers(1, 4096, 400), np.full(50, 1000), np.array([5, 0, 7])):
        seqs = packing.pack_lengths(lengths, 4096)
        used = np.zeros(len(lengths), np.int64)
        for row in seqs:
            total = sum(n for _, _, n in row)
            assert total == 4096 or total & total - 1 == 0
            for i, _, n in row:
                used[i] += n
        assert (used == lengths).all()
        cut = sum(len(row) for row in seqs) - int((lengths > 0).sum())
        assert cut <= len(seqs) + 12


def test_toxicity_scored_in_plain_python(spark):
    """Every score is that of the worst stretch of words, averaged n-gram by n-gram without arrays; labels, order and other rows do not matter."""
    import math
    import random
    import zlib

    r = random.Random(4)
    plain = [helpers.prose(k, 40) for k in range(120)]
    rude = [" ".join(w if r.random() > 0.05 else r.choice(["vilething", "nastyfool"]) for w in f"{helpers.prose(200 + k, 30)} vilething".split()) for k in range(30)]
    model = toxicity.fit([(t, 0) for t in plain] + [(t, 1) for t in rude])
    rows = [(1, None), (2, ""), (3, " . - "), (4, "vilething"), (5, "vilethink of all"), (6, helpers.prose(77, 500) + " nastyfool " + helpers.prose(78, 500)), (7, helpers.prose(79, 50)), (None, "vilething"), (4, "vilething")]
    found = {}
    for x in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        found.setdefault(x["id"], set()).add(round(x["score"], 9))

    def word(w: str) -> float | None:
        logits = []
        for part in toxicity.PART.findall(w.lower()):
            marked = f"<{part}>"
            pieces = [marked] + [marked[i : i + n] for n in toxicity.GRAMS for i in range(len(marked) - n + 1)]
            logits += [float(model.bucket[zlib.crc32(p.encode()) % toxicity.BUCKETS]) for p in pieces]
        return sum(logits) / len(logits) if logits else None

    for i, t in rows:
        values = [v for v in (word(w) for w in (t or "").split()) if v is not None]
        worst = None
        for at in range(0, len(values), toxicity.WINDOW):
            own = values[at : at + toxicity.WINDOW]
            mean = sum(set(own)) / len(own)
            worst = mean if worst is None else max(worst, mean)
        want = 0.0 if worst is None else 1 / (1 + math.exp(-(model.scale * (worst + model.bias) + model.shift)))
        assert all(abs(x - want) < 1e-6 for x in found[i])
    assert min(found[4]) > 0.7 and max(found[7]) < 0.5
