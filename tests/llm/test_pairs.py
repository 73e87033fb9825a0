"""Operators on pairs: near duplicates, passages, recordings, lists; and the pipeline."""

from __future__ import annotations

import datetime
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import chroma, common, minhash, urllists, windows
from tests.llm.helpers import SCHEMA, clashing, documents, frame, hub_rows, near_components, near_passages, prose, shared_passages, shingles


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 80, (50, 2))] + [(k, k + 1) for k in range(200, 260)]
    from tests.llm.helpers import components

    want = components({x for e in edges for x in e}, edges)
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(k in got for a, b in edges for k in (a, b) if a != b)
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_is_two_permutations():
    ranks = minhash.rank_table()
    s = np.array([1, 2, 3], np.uint64)
    slots = (common.mix64(s ^ np.uint64(0x5DEECE66D)) & np.uint64(minhash.CIRCLE - 1)).astype(int)
    want = [min(ranks[(x + k) % minhash.CIRCLE] for x in slots) for k in range(minhash.ROWS * minhash.BANDS)]
    assert minhash.signature(s, ranks).tolist() == want
    assert len(set(ranks[: minhash.CIRCLE].tolist())) == minhash.CIRCLE


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    base = prose(50, 100).split()
    more = []
    for k in range(40):  # a chain of copies that drift away from the first
        base = base.copy()
        base[(k * 7) % len(base)] = f"w{k}"
        more.append((100 + k, " ".join(base), "en", "s", 0))
    rows = documents() + more + [(200, prose(1, 120), "en", "s", 0)]
    got = minhash.near_duplicates(clashing(frame(spark, rows)), width=width).collect()
    want = near_components(rows, width, 80)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
            assert r["n_shingles"] == len(shingles(next(t for i, t, *_ in rows if i == r["doc_id"]), width))
    kept = minhash.drop_near_duplicates(frame(spark, rows), width=width)
    assert kept.columns == frame(spark).columns and {r["doc_id"] for r in kept.collect()} == set(want.values()) | {None}
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("hub_id,n,parts", [(1, 300, 1), (1150, 300, 8), (9000, 300, 3), (9000, 20, 8)])
def test_hub(spark, hub_id, n, parts):
    """All are linked through the hub alone, whichever id it has and however rows lie."""
    rows = [r for r in hub_rows(n, hub_id) if r[0] != hub_id or r[1].startswith("h0 h1 h2")]
    if hub_id == 1150:
        rows = [(5000, *r[1:]) if r[0] == 1150 and k else r for k, r in enumerate(rows)]
    got = minhash.near_duplicates(frame(spark, rows).repartition(parts), width=2).collect()
    assert len(got) == n + 1 and {r["component_id"] for r in got} == {min(r[0] for r in rows)}


def test_key_over_many_partitions(spark):
    rows = [(k, 7, k * 7919 % 1000) for k in range(3000)] + [(k, 9, 0) for k in (1, 2)]
    banded = spark.createDataFrame(rows, "node long, key long, next long").repartition(8)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            pairs = minhash.neighbours(banded).select("a", "b").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert len(set(pairs)) == len(pairs)
        from tests.llm.helpers import components

        assert set(components(range(3000), [tuple(p) for p in pairs]).values()) == {0}


def test_pairs_that_were_no_neighbours(spark, monkeypatch):
    def with_far(banded):  # every class is proposed with one that it is not similar to
        return banded.where("node > 2").select(F.lit(2).cast("long").alias("a"), F.col("node").alias("b"), F.lit(1).cast("long").alias("bands")).distinct()

    monkeypatch.setattr(minhash, "neighbours", with_far)
    base, rows = prose(50, 300).split(), [(1, prose(3, 100), "en", "s", 0)]
    far = base[:15] + prose(51, 40).split() + base[40:]  # shares keys with all that follow, too far from them to be linked
    rows.append((2, " ".join(far), "en", "s", 0))
    for k in range(60):
        own = base.copy()
        own[5 * k : 5 * k + 2] = f"x{k} y{k}".split()
        rows.append((100 + k, " ".join(own[:-60] + prose(52, 60).split()), "en", "s", 0))
    want = near_components(rows, 2, 80)
    assert want[2] == 2 and want[159] == 100
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), width=2).collect()} == want


def test_compact_windows_match_brute_force():
    r = np.random.default_rng(0)

    def brute(v, t, lo, hi, out):
        if hi - lo + 1 >= t:
            c = lo + int(np.argmin(v[lo : hi + 1]))
            out.add((lo, c, hi))
            brute(v, t, lo, c - 1, out)
            brute(v, t, c + 1, hi, out)
        return out

    for _ in range(200):
        n, t = int(r.integers(1, 60)), int(r.integers(1, 12))
        v = r.integers(1, int(r.integers(2, 50)), n).astype(np.uint32)
        assert set(zip(*[x.tolist() for x in windows.compact_windows(v, t)], strict=True)) == brute(v, t, 0, n - 1, set())


def passage_rows():
    shared = prose(2, 70).split()
    near = shared.copy()
    near[30] = "else"
    rows = documents() + [(300 + k, f"{prose(300 + k, 20)} {' '.join(shared)} {prose(400 + k, 15)}", "en", "s", 0) for k in range(30)]
    return rows + [(400, f"{prose(500, 25)} {' '.join(near)}", "en", "s", 0), (401, prose(501, 90), "en", "s", 0)]


def test_passages(spark):
    rows = passage_rows()
    got = {r["doc_id"]: r for r in windows.passage_classes(clashing(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    for a, b in shared_passages(rows, windows.WORDS):
        assert got[a]["component_id"] == got[b]["component_id"]
    assert got[400]["component_id"] == 4 and got[401]["component_id"] == 401 and got[401]["n_linked"] == 0
    assert all(got[300 + k]["n_repeated_words"] >= 70 for k in range(30)) and got[4]["n_repeated_words"] == 0
    for i in (6, 7, 8, 9, 10, 11):
        assert got[i]["component_id"] == i and got[i]["n_repeated_words"] == 0
    assert got[2]["n_repeated_words"] == got[2]["n_words"] == 120
    assert windows.passage_classes(frame(spark, [])).count() == 0


def passage_hub(n, hub_id, seed=3):
    """A passage of 75 words and n texts with some of its words changed: each is near the hub's, none near another's."""
    import random

    r = random.Random(seed)
    hub = [f"h{k}" for k in range(75)]
    rows = [(hub_id, " ".join(hub), "en", "s", 0)]
    for k in range(n):
        own = hub.copy()
        for p in r.sample(range(6, 69), 2):
            own[p] = f"x{k}y{p}"
        rows.append((1000 + k, f"{prose(5000 + k, 12)} {' '.join(own)}", "en", "s", 0))
    return rows


@pytest.mark.parametrize("hub_id,n,parts", [(1, 60, 1), (1030, 60, 8), (9000, 60, 3), (9000, 20, 8)])
def test_passage_hub(spark, hub_id, n, parts):
    """Held against all windows of all pairs, whichever id the hub has and however rows lie."""
    rows = passage_hub(n, hub_id)
    if hub_id == 1030:
        rows = [(5000, *r[1:]) if r[0] == 1030 and k else r for k, r in enumerate(rows)]
    from tests.llm.helpers import components

    links = near_passages(rows, windows.WORDS, windows.WIDTH, 80)
    want = components([r[0] for r in rows], links)
    got = {r["doc_id"]: r for r in windows.passage_classes(frame(spark, rows).repartition(parts)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    later = {b for _, b in links}
    assert {i for i, r in got.items() if r["n_repeated_words"]} == later
    assert all(r["n_linked"] == sum(v == want[i] for v in want.values()) - 1 for i, r in got.items())


def test_frequent_keys(spark, monkeypatch):
    """A passage of many documents, whose rows go in parts."""
    monkeypatch.setattr(windows, "SAMPLE", 1)
    monkeypatch.setattr(windows, "PART_ROWS", 10)
    shared = prose(2, 70)
    rows = [(k, f"{prose(300 + k, 20)} {shared} {prose(900 + k, 15)}", "en", "s", 0) for k in range(80)]
    got = windows.passage_classes(frame(spark, rows)).collect()
    assert {(r["component_id"], r["n_linked"]) for r in got} == {(0, 79)}
    assert all(r["n_repeated_words"] >= 70 for r in got if r["doc_id"])
    proposed = windows.candidates(frame(spark, rows), common.shared_path(spark, "windows"))
    assert proposed.where(F.col("kind") == windows.EDGE).count() > 0 and windows.joined_parts(proposed).count() > 0


def test_cut_passages(spark):
    rows = passage_rows()
    df = clashing(frame(spark, rows))
    cut = windows.cut_passages(df)
    assert cut.columns == df.columns
    text = {r["doc_id"]: r["text"] for r in cut.collect()}
    shared = prose(2, 70)
    assert shared in text[4] and not any(shared in (text[300 + k]) for k in range(30))
    assert text[300].split()[:15] == rows[-32][1].split()[:15]  # what stands before the passage stays
    assert text[401] == rows[-1][1] and text[6] is None and text[2] == "" and text[1] == rows[0][1]


def test_fingerprints_align():
    classes, t = chroma.pitch_classes(), np.arange(256) / chroma.RATE
    tones = [9000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in range(36)]
    sound = lambda s: np.concatenate([tones[zlib.crc32(w.encode()) % 36] for w in s.split()])
    a = prose(1, 80)
    noisy = sound(" ".join(a.split()[9:])) + np.random.default_rng(0).normal(0, 500, 71 * 256)
    x, y, z = (chroma.fingerprint(s.astype("<i2"), classes) for s in (sound(a), noisy, sound(prose(2, 80))))
    offset, overlap, errors = chroma.align(x, y)
    assert offset == 9 and overlap > 50 and errors < 0.1 and chroma.align(x, z)[2] > 0.25
    assert len(chroma.fingerprint(np.zeros(10, "<i2"), classes)) == 0


def test_recordings(spark):
    texts = {1: prose(1, 80), 2: prose(1, 80), 3: " ".join(prose(1, 80).split()[10:]), 4: prose(2, 80), 5: None, 6: "", 7: "one two"}
    df = chroma.rendered(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text")
    got = {r["id"]: r for r in chroma.recording_classes(df.withColumn("items", F.lit("clash"))).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7}
    assert got[3]["n_linked"] == 2 and got[5]["n_items"] == 0
    assert chroma.recording_classes(df.limit(0)).count() == 0


def test_alignment_counts_all_offsets():
    """Long steady sound: the histogram is exact, whichever way an integer's offsets are counted."""
    r = np.random.default_rng(8)
    for _ in range(30):
        a = r.choice([1, 1, 1, 1, 2, 3, 4], int(r.integers(1, 400))).astype(np.uint32)
        b = r.choice([1, 1, 1, 1, 2, 3, 5], int(r.integers(1, 400))).astype(np.uint32)
        votes = {k: int((a[max(0, k) : len(b) + k] == b[max(0, -k) : max(0, -k) + len(a[max(0, k) : len(b) + k])]).sum()) for k in range(1 - len(b), len(a))}
        offset, overlap, _ = chroma.align(a, b)
        assert not max(votes.values()) or votes[offset] == max(votes.values())
        assert overlap == len(a[max(0, offset) : len(b) + offset])


def test_recordings_match_brute_force(spark):
    """Classes against all pairs: parts of long recordings, shifted by whole frames and with noise."""
    from tests.llm.helpers import components

    r, t = np.random.default_rng(5), np.arange(256) / chroma.RATE
    tones = [9000 * np.sin(2 * np.pi * 220 * 2 ** (k / 12) * t) for k in range(36)]
    rows = []
    for k in range(120):
        base = [int(x) for x in np.random.default_rng(k % 15).integers(0, 36, 90)]
        at = int(r.integers(0, 30))
        sound = np.concatenate([tones[x] for x in base[at : at + 55]]) + r.normal(0, (0, 100, 300)[k % 3], 55 * 256)
        rows.append((k, sound.astype("<i2").tobytes()))
    df = spark.createDataFrame(rows, "id long, pcm binary")
    prints = {x["id"]: np.frombuffer(x["items"], "<u4") for x in chroma.fingerprints(df).collect()}
    links = set()
    for a in prints:
        for b in prints:
            if a < b:
                _, overlap, errors = chroma.align(prints[a], prints[b])
                if overlap >= chroma.LEAST_OVERLAP and errors <= chroma.MAX_ERRORS:
                    links.add((a, b))
    want = components(list(prints), links)
    got = {x["id"]: x["component_id"] for x in chroma.recording_classes(df).collect()}
    together = sum(got[a] == got[b] for a, b in links)
    assert together >= 0.9 * len(links) and all(want[i] == want[got[i]] for i in got)


def brute_list(captures, entries):
    on = defaultdict(list)
    for p, at, action in entries:
        if p and at:
            on[p.lower()].append((at, action == "remove", action))
    out = {}
    for i, url, t in captures:
        host = (url or "").split("://")[-1].split("/")[0].lower() if "://" in (url or "") else ""
        names = [".".join(host.split(".")[k:]) for k in range(host.count(".") + 1)] if host else []
        active = []
        for n in names:
            state = None
            for at, _, action in sorted(on.get(n, [])):
                if t and at <= t:
                    state = action
            if state == "add":
                active.append(n)
        out[i] = (bool(active), len(active), max(active, key=len, default=None))
    return out


@pytest.mark.parametrize("bound", [urllists.BROADCAST_ROWS, 0])
def test_temporal_list(spark, monkeypatch, bound):
    monkeypatch.setattr(urllists, "BROADCAST_ROWS", bound)
    day = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    entries = [("a.org", day(10), "add"), ("a.org", day(50), "remove"), ("a.org", day(50), "add"), ("a.org", day(70), "add"), ("A.org", day(90), "remove"), ("x.a.org", day(20), "add"), ("b.net", day(0), "remove"), (None, day(1), "add"), ("c.com", None, "add")]
    captures = [(k, u, day(t)) for k, (u, t) in enumerate((u, t) for u in ("http://a.org/1", "https://X.A.org", "http://y.x.a.org/?q", "http://ba.org/", "b.net", "", None) for t in (0, 10, 19, 20, 49, 50, 60, 70, 89, 90, 200, 27000))] + [(999, "http://a.org", None)]
    e = spark.createDataFrame(entries, "pattern string, at date, action string")
    c = spark.createDataFrame(captures, "k long, url string, fetched date")
    for name in ("since", "pattern", "host", "row_", "n_", "h_", "a.b"):  # names that the operator uses or adds
        c = c.withColumn(name, F.lit("clash"))
    got = {r["k"]: (r["blocked"], r["n_active"], r["pattern"]) for r in urllists.active_at(c, urllists.validity(e)).collect()}
    assert got == brute_list(captures, entries)
    found = urllists.active_at(c, urllists.validity(e))
    assert found.columns == ["k", "url", "fetched", "row_", "n_", "h_", "a.b", "host", "blocked", "n_active", "pattern", "since"]
    assert found.where("row_ <> 'clash' or n_ <> 'clash' or `a.b` <> 'clash'").count() == 0
    assert urllists.active_at(c, urllists.validity(e.limit(0))).where("blocked").count() == 0 and urllists.active_at(c.limit(0), urllists.validity(e)).count() == 0


def test_captures_after_today(spark, monkeypatch):
    monkeypatch.setattr(urllists, "BROADCAST_ROWS", 0)
    day = datetime.date.today() + datetime.timedelta(900)
    e = spark.createDataFrame([("a.org", datetime.date(2024, 1, 1), "add")], "pattern string, at date, action string")
    c = spark.createDataFrame([(1, "http://a.org/1", day), (2, "http://a.org/1", datetime.date(2023, 1, 1))], "k long, url string, fetched date")
    assert {r["k"]: r["blocked"] for r in urllists.active_at(c, urllists.validity(e)).collect()} == {1: True, 2: False}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_rows import toxic_rows

    labelled = toxic_rows(200, 5)
    rows = [(1000 + i, t, "en", "s", 0) for i, (t, _) in enumerate(labelled)] + [r for r in passage_rows() if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + i, 1, y) for i, (_, y) in enumerate(labelled)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r["doc_id"] for r in docs.collect()}
    clean = {1000 + i for i, (_, y) in enumerate(labelled) if not y}
    assert len(clean - seen["toxicity"]) <= 2 and len(seen["toxicity"] & {1000 + i for i, (_, y) in enumerate(labelled) if y}) <= 5
    assert 2 not in seen["near_duplicates"] and 14 not in seen["quality"] and seen["repeated_passages"] == seen["near_duplicates"] == seen["packing"]


def noisy(items, share, rng):
    """The integers with that share of their bits turned over."""
    flips = (rng.random((len(items), 32)) < share) * (1 << np.arange(32, dtype=np.uint64))
    return items ^ flips.sum(axis=1).astype(np.uint32)


@pytest.mark.parametrize("share", [0.02, 0.05, 0.10])
def test_keys_of_recordings_with_bit_errors(share):
    """Of recordings of 300 frames at least nine in ten share a key with a copy of which that share of bits is wrong."""
    rng, masks, met = np.random.default_rng(3), chroma.key_masks(), 0
    for _ in range(100):
        items = rng.integers(0, 1 << 32, 300, dtype=np.uint64).astype(np.uint32)
        met += bool(np.intersect1d(chroma.sub_keys(items, masks), chroma.sub_keys(noisy(items, share, rng), masks)).size)
    assert met >= 90


def test_classes_do_not_depend_on_partitions(spark, tmp_path):
    """Recordings that all share a key, so that borders of ranges split it: whatever the number of partitions, those that match are linked."""
    rng = np.random.default_rng(9)
    common = rng.integers(0, 1 << 32, 2, dtype=np.uint64).astype(np.uint32)
    family = [rng.integers(0, 1 << 32, 60, dtype=np.uint64).astype(np.uint32) for _ in range(3)]
    rows = []
    for k in range(12):
        items = noisy(family[k % 3], 0.08, rng)
        items[30:32] = common
        rows.append((k, items.astype("<u4").tobytes()))
    prints = spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "id long, items binary")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            found = common_components(chroma.matches(prints, str(tmp_path / parts)).select("a", "b").collect())
            assert found == {k: k % 3 for k in range(12)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def common_components(links):
    from tests.llm.helpers import components

    return components(list(range(12)), [(x["a"], x["b"]) for x in links])


def held_together(family: list[np.ndarray], masks) -> chroma.Bucket:
    found = [chroma.sub_keys(x, masks) for x in family]
    row, key = np.repeat(np.arange(len(family)), [len(k) for k in found]), (np.concatenate(found).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    return chroma.Bucket(np.arange(len(family)) * 3, np.concatenate(family), np.array([len(x) for x in family]), row, key)


def test_recordings_that_share_keys_are_compared_together(monkeypatch):
    """Of 150 recordings, most of which share keys without a match, those are joined that align one by one; single alignments only for long steady sound."""
    from tests.llm.helpers import components

    rng, masks, single, one = np.random.default_rng(4), chroma.key_masks(), [], chroma.align
    common = rng.integers(0, 1 << 32, (4, 6), dtype=np.uint64).astype(np.uint32)
    base = rng.integers(0, 1 << 32, (5, 60), dtype=np.uint64).astype(np.uint32)
    family = []
    for k in range(150):
        items = noisy(base[k % 5][k % 7 : 45 + k % 11], 0.03, rng) if k % 3 == 0 else rng.integers(0, 1 << 32, int(rng.integers(12, 80)), dtype=np.uint64).astype(np.uint32)
        at = int(rng.integers(0, len(items) - 6))
        items[at : at + 6] = common[k % 4]  # a phrase that many hold
        if k % 10 == 1:
            items = np.concatenate([np.repeat(items[at], k % 4 + 1), items, items[at : at + 3]])  # integers at several places
        family.append(items)
    keys = [chroma.sub_keys(x, masks) for x in family]
    near = [(i, j) for j in range(150) for i in range(j) if len(np.intersect1d(keys[i], keys[j]))]
    good = [(i, j) for i, j in near for _, overlap, errors in [one(family[i], family[j])] if overlap >= chroma.LEAST_OVERLAP and errors <= chroma.MAX_ERRORS]
    monkeypatch.setattr(chroma, "align", lambda *x: single.append(x) or one(*x))
    links = list(held_together(family, masks).links())
    assert len(near) > 5 * len(good) / 2 and 5 < len(good) and not single
    assert components(range(150), [(a // 3, b // 3) for a, b, *_ in links]) == components(range(150), good)
    for a, b, *rest in links:
        assert tuple(rest) == one(family[a // 3], family[b // 3])
    steady = [np.concatenate([np.full(100 + k, 7, np.uint32), np.arange(5, dtype=np.uint32) + 50 * k]) for k in range(4)]
    assert len(list(held_together(steady, masks).links())) == 3 and single


def test_parts_of_a_frequent_key_meet():
    """Any two rows of a key meet under one hash, also where its rows go in parts; other keys stay as they are."""
    ids, key = np.arange(100, 160), np.concatenate([np.full(60, 5), np.full(60, 9), np.full(60, 11)])
    row = np.tile(np.arange(60), 3)
    index, met = chroma.dealt_keys(ids, key, row, np.array([5, 11]), np.array([4, 2]))
    cells = defaultdict(set)
    for i, m in zip(index.tolist(), met.tolist(), strict=True):
        cells[m].add(i)
    for k in range(3):
        assert all(any({x, y} <= c for c in cells.values()) for x in range(60 * k, 60 * k + 60) for y in range(60 * k, x))
    assert all(len({int(key[i]) for i in c}) == 1 for c in cells.values()) and max(len(c) for c in cells.values() if 0 in c) < 60
    assert [len(c) for c in cells.values() if 60 in c] == [60]
