"""Every query of this subpackage and the pipeline, over tables with nulls, repeats and extra columns, and over empty ones."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm.queries import QUERIES
from tests.llm.helpers import SCHEMA, clashing, documents, prose

TURNS = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string"
#: Columns that each query has to return at least.
COLUMNS = {
    "op1_quality_cascade": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_chroma_prints": "recording_id n_items component_id n_linked",
    "op3_temporal_list": "page_id host fetched blocked n_active pattern since",
    "op4_compact_windows": "doc_id component_id n_linked n_passages n_repeated_words",
    "op5_bpe_lexicon": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6_subword_toxicity": "doc_id held_out score predicted",
    "op7_pfor_blocks": "doc_id start n_tokens ids_crc32",
    "op8_slack_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op9_feistel_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_circulant_minhash": "doc_id n_shingles component_id kept",
    "op11_stream_dedup": "doc_id keep_id group_size kept text_sha256",
    "op12_prefix_tree": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op13_wavelet_search": "item_id rank doc_id score",
}
RUDE = ["vurgle", "zonkish", "vurgles"]


def rude(k: int) -> str:
    words = prose(500 + k, 40).split()
    words[k % 40] = words[(k + 7) % 40] = RUDE[k % 3]
    return " ".join(words)


def tables(folder, spark, empty: bool) -> str:
    docs = [] if empty else [*documents(), (None, None, None, None, None), (10, "one two", "en", "s", 7), *[(100 + k, rude(k), "en", "s", 0) for k in range(60)], *[(200 + k, prose(600 + k, 40), "en", "s", 0) for k in range(60)]]
    labels = [] if empty else [*[(100 + k, 1, 1) for k in range(60)], *[(200 + k, 1, 0) for k in range(60)], (None, None, None), (6, None, 0), (9999, 1, None)]
    turns = [] if empty else [(1, 0, "user", prose(9, 30)), (1, 1, "bot", None), (2, 0, "user", prose(9, 30)), (2, None, None, "x"), (None, 0, "user", "y"), (7, 3, "user", ""), (None, None, None, None)]
    pages = [] if empty else [(1, "http://a.b.example/x", "<p>"), (2, None, None), (None, "no url", ""), (4, "", "x"), (5, "http://a.b.example/y", None)]
    items = [] if empty else [(1, prose(1, 20)), (2, None), (None, "one two"), (4, "")]
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("conversations", turns, TURNS), ("pages", pages, PAGES), ("benchmark", items, "item_id long, text string")):
        df = spark.createDataFrame(rows, schema)
        (clashing(df) if name == "documents" else df.withColumn("key", F.lit("clash"))).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module", params=[False, True], ids=["odd", "empty"])
def folder(spark, request, tmp_path_factory):
    return tables(tmp_path_factory.mktemp("tables"), spark, request.param), request.param


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, name):
    path, empty = folder
    out = QUERIES[name](spark, path)
    assert set(COLUMNS[name].split()) <= set(out.columns)
    rows = out.collect()
    docs = [] if empty else spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()
    if empty:
        assert len(rows) == (1 if name == "op12_prefix_tree" and rows else 0)
    elif "doc_id" in out.columns and name not in ("op8_slack_packing", "op13_wavelet_search"):
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs)
    if name in ("op7_pfor_blocks", "op8_slack_packing"):
        check_ids(name, rows, docs)


def check_ids(name, rows, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tok.no_truncation()
    tok.no_padding()
    ids = [(r["doc_id"], [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 2]) for r in docs]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    if name == "op7_pfor_blocks":
        assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == Counter((i, len(x), crc(x)) for i, x in ids)
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        return
    sequences, want = defaultdict(list), Counter()
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for row in sequences.values():
        at = 0
        for offset, length in sorted(row):
            assert offset == at
            at += length
        assert at <= 4096
    for i, x in ids:  # repeated ids hold equal texts here, or none at all
        for r in {(r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i and r["doc_tokens"] == len(x)}:
            want[i, r[2] == crc(x[r[0] : r[0] + r[1]])] += r[1]
    assert sum(r["length"] for r in rows) == sum(len(x) for _, x in ids)
    assert all(ok or i is None for i, ok in want)


def near_words(text: str, other: str) -> tuple[int, int]:
    """First and last word of the text in windows of 50 words of which the other text holds a near one, by all windows against all."""

    def windows_(t):
        w = t.split()
        runs = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        return [frozenset(runs[k : k + 46]) for k in range(len(runs) - 45)]

    there = windows_(other)
    near = [k for k, x in enumerate(windows_(text)) if any(100 * len(x & y) >= 80 * len(x | y) for y in there)]
    return near[0], near[-1] + 49


def test_pipeline(spark, folder):
    """What the last stage packs are the ids of the documents that every stage keeps, with repeated passages cut."""
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    path, empty = folder
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    rows = corpus_pipeline.run(spark, path).collect()
    assert spark.conf.get(option) == before
    if empty:
        assert rows == []
        return
    found = defaultdict(list)
    for r in rows:
        found[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {i: t for i, t, *_ in documents() if i is not None}
    for i in (1, 4, 12):
        assert [x for _, part in sorted(found[i]) for x in part] == [*tok.encode(text[i], add_special_tokens=False).ids, 2]
    # words 40 to 109 of document 5 are those that document 4 holds; near windows of 50 words reach a little further
    lo, hi = near_words(text[5], text[4])
    assert lo <= 40 and hi >= 109
    ends = [(m.start(), m.end()) for m in re.finditer(r"\S+", text[5])]
    cuts = {(p, q): text[5][: ends[p][0]] + (text[5][ends[q + 1][0] :] if q + 1 < len(ends) else "") for p in range(lo, 41) for q in range(109, hi + 1)}
    five = [x for _, part in sorted(found[5]) for x in part][:-1]
    assert any(five == tok.encode(t, add_special_tokens=False).ids for t in cuts.values())
    assert not {2, 3, 6, 7, 8, 9, 10, 11, 14, 15} & set(found)
    assert len({200 + k for k in range(60)} - set(found)) <= 1 and len({100 + k for k in range(60)} & set(found)) <= 3
