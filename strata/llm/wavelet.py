"""Ranked lexical search over shards of dual-sorted wavelet trees.

A shard is up to ``SHARD_DOCS`` documents in ascending order of their ids. Its postings lie term by term, those of a
term by falling impact; a wavelet matrix over the documents' numbers in that order makes the same postings navigable by
document: a node of level l stands for the documents whose numbers share their first l bits, a term's postings of these documents are one
range of the level, and as partitions are stable the first posting of the range has the greatest impact there.

A query holds a frontier of nodes, each with the ranges of its terms that are not empty. A node's bound is the sum of weight
times first impact over these; the best ``BEST`` nodes of every query are split at once, ranges that run empty drop
out, and a node below the bound of the k-th best document found so far (or equal to it with later ids only) is never opened. At the last level
the bound is the score itself, so the result is exact. A task carries its best documents from shard to shard and hands on
k for each query.

Plan: one pass counts documents and terms, one builds the shards from the partitions as they are read (no shuffle) and
writes them; document frequencies are sums over the shards' term lists, asked for the queries' terms only. Queries come in blocks of at most
``BLOCK_ITEMS`` items and ``BLOCK_TERMS`` distinct terms of items, which bounds what is broadcast; each block reads the shards once.

Terms are told apart by 64-bit hashes. Cases: null texts, empty ones and those without a term match nothing and do not count as documents;
texts of any length are read whole; repeated rows are documents of their own; a null doc_id comes after all others; equal scores are ordered by
id; repeated items are answered once for each row; an empty table or items without known terms give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import LETTER_VALUES, binary_array, pieces, remove, shared_path, small_batches, table, trim, word_hashes

#: A term is a run of digits, ASCII letters and characters beyond ASCII (fixed values); these bytes lie between terms.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
VALUES = np.where(BETWEEN, np.uint64(0), LETTER_VALUES)
SHARD_DOCS = 2048
SHARD_TERMS = 2_000_000
BITS = 12  #: of a document's number in a shard's sort key
IMPACT_BITS = 20
BEST = 8
BLOCK_ITEMS = 1024
BLOCK_TERMS = 500_000
BATCH_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max
INDEX = "shard long, n_docs int, ids binary, lost binary, terms binary, first binary, impacts binary, bits binary"


def batches_of_texts(column: pa.Array):
    """(first, end) of stretches of a column with some ``BATCH_BYTES`` of text each: what is made of one is 30 times as large."""
    size = np.cumsum(np.nan_to_num(pa.compute.binary_length(column.cast(pa.large_binary())).to_numpy(zero_copy_only=False).astype(float)))
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
        yield at, to
        at = to


def term_counts(column: pa.Array) -> np.ndarray:
    """Terms of each text, with repeats."""
    arr = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    if offsets[-1] == offsets[0]:
        return np.zeros(len(arr), np.int64)
    letter = ~BETWEEN[np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
    opens = letter.copy()
    opens[1:] &= ~letter[:-1]
    edges = (offsets[:-1] - offsets[0])[np.diff(offsets) > 0]
    opens[edges] = letter[edges]
    return np.diff(np.searchsorted(np.flatnonzero(opens), offsets - offsets[0]))


def totals(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and their terms with repeats."""

    def run(batches):
        for b in pieces(batches, 1024):
            n = np.concatenate([np.zeros(0, np.int64), *[term_counts(b.column(0).slice(p, q - p)) for p, q in batches_of_texts(b.column(0))]])
            yield pa.RecordBatch.from_arrays([pa.array([int((n > 0).sum())]), pa.array([int(n.sum())])], names=["docs", "terms"])
        trim()

    row = docs.select("text").mapInArrow(run, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def build(ids: np.ndarray, lost: np.ndarray, n: np.ndarray, hashes: np.ndarray, n_all: int, l_all: int) -> list:
    """Columns of a shard (without its number) from its documents' ids, term counts and term hashes."""
    order = np.argsort(ids, kind="stable")
    number = np.empty(len(ids), np.int64)
    number[order] = np.arange(len(ids))
    terms, term = np.unique(hashes, return_inverse=True)
    key = np.sort(term.astype(np.int64) << BITS | np.repeat(number, n))
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(begin, len(key)))
    key = key[begin]
    doc = key & (1 << BITS) - 1
    m = np.array([25 + 75 * x * n_all // l_all for x in n[order].tolist()], np.int64)
    impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[doc])
    top = (1 << IMPACT_BITS) - 1
    key = np.sort((key >> BITS) << (BITS + IMPACT_BITS) | (top - impact) << BITS | doc)
    doc, impact = (key & (1 << BITS) - 1).astype(np.uint16), (top - (key >> BITS & top)).astype(np.uint32)
    first = np.searchsorted(key >> (BITS + IMPACT_BITS), np.arange(len(terms) + 1)).astype(np.uint32)
    depth, bits = max(1, (len(ids) - 1).bit_length()), []
    for level in range(depth):
        bit = (doc >> np.uint16(depth - 1 - level) & np.uint16(1)).astype(bool)
        bits.append(np.packbits(bit).tobytes())
        doc = np.concatenate([doc[~bit], doc[bit]])
    return [len(ids), ids[order].tobytes(), np.packbits(lost[order]).tobytes(), terms.tobytes(), first.tobytes(), impact.tobytes(), b"".join(bits)]


def build_index(docs: DataFrame, n_all: int, l_all: int, id_col: str = "doc_id") -> DataFrame:
    """Shards (``INDEX``) of the documents (id, text); ``n_all`` and ``l_all`` as ``totals`` gives them."""
    most_docs, most_terms = SHARD_DOCS, SHARD_TERMS

    def run(batches):
        from pyspark import TaskContext

        part, count = TaskContext.get().partitionId(), 0
        held, held_docs, held_terms = [], 0, 0

        def shard():
            ids, lost, n, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            cols = [part << 32 | count, *build(ids, lost, n, hashes, n_all, l_all)]
            kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 6
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])

        for b in pieces(batches, 256):
            for p, q in batches_of_texts(b.column(1)):
                hashes, first = word_hashes(b.column(1).slice(p, q - p), BETWEEN, VALUES)
                n = np.diff(first)
                id_ = b.column(0).slice(p, q - p)
                lost = id_.is_null().to_numpy(zero_copy_only=False)
                some = n > 0
                rows = int(some.sum())
                if not rows:
                    continue
                if held and (held_docs + rows > most_docs or held_terms + len(hashes) > most_terms):
                    yield shard()
                    count, held, held_docs, held_terms = count + 1, [], 0, 0
                held.append((id_.fill_null(LAST).to_numpy()[some].astype(np.int64), lost[some], n[some], hashes))
                held_docs, held_terms = held_docs + rows, held_terms + len(hashes)
        if held:
            yield shard()
        trim()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), "text").mapInArrow(run, INDEX)


class Shard:
    """A shard as it is searched: term ranges, ones before each place of each level, impacts in the order of each level."""

    def __init__(self, n_docs: int, ids: bytes, lost: bytes, terms: bytes, first: bytes, impacts: bytes, bits: bytes):
        self.ids, self.lost = np.frombuffer(ids, np.int64), np.unpackbits(np.frombuffer(lost, np.uint8), count=n_docs).astype(bool)
        self.terms, self.first = np.frombuffer(terms, np.uint64), np.frombuffer(first, np.uint32).astype(np.int64)
        impact = np.frombuffer(impacts, np.uint32)
        self.n, self.depth = len(impact), max(1, (n_docs - 1).bit_length())
        self.ones = np.zeros((self.depth, self.n + 1), np.int32)
        self.impacts = np.empty((self.depth + 1, self.n), np.uint32)
        self.impacts[0] = impact
        size = -(-self.n // 8)
        for level in range(self.depth):
            bit = np.unpackbits(np.frombuffer(bits, np.uint8, size, level * size), count=self.n).view(bool)
            np.cumsum(bit, out=self.ones[level, 1:])
            zeros = self.n - int(self.ones[level, -1])
            self.impacts[level + 1, :zeros] = self.impacts[level, ~bit]
            self.impacts[level + 1, zeros:] = self.impacts[level, bit]
        self.zeros = self.n - self.ones[:, -1].astype(np.int64)


class Best:
    """The k best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score, self.id, self.lost = np.zeros((queries, k), np.int64), np.full((queries, k), LAST), np.zeros((queries, k), bool)

    def open(self, q: np.ndarray, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Which bounds may still bring a document among the best; scores of 0 never do."""
        worst = self.score[q, -1]
        return (bound > worst) | ((bound == worst) & (bound > 0) & (least_id < self.id[q, -1]))

    def add(self, q: np.ndarray, score: np.ndarray, id_: np.ndarray, lost: np.ndarray) -> None:
        own, at = np.unique(q, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(own)), self.k), at])
        s, i, x = (np.concatenate([held[own].reshape(-1), new]) for held, new in ((self.score, score), (self.id, id_), (self.lost, lost)))
        order = np.lexsort((i, -s, rows))
        begin = np.searchsorted(rows[order], np.arange(len(own)))
        take = order[(begin[:, None] + np.arange(self.k)).reshape(-1)]
        for held, new in ((self.score, s), (self.id, i), (self.lost, x)):
            held[own] = new[take].reshape(-1, self.k)


def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+size-1."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def search_shard(shard: Shard, q: np.ndarray, term: np.ndarray, weight: np.ndarray, best: Best) -> None:
    """Takes the shard's documents into ``best``. A row of (q, term, weight) for each distinct term of each query, by query."""
    at = np.minimum(np.searchsorted(shard.terms, term), len(shard.terms) - 1)
    have = shard.terms[at] == term
    q, at, w = q[have], at[have], weight[have]
    if not len(q):
        return
    ones, impacts = shard.ones.reshape(-1), shard.impacts.reshape(-1)
    n, depth = shard.n, shard.depth
    lo, hi = shard.first[at], shard.first[at + 1]
    begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
    # the frontier: nodes (query, level, first bits, bound, place and number of their ranges), and all ranges
    nodes = np.stack([q[begin], np.zeros_like(begin), np.zeros_like(begin), np.add.reduceat(w * impacts[lo], begin), begin, np.diff(np.append(begin, len(q)))])
    ranges = np.stack([lo, hi, w])
    while True:
        nodes = nodes[:, best.open(nodes[0], nodes[3], shard.ids[nodes[2] << (depth - nodes[1])])]
        if not nodes.shape[1]:
            return
        order = np.lexsort((-nodes[3], nodes[0]))
        by = nodes[0][order]
        head = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        place = np.arange(len(by)) - np.repeat(head, np.diff(np.append(head, len(by))))
        split, kept = nodes[:, order[place < BEST]], nodes[:, order[place >= BEST]]
        of = np.repeat(np.arange(split.shape[1]), split[5])
        left, right, w = ranges[:, spans(split[4], split[5])]
        level = split[1][of]
        a, b = ones[level * (n + 1) + left].astype(np.int64), ones[level * (n + 1) + right].astype(np.int64)
        z = shard.zeros[level]
        old = [(kept, ranges[:, spans(kept[4], kept[5])])]
        for bit, lo, hi in ((0, left - a, right - b), (1, z + a, z + b)):
            full = hi > lo
            if not full.any():
                continue
            o, lo, hi, v = of[full], lo[full], hi[full], w[full]
            begin = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            bound = np.add.reduceat(v * impacts[(level[full] + 1) * n + lo], begin)
            size = np.diff(np.append(begin, len(o)))
            up = split[:, o[begin]]
            prefix, deep = up[2] << 1 | bit, up[1] + 1
            ok = best.open(up[0], bound, shard.ids[prefix << (depth - deep)])
            leaf = ok & (deep == depth)
            if leaf.any():
                best.add(up[0][leaf], bound[leaf], shard.ids[prefix[leaf]], shard.lost[prefix[leaf]])
            more = ok & (deep < depth)
            old.append((np.stack([up[0], deep, prefix, bound, begin, size])[:, more], np.stack([lo, hi, v])[:, np.repeat(more, size)]))
        nodes, ranges = np.concatenate([x for x, _ in old], axis=1), np.concatenate([y for _, y in old], axis=1)
        nodes[4] = np.cumsum(nodes[5]) - nodes[5]


def frequencies(index: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """Documents that hold each of the terms (sorted distinct hashes, at most a block's)."""
    shipped = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known, df = shipped.value, np.zeros(len(shipped.value), np.int64)
        for b in batches:
            for terms, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                have, first = np.frombuffer(terms, np.uint64), np.frombuffer(first, np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(have, known), len(have) - 1)
                df += np.where(have[at] == known, first[at + 1] - first[at], 0)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "df"])

    rows = index.select("terms", "first").mapInArrow(run, "at long, df long").groupBy("at").agg(F.sum("df").alias("df")).collect()
    return {int(vocabulary[r["at"]]): r["df"] for r in rows}


def search_block(index: DataFrame, block: list[tuple], n_all: int, k: int) -> DataFrame:
    """item, place, score, doc_id of the k best documents of each item in a block of (item, term hashes)."""
    spark = index.sparkSession
    own = [np.unique(h, return_counts=True) for _, h in block]
    df = frequencies(index, np.unique(np.concatenate([t for t, _ in own])))
    weight = {t: math.floor(1000 * math.log((2 * n_all + 2) / (2 * x + 1))) for t, x in df.items()}
    rows = [(i, t, c * weight[t]) for i, (terms, counts) in enumerate(own) for t, c in zip(terms.tolist(), counts.tolist(), strict=True) if weight.get(t)]
    q, term, w = (np.array([r[x] for r in rows], kind) for x, kind in ((0, np.int64), (1, np.uint64), (2, np.int64)))
    shipped = spark.sparkContext.broadcast((q, term, w))
    n = len(block)

    def run(batches):
        q, term, w = shipped.value
        best = Best(n, k)
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                search_shard(Shard(*row), q, term, w, best)
        at, place = np.nonzero(best.score > 0)
        score, id_, lost = best.score[at, place], best.id[at, place], best.lost[at, place]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(score), pa.array(id_, mask=lost)], names=["at", "score", "doc_id"])
        trim()

    with small_batches(spark, 1):  # a row is a shard
        found = index.drop("shard").mapInArrow(run, "at long, score long, doc_id long")
        w_ = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(w_)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "at long, item long")
        at = shared_path(spark, "ranked")
        ranked.join(F.broadcast(names), "at").select("item", "rank", "doc_id", "score").write.parquet(at)
    return spark.read.schema("item long, rank int, doc_id long, score long").parquet(at)


def blocks(queries: DataFrame, item_col: str, text_col: str):
    """Lists of (item, term hashes) within the bounds of a block."""
    block, held = [], 0
    rows = queries.select(F.col(f"`{item_col}`").cast("long"), F.col(f"`{text_col}`")).toLocalIterator()
    for item, text in rows:
        hashes, _ = word_hashes(pa.array([text], pa.string()), BETWEEN, VALUES)
        if not len(hashes):
            continue
        if block and (len(block) == BLOCK_ITEMS or held + len(hashes) > BLOCK_TERMS):
            yield block
            block, held = [], 0
        block.append((item, hashes))
        held += len(hashes)
    if block:
        yield block


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """item, rank, doc_id, score: the k best documents (id, text) of every query (item, text)."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], "item long, rank int, doc_id long, score long")
    n_all, l_all = totals(docs)
    if not n_all:
        return empty
    at = shared_path(spark, "wavelet-index")
    with small_batches(spark, 1024):
        build_index(docs, n_all, l_all, id_col).write.parquet(at)
    index = spark.read.schema(INDEX).parquet(at)
    found = [search_block(index, block, n_all, k) for block in blocks(queries, item_col, "text")]
    remove(spark, at)
    for x in found[1:]:
        found[0] = found[0].unionByName(x)
    return found[0] if found else empty


def op13_wavelet_search(spark, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("item", "item_id")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row_, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n_all, sum(len(w)) AS l_all FROM d WHERE len(w) > 0),
p AS (SELECT row_, doc_id, len(w) AS n, unnest(w) AS t FROM d),
f AS (SELECT row_, doc_id, n, t, count(*) AS tf FROM p GROUP BY 1, 2, 3, 4),
v AS (SELECT t, CAST(floor(1000 * ln((2 * n_all + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, s GROUP BY t, n_all),
q AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY 1, 2),
r AS (SELECT item_id, doc_id, row_, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_all) // l_all)))) AS BIGINT) AS score FROM q JOIN v USING (t) JOIN f USING (t), s GROUP BY 1, 2, 3)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 10
"""
