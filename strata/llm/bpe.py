"""Byte-level BPE with a minimal acyclic transducer as the lexicon of frequent words.

Words are counted over all documents; the most frequent ``LEXICON_WORDS`` (a bound on the lexicon, not on
the counts) are encoded once and compiled into a minimal acyclic automaton: states that accept the same
suffixes are one state, and the number of words passed on the way to a final state is the word's index
into a table of ids. The file is shipped by ``SparkContext.addFile`` and memory-mapped by every worker.
Words that are not in it are merged exactly, pair by pair in rank order. A worker remembers the ids of the
words it met, from the lexicon or merged.

The tokenizer is read from its JSON file: merges, vocabulary, added tokens. Texts are cut by the
byte-level pattern; added tokens in a text become their ids, as the tokenizers library does.

Cases: null and empty texts have no ids and decode to the empty text; texts and words of any length are
encoded whole (long words through a heap of pairs); repeated rows give repeated rows; an empty table
gives an empty result and an empty lexicon; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import struct
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import checkpoint, pieces, shared_path, table, texts
from strata.llm.tokens import byte_letters
from strata.session import shared_dir

LEXICON_WORDS = 16_384
#: Fixed pattern of byte-level pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_WORD = 48
ID_BITS = 24
ID_MASK = (1 << ID_BITS) - 1
NEVER = 1 << 62


class Bpe:
    """Merges and vocabulary of one tokenizer file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            layout = json.load(f)
        model = layout["model"]
        back = {chr(v): k for k, v in byte_letters().items()}
        vocab = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.packed = {p: rank << ID_BITS | new for p, (rank, new) in self.merges.items()}
        self.byte_ids = [vocab[chr(c)] for _, c in sorted(byte_letters().items())]
        self.added = {x["content"]: x["id"] for x in layout["added_tokens"]}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.tokens = [b""] * size
        for t, i in vocab.items():
            self.tokens[i] = bytes(back[c] for c in t)
        for t, i in self.added.items():
            self.tokens[i] = t.encode()
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.spaces = regex.compile(r"\s\s|^\s|\s$").search

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: always the adjacent pair of lowest rank, leftmost first."""
        ids = [self.byte_ids[b] for b in word]
        if len(ids) > LONG_WORD:
            return self._merge_long(ids)
        get = self.packed.get
        ranks = [get(p, NEVER) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best & ID_MASK]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merges[p], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, new, i, pair = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], alive[j] = new, False
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (p := (new, ids[k])) in self.merges:
                    heapq.heappush(heap, (*self.merges[p], i, p))
            if (h := left[i]) >= 0 and (p := (ids[h], new)) in self.merges:
                heapq.heappush(heap, (*self.merges[p], h, p))
        return [x for x, a in zip(ids, alive, strict=True) if a]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic automaton over the words, with the ids of each word by its index in sorted order."""
    register: dict[tuple, int] = {}
    states: list[tuple] = []

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    words = sorted(entries)
    path: list[list] = [[False, []]]  # nodes on the way of the last word: final, finished edges; labels below
    labels: list[int] = []
    for w in words:
        common = 0
        while common < min(len(labels), len(w)) and labels[common] == w[common]:
            common += 1
        while len(labels) > common:
            child = frozen(path.pop())
            path[-1][1].append((labels.pop(), child))
        for b in w[common:]:
            labels.append(b)
            path.append([False, []])
        path[-1][0] = True
    while labels:
        child = frozen(path.pop())
        path[-1][1].append((labels.pop(), child))
    root = frozen(path[0])
    below = [0] * len(states)  # children are frozen before their parents
    for s, (final, edges) in enumerate(states):
        below[s] = final + sum(below[t] for _, t in edges)
    first, label, target, skip = array("I", [0]), bytearray(), array("I"), array("I")
    for final, edges in states:
        passed = int(final)
        for b, t in edges:
            label.append(b)
            target.append(t)
            skip.append(passed)
            passed += below[t]
        first.append(len(label))
    ids, starts = array("I"), array("I", [0])
    for w in words:
        ids.extend(entries[w])
        starts.append(len(ids))
    label.extend(b"\0" * (-len(label) % 4))
    final = bytearray(int(f) for f, _ in states)
    final.extend(b"\0" * (-len(final) % 4))
    parts = [first.tobytes(), target.tobytes(), skip.tobytes(), starts.tobytes(), ids.tobytes(), bytes(label), bytes(final)]
    return struct.pack("<8I", root, *map(len, parts)) + b"".join(parts)


class Lexicon:
    """A compiled lexicon, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = struct.unpack_from("<8I", self.map)
        self.root, at, views = head[0], 32, []
        for n in head[1:]:
            views.append((at, n))
            at += n
        view = memoryview(self.map)
        self.first, self.target, self.skip, self.starts, self.ids = (view[a : a + n].cast("I") for a, n in views[:5])
        self.labels, self.final = views[5][0], views[6][0]

    def index(self, word: bytes) -> int:
        """Place of the word in sorted order, -1 if it is not in the lexicon."""
        state, passed = self.root, 0
        first, find, labels = self.first, self.map.find, self.labels
        for i in range(len(word)):
            e = find(word[i : i + 1], labels + first[state], labels + first[state + 1])
            if e < 0:
                return -1
            e -= labels
            passed += self.skip[e]
            state = self.target[e]
        return passed if self.map[self.final + state] else -1

    def get(self, word: bytes) -> list[int] | None:
        k = self.index(word)
        return None if k < 0 else self.ids[self.starts[k] : self.starts[k + 1]].tolist()


class Encoder:
    """Whole texts to ids; remembers the ids of at most ``limit`` chunks between spaces."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon | None, limit: int = 500_000):
        outer = self
        self.bpe, self.lexicon = bpe, lexicon

        class Memory(dict):
            def __init__(self, prefix: str):
                super().__init__()
                self.prefix = prefix

            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= limit:
                    self.clear()
                out = self[chunk] = outer.words[self.prefix + chunk] if chunk.isalpha() else outer.pattern(self.prefix + chunk)
                return out

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= limit:
                    self.clear()
                out = self[word] = array("I", outer.word(word.encode())).tobytes()
                return out

        self.words = Words()
        self.line_start, self.after_space = Memory(""), Memory(" ")
        self.newline = self.pattern("\n")

    def word(self, word: bytes) -> list[int]:
        found = self.lexicon.get(word) if self.lexicon else None
        return self.bpe.merge(word) if found is None else found

    def pattern(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.bpe.find(text)))

    def plain(self, text: str) -> bytes:
        """Text without added tokens. Where single white-space characters separate chunks, no match of the
        pattern spans two chunks except for the space before one, so chunks are encoded on their own."""
        if self.bpe.spaces(text):
            return self.pattern(text)
        lines = []
        start, after = self.line_start.__getitem__, self.after_space.__getitem__
        for line in text.split("\n"):
            chunks = line.split(" ")
            lines.append(start(chunks[0]))
            lines.extend(map(after, chunks[1:]))
            lines.append(self.newline)
        return b"".join(lines[:-1])

    def encode(self, text: str) -> bytes:
        if self.bpe.special is None or not self.bpe.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.bpe.special.finditer(text):
            out += [self.plain(text[at : m.start()]), array("I", [self.bpe.added[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


def count_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word (UTF-8 bytes between white space), n: over all rows. Summed in each task before rows are dealt by word."""

    def run(batches):
        counts: Counter = Counter()

        def emit():
            keys = list(counts)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[k] for k in part], pa.int64())], names=["word", "n"])
            counts.clear()

        for b in pieces(batches):
            for t in texts(b.column(0)):
                counts.update(t.split())
            if len(counts) > 500_000:  # bounds the memory; the sums stay exact
                yield from emit()
        yield from emit()

    return df.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(df: DataFrame, tokenizer_path: str, text_col: str = "text", words: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the most frequent words: all whose count reaches a level (sixteen to each doubling)
    that at most ``words`` words reach."""
    bpe = Bpe(tokenizer_path)
    counts = checkpoint(count_words(df, text_col).where("n > 1").withColumn("level", F.floor(F.log2("n") * 16).cast("int")))
    left, least = words, None
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 16 * 63 levels
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    top = [] if least is None else [bytes(r["word"]).decode() for r in counts.where(F.col("level") >= least).collect()]
    entries = {}
    for w in top:
        for t in (*bpe.find(" " + w), *bpe.find(w)):
            entries[t.encode()] = None
    return compile_lexicon({t: bpe.merge(t) for t in entries})


def ship(spark, data: bytes) -> str:
    """Sends a file to all executors, from the folder that they share with the driver; its name there. Equal data
    keep one path, which may be added again."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    jvm, new = spark._jvm, shared_path(spark, "lexicon")
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(jvm.org.apache.hadoop.fs.Path(new))
        out.write(data)
        out.close()
        fs.rename(jvm.org.apache.hadoop.fs.Path(new), path)
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def list_array(parts: list[bytes]) -> pa.Array:
    """Little-endian 32-bit ids of each row as a list column."""
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def encode(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", lexicon: bytes | None = None) -> DataFrame:
    """id, ids (array of int) of every text. Without a lexicon one is built from all rows of ``df``."""
    name = ship(df.sparkSession, build_lexicon(df, tokenizer_path, text_col) if lexicon is None else lexicon)
    kept = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    kind = kept.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import SparkFiles

        encoder = Encoder(Bpe(tokenizer_path), Lexicon(SparkFiles.get(name)))
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), list_array([encoder.encode(t or "") for t in b.column(1).to_pylist()])], names=["id", "ids"])

    return kept.mapInArrow(run, f"id {kind}, ids array<int>")


def decode(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """id, ids, text: the text that the ids stand for; bytes that are no UTF-8 become U+FFFD."""
    kind = df.schema["id"].dataType.simpleString()

    def run(batches):
        tokens = Bpe(tokenizer_path).tokens
        size = np.array([len(t) for t in tokens], np.int64)
        start = np.cumsum(size) - size
        letters = np.frombuffer(b"".join(tokens), np.uint8)
        for b in pieces(batches):
            lists = b.column(1)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            n = np.diff(lists.offsets.to_numpy()) if lists.null_count == 0 else np.array([len(x or ()) for x in lists.to_pylist()], np.int64)
            own = size[ids]
            ends = np.cumsum(own)
            raw = letters[np.repeat(start[ids] - (ends - own), own) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
            cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
            out = [raw[x:y].decode("utf-8", "replace") for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["id", "ids", "text"])

    return df.select("id", "ids").mapInArrow(run, f"id {kind}, ids array<int>, text string")


def op5_bpe_lexicon(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    back = decode(encode(table(spark, sf_dir, "documents"), path), path)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return back.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
