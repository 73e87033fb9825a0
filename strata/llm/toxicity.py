"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams and itself, hashed into ``BUCKETS`` rows of an embedding
table; a window of ``WINDOW`` words is the average of its words' vectors (a word that repeats in a window counts once), and a two-class softmax reads
that average. Table and softmax are trained together (sparse Adagrad). A document is as toxic as its
worst window of three words, so one insult in a long text is not averaged away: training starts with every window under
its document's label and then keeps, of each toxic document, the window that the model finds worst.
A held-back fifth of the training rows fits scale and offset of the final score.

Only rows with crc32(id as text) mod 3 != 1 may train, of them at most ``TRAIN_ROWS`` per class, those
with the least hash of the id: a bounded sample, whatever the input's size. Scoring covers every row.
A misspelt word shares most n-grams with the word it stands for, and so most of its vector.

Cases: null and empty texts, and texts without a letter or digit, score 0; texts of any length are read
whole; rows that are equal score equally; without labelled rows of both classes every score is 0; an
empty table gives an empty result; a null id is never held out and never trains, rows that repeat an id are scored each; other columns of the input are ignored (``score``) or kept
(``filter_toxic``).
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import pieces, table, texts, trim

BUCKETS = 1 << 17
MASK = BUCKETS - 1
DIM = 8
WINDOW = 3  #: words; one insult between other words is not averaged away
GRAMS = (3, 4)
#: Bounds on what trains the model: labelled rows of each class, and bytes of a text (longer ones are not in the sample).
TRAIN_ROWS = 1200
TRAIN_BYTES = 1 << 18
THRESHOLD = 0.7
PART = re.compile(r"\w+")


def grams(word: bytes) -> list[int]:
    """Buckets of a word between spaces: of each run of letters and digits in it, lower case, with its n-grams."""
    out = []
    crc = zlib.crc32
    for part in PART.findall(word.decode("utf-8", "replace").lower()):
        w = f"<{part}>"
        if w.isascii():
            e = w.encode()
            out.append(crc(e) & MASK)
            out += [crc(e[i : i + n]) & MASK for n in GRAMS for i in range(len(e) - n + 1)]
        else:
            out.append(crc(w.encode()) & MASK)
            out += [crc(w[i : i + n].encode()) & MASK for n in GRAMS for i in range(len(w) - n + 1)]
    return out


@dataclass
class Model:
    """Per-bucket logit (embedding times softmax direction), offset, and the fitted scale of scores."""

    bucket: np.ndarray
    bias: float
    scale: float
    shift: float


class Words(dict):
    """Word to its share of a window's logit; None for words without letters or digits."""

    def __init__(self, bucket: np.ndarray, limit: int = 200_000):
        super().__init__()
        self.bucket, self.limit = bucket.tolist(), limit

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.limit:
            self.clear()
        g = grams(word)
        out = self[word] = sum(map(self.bucket.__getitem__, g)) / len(g) if g else float("nan")
        return out


def worst_window(values: np.ndarray) -> float:
    """Largest average of a window of words (the last one may be shorter); what repeats in a window counts once."""
    n = len(values)
    rows = -(-n // WINDOW)
    x = np.full(rows * WINDOW, np.inf)
    x[:n] = values
    x = np.sort(x.reshape(rows, WINDOW), axis=1)
    x[:, 1:][x[:, 1:] == x[:, :-1]] = 0
    x[np.isinf(x)] = 0
    size = np.full(rows, WINDOW)
    size[-1] = n - (rows - 1) * WINDOW
    return float((x.sum(axis=1) / size).max())


class _Trainer:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.w = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.ge, self.gw, self.gb = np.full(BUCKETS, 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32), np.full(2, 1e-8, np.float32)
        self.rng = rng

    def vocabulary(self, windows: list[list[bytes]], lengths: list[int]) -> None:
        self.length = np.array(lengths, np.float32)
        words = sorted({w for x in windows for w in x})
        self.at = {w: i for i, w in enumerate(words)}
        lists = [grams(w) for w in words]
        self.ids = np.array([g for x in lists for g in x], np.int64)
        self.size = np.array([len(x) for x in lists], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.array([self.at[w] for x in windows for w in x], np.int64)
        self.n = np.array([len(x) for x in windows], np.int64)
        self.first = np.cumsum(self.n) - self.n

    @staticmethod
    def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Concatenated ranges start..start+size-1."""
        ends = np.cumsum(size)
        return np.repeat(start - (ends - size), size) + np.arange(ends[-1])

    def forward(self, rows: np.ndarray):
        n = self.n[rows]
        words, inverse = np.unique(self.flat[self.spans(self.first[rows], n)], return_inverse=True)
        size = self.size[words]
        ids = self.ids[self.spans(self.start[words], size)]
        v = np.add.reduceat(self.e[ids], np.cumsum(size) - size) / size[:, None]
        x = np.add.reduceat(v[inverse], np.cumsum(n) - n) / self.length[rows][:, None]
        z = x @ self.w + self.b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        return p / p.sum(axis=1, keepdims=True), x, (n, words, inverse, size, ids)

    def step(self, rows: np.ndarray, labels: np.ndarray, rate: float) -> None:
        p, x, (n, words, inverse, size, ids) = self.forward(rows)
        d = p
        d[np.arange(len(rows)), labels] -= 1
        dx = (d @ self.w.T) / self.length[rows][:, None]
        gw, gb = x.T @ d / len(rows), d.mean(axis=0)
        dv = np.zeros((len(words), DIM), np.float32)
        np.add.at(dv, inverse, np.repeat(dx, n, axis=0))
        dv /= size[:, None]
        order = np.argsort(ids, kind="stable")
        unique, begin = np.unique(ids[order], return_index=True)
        g = np.add.reduceat(np.repeat(dv, size, axis=0)[order], begin)
        self.ge[unique] += (g**2).mean(axis=1)
        self.e[unique] -= rate * g / np.sqrt(self.ge[unique])[:, None]
        self.gw += gw**2
        self.gb += gb**2
        self.w -= rate * gw / np.sqrt(self.gw)
        self.b -= rate * gb / np.sqrt(self.gb)

    def epoch(self, rows: np.ndarray, labels: np.ndarray, rate: float) -> None:
        batch = min(512, max(32, len(rows) // 150))  # a small sample still gets some hundred steps
        order = self.rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            k = order[at : at + batch]
            self.step(rows[k], labels[k], rate)

    def toxic(self, rows: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(rows[i : i + 2048])[0][:, 1] for i in range(0, len(rows), 2048)])


def fit(rows: list[tuple[str | None, int]], seed: int = 7) -> Model:
    """A model from (text, label) rows."""
    none = Model(np.zeros(BUCKETS, np.float32), -30.0, 1.0, 0.0)
    docs = []
    for text, label in rows:
        words = [w for w in (text or "").encode().split() if PART.search(w.decode("utf-8", "replace"))]
        if words:
            docs.append((words, int(label)))
    if len({label for _, label in docs}) < 2:
        return none
    rng = np.random.default_rng(seed)
    held = np.zeros(len(docs), bool)
    for label in (0, 1):
        own = [i for i, (_, x) in enumerate(docs) if x == label]
        if len(own) >= 10:
            held[rng.permutation(own)[: len(own) // 5]] = True
    train = [d for d, h in zip(docs, held, strict=True) if not h]
    windows = [words[i : i + WINDOW] for words, _ in train for i in range(0, len(words), WINDOW)]
    owner = np.array([k for k, (words, _) in enumerate(train) for _ in range(0, len(words), WINDOW)])
    label = np.array([x for _, x in train])[owner]
    t = _Trainer(seed)
    t.vocabulary([list(dict.fromkeys(w)) for w in windows], [len(w) for w in windows])
    rows_all = np.arange(len(windows))
    passes = min(8, max(1, 40_000 // len(windows)))  # few windows are passed over more often
    for rate in (0.3, 0.2):
        for _ in range(passes):
            t.epoch(rows_all, label, rate)
    negative = rows_all[label == 0]
    for rate in (0.2, 0.15, 0.1):
        worst: dict[int, int] = {}
        own = rows_all[label == 1]
        p = t.toxic(own)
        for k in np.argsort(p):
            worst[int(owner[own[k]])] = int(own[k])
        chosen = np.array(sorted(worst.values()))
        few = rng.permutation(negative)[: 20 * len(chosen)]
        few = np.concatenate([few, negative[np.argsort(-t.toxic(negative))[: 2 * len(chosen)]]])
        for _ in range(passes):
            t.epoch(np.concatenate([np.repeat(chosen, 4), few]), np.concatenate([np.ones(4 * len(chosen), int), np.zeros(len(few), int)]), rate)
    bucket = (t.e @ (t.w[:, 1] - t.w[:, 0])).astype(np.float32)
    model = Model(bucket, float(t.b[1] - t.b[0]), 1.0, 0.0)
    words = Words(bucket)
    check = [d for d, h in zip(docs, held, strict=True) if h] or docs
    x = np.array([worst_window(words_of(words, d)) for d, _ in check]) + model.bias
    y = np.array([lab for _, lab in check], float)
    model.scale, model.shift = _calibrate(x, y)
    return model


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by damped Newton steps with a small penalty on the scale."""
    mean, spread = x.mean(), x.std() + 1e-9
    z = (x - mean) / spread
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([((p - y) * z).sum() + 0.05 * a, (p - y).sum() + 0.01 * b])
        s = p * (1 - p)
        h = np.array([[(s * z * z).sum() + 0.05, (s * z).sum()], [(s * z).sum(), s.sum() + 0.01]])
        d = np.linalg.solve(h, g)
        d *= min(1.0, 1.0 / (np.abs(d).max() + 1e-9))
        a, b = a - d[0], b - d[1]
    return float(a / spread), float(b - a * mean / spread)


def words_of(cache: Words, words: list[bytes]) -> np.ndarray:
    """Values of the words that have letters or digits."""
    v = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
    return v[~np.isnan(v)]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_ROWS) -> list[tuple[str | None, int]]:
    """A bounded sample: per class the ``per_class`` labelled ids of least hash that may train, with one text each (the
    least, if an id repeats) of at most ``TRAIN_BYTES``.

    Texts come by a join with at most 2 * per_class ids, which is the proven bound of what is broadcast.
    """
    can = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [can.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    ids = parts[0].union(parts[1])
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    found = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted((r["doc_id"], r["text"] or "", r["toxic"]) for r in found.collect())
    return [(t, y) for _, t, y in rows]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every row. The model's size is fixed (``BUCKETS`` floats), so it is shipped whole."""
    kept = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text")
    kind = kept.schema["id"].dataType.simpleString()
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shipped.value
        words = Words(m.bucket)
        for b in pieces(batches):
            out = []
            for t in texts(b.column(1)):
                v = words_of(words, t.split())
                z = m.scale * (worst_window(v) + m.bias) + m.shift if len(v) else -np.inf
                out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))) if len(v) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=["id", "score"])
        trim(words)

    return kept.mapInArrow(run, f"id {kind}, score double")


def filter_toxic(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    shipped = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches):
        m = shipped.value
        words = Words(m.bucket)
        for b in pieces(batches):
            keep = []
            for t in texts(b.column(at)):
                v = words_of(words, t.split())
                keep.append(not len(v) or 1 / (1 + np.exp(-np.clip(m.scale * (worst_window(v) + m.bias) + m.shift, -500, 500))) < threshold)
            yield b.filter(pa.array(keep, pa.bool_()))
        trim(words)

    return df.mapInArrow(run, df.schema)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(training_rows(docs, labels))


def op6_subword_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
