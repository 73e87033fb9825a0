"""Small documents with every awkward case, and brute-force versions of the operators."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return (text or "").encode().split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ba", "ke", "lo", "mi", "tu", "né", "sa"]) for _ in range(r.randrange(1, 4))) for _ in range(n))


def documents() -> list[tuple]:
    base, shared = prose(1, 120), prose(2, 70)
    near = base.split()
    near[40] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, prose(3, 30) + " " + shared + " " + prose(4, 30)), (5, prose(5, 40) + "\n" + shared + "\n" + prose(6, 10)),
        (6, None), (7, ""), (8, " \t\n"), (9, "one"), (10, "one two"), (11, "one two"), (12, prose(7, 6000)), (13, "same line here\nsame line here\nother words in this line to have ten of them"),
        (14, "a b c d e a b c d e a b c d e"), (15, "###!!! %%% $$$ *** &&& | | < > # # # #"), (16, "NOISE!! NOISY!! WORDS!! ALL!! IN!! CAPS!! THAT!! SHOUT!! AND!! SHOUT!! MORE!!"),
        (17, "x" * 30000 + " <|endoftext|> tail\x00 end"), (None, prose(8, 60)),
    ]
    return [(i, t, "en", "s", len(t or "")) for i, t in rows]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def clashing(df):
    """The same rows with extra columns named like inner ones."""
    from pyspark.sql import functions as F

    out = df
    for name in ("m_", "row_", "kept", "node", "a", "b", "key", "id", "ids", "score", "h1", "component_id", "spans", "shard", "words"):
        out = out.withColumn(name, F.lit("clash"))
    return out


def shingles(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_components(rows, width, percent):
    sets = {i: shingles(t, width) for i, t, *_ in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return components(ids, links)


def quality_counts(text):
    t = text or ""
    w = words(t)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if win[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def shared_passages(rows, n):
    """Pairs of documents with n equal consecutive words."""
    seen, links = defaultdict(set), set()
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        for k in range(len(w) - n + 1):
            seen[tuple(w[k : k + n])].add(i)
    for s in seen.values():
        s = sorted(x for x in s if x is not None)
        links |= {(s[0], x) for x in s[1:]}
    return links


def near_passages(rows, words_, width, percent):
    """Pairs of documents with two stretches of that many words whose sets of shingles are near-equal: all windows against all."""
    size, sets = words_ - width + 1, {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sh = [tuple(w[k : k + width]) for k in range(len(w) - width + 1)]
        if i is not None and len(sh) >= size:
            sets[i] = [frozenset(sh[k : k + size]) for k in range(len(sh) - size + 1)]
    links, ids = set(), sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b] if not x.isdisjoint(y)):
                links.add((a, b))
    return links


def hub_rows(n: int, hub_id: int, words_: int = 300, changed: int = 15, seed: int = 7):
    """A hub and n texts that are each near it, and not near each other (2-word shingles, 0.8)."""
    r = random.Random(seed)
    hub = [f"h{k}" for k in range(words_)]
    rows = [(hub_id, " ".join(hub), "en", "s", 0)]
    for k in range(n):
        own = hub.copy()
        for p in r.sample(range(0, words_, 2), changed):
            own[p] = f"x{k}y{p}"
        rows.append((1000 + k, " ".join(own), "en", "s", 0))
    return rows
