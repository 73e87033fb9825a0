"""Quality rules as a short-circuit cascade: cheap rules that reject much are asked first.

``cascade_order`` asks each rule of a random sample, takes its seconds beyond those of an empty plan, and orders
the rules by rejections per second; ``verdict`` asks them in that order inside one CASE, which stops at the first
rule that a document fails. Each rule computes the counts that it needs inside its own branch, so a document that
a cheap rule rejects never reaches a costly one (``filter_quality``). Where all counts are wanted anyway
(``apply_rules``), ``measures`` computes them once and the rules compare them. The order changes the cost only:
the verdict is "no rule failed" whatever the order. Native: DataFrame functions only, no shuffle at all (repeated
windows are found inside each row by sorting its own window hashes).

Cases: null and empty texts have zero counts and fail the base rule; texts of any length are read whole (the
sample that orders the rules looks at ``SAMPLE_CHARS`` characters of each of its texts); equal rows get equal
verdicts; an empty table gives an empty result; other columns pass through ``filter_quality`` and are ignored by
``measures``, also when they are named like a measure.
Windows of words are compared by 64-bit hashes; two different windows of one text share one with a
chance below 1e-10 for texts of 20,000 words.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import table, words_col

WINDOW = 5
#: Rows of the sample that orders the rules, about, and characters of each; copies of it that are timed; rounds.
#: They decide nothing but the order.
SAMPLE_ROWS, SAMPLE_CHARS, COPIES, ROUNDS = 200, 100_000, 8, 3


#: Rules beyond the base one, as DuckDB says them. All compare whole counts, so no rounding is involved.
RULES_SQL = {
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "exclamations": "10 * (length(text) - length(replace(text, '!', ''))) > n_words",
    "capitals": "2 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > length(regexp_replace(text, '[^A-Za-z]+', '', 'g'))",
    "stuttering": "10 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > 3 * n_words",
}


@dataclass(frozen=True)
class Rule:
    """A document fails where ``failed`` is true, a Column made from the named counts, ``text`` and ``w`` (its words)."""

    name: str
    failed: Callable[[dict[str, Column]], Column]


def rules() -> list[Rule]:
    """The rules of ``RULES_SQL`` as Columns, and the costly half of the base rule."""

    def capitals(c):
        return 2 * F.length(F.regexp_replace(c["text"], "[^A-Z]+", "")) > F.length(F.regexp_replace(c["text"], "[^A-Za-z]+", ""))

    def stuttering(c):
        return 10 * F.size(F.filter(c["w"], lambda x, i: (i > 0) & (x == F.get(c["w"], i - 1)))) > 3 * c["n_words"]

    return [
        Rule("repeated_windows", lambda c: 100 * c["n_repeat_words"] > 20 * c["n_words"]),
        Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"]),
        Rule("duplicate_lines", lambda c: named(c["lines"], lambda x: 2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
        Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 15 * c["n_words"])),
        Rule("exclamations", lambda c: 10 * (F.length(c["text"]) - F.length(F.replace(c["text"], F.lit("!"), F.lit("")))) > c["n_words"]),
        Rule("capitals", capitals),
        Rule("stuttering", stuttering),
    ]


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once: a transform over a one-element array names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Number of words in windows whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

    def twice(a: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(a, j)["h"] == x["h"], F.lit(False))
        marked = F.filter(a, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return F.sort_array(F.transform(marked, lambda x: x["at"]))

    def union(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x)

    return named(named(pairs, twice), union)


def counts(text: Column, w: Column) -> dict[str, Column]:
    """All counts of a text and its words, each as an expression of its own: only those that are used are computed."""
    long = lambda c: c.cast("long")
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    repeated = lambda x: F.when(F.size(F.array_distinct(x)) < F.size(x), _covered(x)).otherwise(0)
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return {
        "text": text, "w": w, "n_words": long(F.size(w)), "word_chars": long(F.length(F.array_join(w, ""))),
        "n_symbols": long(F.length(F.regexp_replace(text, "[^#*$%&|<>]+", ""))),
        "lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "n_repeat_words": long(F.when(F.size(w) > WINDOW, named(named(hashes, windows), repeated)).otherwise(0)),
    }


def _rows(df: DataFrame, text_col: str, keep: list[str] | None) -> DataFrame:
    """row_ (struct of the kept columns), text, w."""
    names = df.columns if keep is None else keep
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).alias("none"))
    one = df.select(row.alias("row_"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return one.select("row_", "text", words_col(F.col("text")).alias("w"))


def measures(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (default: all) and a struct ``m_`` with the text, its words, lines and counts."""
    rows = _rows(df, text_col, keep)
    c = counts(F.col("text"), F.col("w"))
    one = rows.select("row_", *[x.alias(k) for k, x in c.items()])
    dups = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    return one.select("row_", F.struct(*c, dups.alias("n_dup_lines")).alias("m_"))


def measured() -> dict[str, Column]:
    """The counts of ``measures``, for rules."""
    return {k: F.col("m_")[k] for k in ("text", "w", "n_words", "word_chars", "n_symbols", "lines", "n_repeat_words")}


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def cascade_order(df: DataFrame, text_col: str = "text", asked: list[Rule] | None = None) -> list[dict]:
    """Rules with their share of rejected rows and seconds on a sample, most rejections per second first.

    The sample is random over all rows, ``SAMPLE_ROWS`` of them or so whatever the input's size, and is read
    ``COPIES`` times over, so that a rule's seconds are more than a job's. Of each rule's seconds those of a plan
    without a rule are taken off, the least of ``ROUNDS`` counts, and costs are compared in powers of two.
    """
    spark, asked = df.sparkSession, rules() if asked is None else asked
    n = df.count()
    found = df.select(F.substring(F.col(f"`{text_col}`"), 1, SAMPLE_CHARS).alias("text")).sample(min(1.0, SAMPLE_ROWS / max(1, n)), 17).collect() if n else []
    if not found:
        return [{"rule": r, "rejects": 0.0, "seconds": 0.0} for r in asked]
    rows = spark.createDataFrame(found, "text string").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES))))
    sample = _rows(rows, "text", []).select("text", "w").cache()
    c = counts(F.col("text"), F.col("w"))
    real = c["n_words"] >= 10

    def timed(condition: Column) -> tuple[float, int]:
        best, hits = math.inf, 0
        for _ in range(ROUNDS):
            began = time.perf_counter()
            hits = sample.where(condition).count()
            best = min(best, time.perf_counter() - began)
        return best, hits

    sample.count()
    empty, total = timed(real)
    out = []
    for rule in asked:
        seconds, hits = timed(real & rule.failed(c))
        out.append({"rule": rule, "rejects": hits / max(1, total), "seconds": 2.0 ** round(math.log2(max(seconds - empty, 0.004)))})
    sample.unpersist()
    # half a document more, so that of rules that reject nothing the cheaper one is asked first
    return sorted(out, key=lambda x: (-(x["rejects"] + 0.5 / (total + 1)) / x["seconds"], x["rule"].name))


def verdict(order: list[dict], c: dict[str, Column], first: Column) -> Column:
    """True where neither ``first`` holds nor a rule fails, asked in the given order up to the first that does."""
    asked = F.when(first, False)
    for x in order:
        asked = asked.when(x["rule"].failed(c), False)
    return asked.otherwise(True)


def apply_rules(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row_`` (the kept columns), ``m_`` (the counts), base_failed and kept of every row."""
    order, c = cascade_order(df, text_col), measured()
    return measures(df, text_col, keep).select("row_", "m_", base_failed(c).alias("base_failed"), verdict(order, c, base_failed(c)).alias("kept"))


def filter_quality(df: DataFrame, text_col: str = "text", asked: list[Rule] | None = None) -> DataFrame:
    """The rows of at least ten words that fail no rule, with all their columns.

    The row number in the condition keeps Catalyst from pushing it below the projection that cuts the words:
    written out there, it would cut them once for each use.
    """
    c = counts(F.col("text"), F.col("w"))
    found = _rows(df, text_col, None).select("row_", verdict(cascade_order(df, text_col, asked), c, c["n_words"] < 10).alias("kept"))
    stays = found.select("row_", (F.col("kept") & (F.monotonically_increasing_id() >= 0)).alias("stays_"))
    return stays.where("stays_").select("row_.*")


def op1_quality_cascade(spark, sf_dir: str) -> DataFrame:
    """Counts, base rule and verdict of every document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = apply_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row_.doc_id", *[f"m_.{c}" for c in names], "base_failed", "kept")


def measures_sql(source: str) -> str:
    """CTEs ending in ``counted``: doc_id, text, w and the counts of the table ``source``."""
    return f"""
split_ AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM {source}),
win AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM split_ WHERE len(w) > 5),
rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(k) AS n FROM (SELECT doc_id, least(5, coalesce(lead(p) OVER (PARTITION BY doc_id ORDER BY p) - p, 5)) AS k FROM rep) GROUP BY doc_id),
counted AS (SELECT s.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM split_ s LEFT JOIN cov USING (doc_id))"""


BASE_SQL = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def verdict_sql() -> str:
    return " AND ".join(["NOT " + BASE_SQL, *[f"NOT ({r})" for r in RULES_SQL.values()]])


def op1_sql() -> str:
    return f"WITH {measures_sql('documents')} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE_SQL} AS base_failed, {verdict_sql()} AS kept FROM counted"
