"""The text cascade: the printable prefix of a text and the first kind whose test it passes.

Patterns are fixed values. White space is the set space, tab, line feed, form feed, carriage return.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT = 104_857_600
MIN_TEXT = 32
CSV_DELIMITERS = [",", "|", "\t", " "]
#: lines looked at, confidence needed: a short look first, then a longer one
CSV_LOOKS = [(9, 10), (49, 50)]

S = r"[ \t\n\f\r]"
NAME = r"[:._\-a-zA-Z0-9]+"
ATTRIBUTES = rf"""({S}{NAME}=(("[^<&"]*")|('[^<&']*')))*{S}?"""
PRINTABLE = r"^[\x20-\x7E\t\n\f\r]*"
TAG_START, TAG_END, TAG_SELF = rf"<{NAME}{ATTRIBUTES}>", rf"</{NAME}{S}?>", rf"<{NAME}{ATTRIBUTES}/>"
HTML_TAGS = ["html", "div", "p", "a", "span", "body", "head", "title"]
BLANK = rf"^{S}*$"
HEX = r"^[A-Fa-f0-9\n\r\t\f ]*$"
BASE64 = r"^[A-Za-z0-9+/=_\-.:!\r\n]*$"
BASE64_WHOLE = r"^[A-Za-z0-9+/_\-.:!]*={0,2}$"
BASE85 = r"""^(<~)?[!"#$%&'()*+,\-./0-9:;<=>?@A-Z\[\\\]^_`a-u\n\r ]*(~>)?$"""
LOGS = [r"(?m)^\[[ \t]*[0-9]+\.[0-9]+\][ \t]+.*$", r"(?m)^[A-Za-z0-9_]+[ \t][0-9]{1,2}[ \t][0-9]{2}:[0-9]{2}:[0-9]{2}[ \t][A-Za-z0-9_]+[ \t].*$", r"[0-9]{4}-[0-9]{2}-[0-9]{2}[ \t][0-9]{2}:[0-9]{2}:[0-9]{2}"]
BREAKS = r"(\r\n|\n|\r|\f)+"


def printable_prefix(data: Column) -> Column:
    """Longest prefix of printable ASCII, tab, line feed, form feed and carriage return."""
    return F.regexp_extract(F.decode(F.substring(data, 1, MAX_TEXT), "ISO-8859-1"), PRINTABLE, 0)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def xml_confidence(text: Column) -> Column:
    start, end, own = count(text, TAG_START), count(text, TAG_END), count(text, TAG_SELF)
    return F.least(F.lit(100).cast("long"), F.when(start > 3, 40).otherwise(start * 10) + (end + own) * 10).cast("int")


def html_confidence(text: Column) -> Column:
    hits = sum((F.when(text.rlike(f"<{t}.*>"), 1).otherwise(0) for t in HTML_TAGS[1:]), F.when(text.rlike(f"<{HTML_TAGS[0]}.*>"), 1).otherwise(0))
    return F.floor(hits * 100 / 8).cast("int")


def base64_confidence(text: Column) -> Column:
    joined = F.regexp_replace(text, r"[\r\n]", "")
    whole = joined.rlike(BASE64_WHOLE) & (F.length(joined) % 4 == 0)
    return F.when(~text.rlike(BASE64), 0).when(whole, 100).otherwise(60)


def named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, and only where the whole is asked for."""
    return F.get(F.transform(F.array(value), use), 0)


def csv_lines(text: Column) -> Column:
    """The lines that the longest look needs; what follows them is not split."""
    most = CSV_LOOKS[-1][0]
    return F.slice(F.split(text, "\n", most + 1), 1, most)


def delimiter_counts(lines: Column, delimiter: Column) -> Column:
    """Delimiters of every line; null for lines of two characters or fewer."""
    return F.transform(lines, lambda x: F.when(F.length(x) > 2, (F.length(x) - F.length(F.replace(x, delimiter, F.lit("")))).cast("double")))


def csv_look(counts: Column, lines: int) -> Column:
    """(1 - sd / mean) * 100 of delimiters per line, 0 where they vary more than their mean, the median is below 1,
    or fewer than two lines of over two characters exist."""
    usable = F.array_sort(F.filter(F.slice(counts, 1, lines), lambda x: x.isNotNull()))

    def spread(c: Column, mean: Column) -> Column:
        n = F.size(c)
        sd = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (n - 1))
        middle = F.floor((n - 1) / 2).cast("int")
        median = (F.get(c, middle) + F.get(c, (n - 1) - middle)) / 2
        ratio = lambda r: F.when((r > 1) | (median < 1), 0.0).otherwise((1 - r) * 100)
        return F.when((n < 2) | (mean == 0), 0.0).otherwise(named(sd / mean, ratio))

    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return named(usable, lambda c: F.when(F.size(c) < 2, 0.0).otherwise(named(mean(c), lambda m: spread(c, m))))


def _csv_of_counts(counts: Column) -> Column:
    (short, low), (long_, high) = CSV_LOOKS
    second = lambda: named(csv_look(counts, long_), lambda s: F.when(s >= high, s).otherwise(0.0))
    return F.when(csv_look(counts, short) >= low, second()).otherwise(0.0)


def csv_confidence(text: Column, delimiter: str) -> Column:
    return named(delimiter_counts(csv_lines(text), F.lit(delimiter)), _csv_of_counts)


def first_csv_confidence(text: Column) -> Column:
    """Confidence for the first delimiter that gives one; null without."""

    def of(lines: Column) -> Column:
        each = F.transform(F.array(*map(F.lit, CSV_DELIMITERS)), lambda d: named(delimiter_counts(lines, d), _csv_of_counts))
        return F.get(F.filter(each, lambda c: c > 0), 0)

    return named(csv_lines(text), of)


def log_confidence(text: Column) -> Column:
    """Best of three line formats: matches * 100 / line breaks; needs a match in the first 1,024 characters."""
    breaks = count(text, BREAKS)
    each = [F.when(F.substring(text, 1, 1024).rlike(p) & (breaks > 0), F.least(F.lit(100).cast("long"), F.expr("1L") * F.floor(count(text, p) * 100 / breaks))).otherwise(0) for p in LOGS]
    return F.greatest(*each).cast("int")


def verdict(text: Column) -> Column:
    """struct(brief, confidence) of a printable prefix; null where it is under 32 characters. Each value is computed once, in its branch."""
    kind = lambda brief, confidence: F.struct(F.lit(brief).alias("brief"), confidence.cast("int").alias("confidence"))
    marked = lambda xml: named(html_confidence(text), lambda h: F.when(h >= 50, kind("HTML", h)).otherwise(kind("XML", xml)))
    log = lambda: named(log_confidence(text), lambda c: F.when(c >= 50, kind("LOG", c)).otherwise(kind("TEXT", F.lit(100))))
    csv = lambda: named(first_csv_confidence(text), lambda c: F.when(c > 0, kind("CSV", F.floor(c))).otherwise(log()))
    coded = F.when(text.rlike(HEX), kind("HEX", F.lit(100))).when(text.rlike(BASE64), kind("BASE64", base64_confidence(text))).when(text.rlike(BASE85), kind("BASE85", F.lit(100)))
    asked = named(xml_confidence(text), lambda xml: F.when(xml >= 50, marked(xml)).otherwise(coded.otherwise(csv())))
    return F.when(F.length(text) < MIN_TEXT, None).when(text.rlike(BLANK), kind("WHITESPACE", F.lit(100))).otherwise(asked)
