"""URL filters: captures against list entries that were active when they were fetched.

Dated entries (pattern, at, action ``add`` or ``remove``) become validity intervals [since, until); a capture is
blocked where an interval of its host, or of a domain above it, holds its fetch date. The list is broadcast only
up to ``BROADCAST_ROWS`` intervals (a checked bound); beyond it both sides are dealt by (name, time slot), so a
host that a third of all captures share is spread over the slots and Spark can split what is left.

Cases: of several entries of a pattern on one date the last word is ``remove``; adding what is active, or removing
what is not, changes nothing; entries without pattern or date are void; a capture whose url is null, empty or
without host, or whose date is null, is not blocked; repeated captures are returned as often as they occur; empty
tables give empty results or no block; extra columns of the captures are kept, but for those named like an added one
(``ADDED``), whose place the added ones take. ``validity`` reads pattern, at and action only; a null action is a removal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strata.llm.common import checkpoint, table

BROADCAST_ROWS = 250_000
SLOT_DAYS = 28
FAR = "9999-12-31"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a url; empty without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def names_above(host: Column) -> Column:
    """The host and every domain above it, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """pattern, since, until of dated entries."""
    day = entries.where("pattern is not null and at is not null").groupBy(F.lower("pattern").alias("pattern"), "at").agg(F.min(F.coalesce(F.col("action") == "add", F.lit(False))).alias("on"))
    w = Window.partitionBy("pattern").orderBy("at")
    turned = day.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where("on <> was")
    spans = turned.withColumn("until", F.coalesce(F.lead("at").over(w), F.lit(FAR).cast("date")))
    return spans.where("on").select("pattern", F.col("at").alias("since"), "until")


#: Columns that ``active_at`` adds.
ADDED = ["host", "blocked", "n_active", "pattern", "since"]


def active_at(captures: DataFrame, intervals: DataFrame, url_col: str = "url", at_col: str = "fetched") -> DataFrame:
    """Captures with ``host``, ``blocked``, ``n_active`` (entries active then) and the longest such pattern with its date."""
    listed = checkpoint(intervals.select(F.col("pattern").alias("p_"), F.col("since").alias("s_"), F.col("until").alias("u_")))
    names = [c for c in captures.columns if c.lower() not in ADDED]
    row = F.struct(*[F.col(f"`{c}`") for c in names] or [F.lit(None).alias("none")])
    # all that the captures bring along stays in one struct, so no name of theirs meets one of ours
    keyed = checkpoint(captures.select(row.alias("row_"), F.monotonically_increasing_id().alias("n_"), host_of(F.col(f"`{url_col}`")).alias("h_"), F.col(f"`{at_col}`").alias("t_")))
    asked = keyed.where("h_ <> '' and t_ is not null").select("n_", "t_", F.explode(names_above(F.col("h_"))).alias("name_"))
    holds = (F.col("t_") >= F.col("s_")) & (F.col("t_") < F.col("u_"))
    if listed.count() <= BROADCAST_ROWS:
        hit = asked.join(F.broadcast(listed), (F.col("name_") == F.col("p_")) & holds)
    else:
        # nearly every capture asks for a name of one label: only those on the list, which are few, are dealt
        tops = listed.where(~F.contains("p_", F.lit("."))).select("p_").distinct()
        top = ~F.contains("name_", F.lit("."))
        one = asked.where(top)
        one = one.join(F.broadcast(tops) if tops.count() <= BROADCAST_ROWS else tops, F.col("name_") == F.col("p_"), "left_semi")
        asked = asked.where(~top).union(one)
        epoch = F.lit("1970-01-01").cast("date")
        latest = asked.agg(F.max(F.col("t_").cast("date"))).first()[0]  # no capture asks for a slot after this one
        last = F.greatest("s_", F.least("u_", F.coalesce(F.lit(latest).cast("date"), "s_")))
        slots = F.sequence(F.floor(F.datediff("s_", epoch) / SLOT_DAYS), F.floor(F.datediff(last, epoch) / SLOT_DAYS))
        left = asked.withColumn("slot_", F.floor(F.datediff("t_", epoch) / SLOT_DAYS))
        right = listed.withColumn("slot_", F.explode(slots))
        hit = left.join(right, (F.col("name_") == F.col("p_")) & (left["slot_"] == right["slot_"]) & holds)
    found = hit.groupBy("n_").agg(F.count("*").alias("k_"), F.max(F.struct(F.length("p_").alias("l"), F.col("p_").alias("p"), F.col("s_").alias("s"))).alias("m_"))
    out = keyed.join(found, "n_", "left")
    return out.select(*[F.col("row_")[c].alias(c) for c in names], F.col("h_").alias("host"), F.col("k_").isNotNull().alias("blocked"), F.coalesce("k_", F.lit(0)).cast("long").alias("n_active"), F.col("m_.p").alias("pattern"), F.col("m_.s").alias("since"))


def op3_temporal_list(spark, sf_dir: str) -> DataFrame:
    """Every page against a list made from the pages' own hosts and domains.

    The tables hold neither fetch dates nor a list: a page's date follows from its id, and a third of the hosts
    and the domains above them are added, removed and added again on dates that follow from their names.
    """
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", day(F.col("page_id") * 7919 % 365).alias("fetched"))
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    names = hosts.select("host").union(hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("host"))).where("host <> ''").distinct()
    h = F.length("host") * 37 + F.ascii("host") * 11 + F.instr("host", ".")
    some = names.select("host", h.alias("h")).where("h % 3 = 0")
    steps = [("add", F.col("h") % 200), ("remove", F.col("h") % 200 + 30 + F.col("h") % 90), ("add", F.col("h") % 200 + 150)]
    entries = None
    for action, n in steps:
        one = some.select(F.col("host").alias("pattern"), day(n).alias("at"), F.lit(action).alias("action"))
        entries = one if entries is None else entries.union(one)
    found = active_at(pages, validity(entries))
    return found.select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "blocked", "n_active", "pattern", F.col("since").cast("string").alias("since"))


OP3_SQL = f"""
WITH pages_ AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host, DATE '2024-01-01' + CAST(page_id * 7919 % 365 AS INTEGER) AS fetched FROM pages),
names AS (SELECT DISTINCT host FROM pages_ WHERE host <> '' UNION SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) FROM pages_ WHERE regexp_extract(host, '([^.]+\\.[^.]+)$', 1) <> ''),
listed AS (SELECT host, CAST(length(host) * 37 + ascii(host) * 11 + instr(host, '.') AS INTEGER) AS h FROM names),
spans AS (
  SELECT host AS pattern, DATE '2024-01-01' + h % 200 AS since, DATE '2024-01-01' + (h % 200 + 30 + h % 90) AS until FROM listed WHERE h % 3 = 0
  UNION ALL SELECT host, DATE '2024-01-01' + (h % 200 + 150), DATE '{FAR}' FROM listed WHERE h % 3 = 0),
hit AS (SELECT page_id, count(*) AS n, max((length(pattern), pattern, since)) AS m
  FROM pages_ JOIN spans ON (host = pattern OR ends_with(host, '.' || pattern)) AND fetched >= since AND fetched < until GROUP BY page_id)
SELECT p.page_id, host, CAST(fetched AS VARCHAR) AS fetched, n IS NOT NULL AS blocked, CAST(coalesce(n, 0) AS BIGINT) AS n_active, m[2] AS pattern, CAST(m[3] AS VARCHAR) AS since
FROM pages_ p LEFT JOIN hit USING (page_id)"""
