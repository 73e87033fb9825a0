"""Named queries over the driver's tables, with their DuckDB equivalents where SQL can say the same.

Bytes come from ``encode(text)`` or are built from keys in a way that both engines can evaluate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata import catalog_formats, catalog_ranges
from strata.functions import bytes as by
from strata.functions import magic, text, types
from strata.operators import claims, routing
from strata.plans import render
from strata.sources import blocks
from strata.streaming import logs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payload(column: str = "text") -> Column:
    return F.encode(F.col(column), "UTF-8")


# --- detection -------------------------------------------------------------------------------------------

_FLAGS = ", ".join(f"coalesce(strlen(text) >= 32 AND regexp_full_match(substring(text, 1, 32), '{c}{{32}}') AND regexp_full_match(substring(text, 1, 32), '{magic.TEXT_CLASSES[0][1]}{{32}}'), false) AS is_{n.lower()}" for n, c in magic.TEXT_CLASSES)


@query(f"SELECT doc_id, {_FLAGS} FROM documents")
def magic_text_flags(spark, d):
    docs = read(spark, d, "documents").withColumn("w", F.substring(payload(), 1, 2048))
    return docs.select("doc_id", *[F.coalesce(magic.text_flag(F.col("w"), n), F.lit(False)).alias(f"is_{n.lower()}") for n, _ in magic.TEXT_CLASSES])


#: offset and hex digits that stand in otherwise meaningless bytes
_TEMPLATES = [(0, t) for _, t in magic.TAGS if len(t) % 2 == 0] + [(0, "000001B3"), (0, "FFE0"), (0, "FFFB")] + [(o, x) for _, o, x in magic.FILE_SYSTEMS] + [(510, "55AA"), (700, "25504446"), (1019, "25504446")]
_SIZE = 1100


def _filler(n) -> str:
    """SQL of ``n`` bytes that are no type and no constant, as hex digits."""
    return f"substr(repeat('F1E2D3C4B5', 300), 1, CAST(2 * ({n}) AS INT))"


def _template_sql(key: str) -> str:
    """Hex digits of ``_SIZE`` bytes: filler, one template at its place, the key at the end."""
    tail = f"lpad(hex({key}), 16, '0')"
    cases = " ".join(f"WHEN {k} THEN concat({_filler(o)}, '{x}', {_filler(_SIZE - 8 - o - len(x) // 2)}, {tail})" for k, (o, x) in enumerate(_TEMPLATES))
    return f"CASE {key} % {len(_TEMPLATES)} {cases} END"


def _types_sql(h: str) -> str:
    """Codes, comma-joined, of a window given as hex digits that is neither text nor constant."""
    code = types.BY_NAME
    parts = [f"CASE WHEN {h}[{2 * o + 1}:{2 * o + len(x)}] = '{x}' THEN '{code[n]}' END" for n, o, x in magic.FILE_SYSTEMS]
    parts += [f"'{code['UNIDENTIFIED']}'"]
    parts += [f"CASE WHEN starts_with({h}, '{x}') THEN '{code[n]}' END" for n, x in magic.TAGS]
    parts += [f"CASE WHEN {h}[1021:1024] = '55AA' THEN '{code['PART']}' END"]
    parts += [f"CASE WHEN len(list_filter(range(0, 1021), lambda i: {h}[2 * i + 1:2 * i + 8] = '25504446')) > 0 THEN '{code['PDF']}' END"]
    return f"concat_ws(',', {', '.join(parts)})"


@query(f"WITH p AS (SELECT p_partkey, {_template_sql('p_partkey')} AS h FROM part) SELECT p_partkey, {_types_sql('h')} AS types FROM p")
def magic_types_by_signature(spark, d):
    built = read(spark, d, "part").select("p_partkey", F.unhex(F.expr(_template_sql("p_partkey"))).alias("w"))
    return built.select("p_partkey", F.array_join(magic.detect(F.col("w")).cast("array<string>"), ",").alias("types"))


@query("SELECT doc_id, (doc_id * 37) % 1500 AS at, (doc_id * 37) % 1500 <= 1020 AS is_pdf FROM documents")
def magic_pdf_within_1k(spark, d):
    at = F.expr("(doc_id * 37) % 1500")
    h = F.concat(F.expr(_filler("(doc_id * 37) % 1500")), F.lit("25504446"), F.expr(_filler("600")))
    docs = read(spark, d, "documents").select("doc_id", at.alias("at"), F.unhex(h).alias("w"))
    return docs.select("doc_id", "at", F.array_contains(magic.detect(F.col("w")), types.BY_NAME["PDF"]).alias("is_pdf"))


_BLOCK = "concat(repeat(lpad(hex(p_partkey), 8, '0'), 127), lpad(hex(CASE WHEN p_partkey % 3 = 0 THEN p_partkey + 1 ELSE p_partkey END), 8, '0'))"


@query(f"WITH p AS (SELECT p_partkey, {_BLOCK} AS h FROM part) SELECT p_partkey, h = repeat(h[1:8], 128) AS is_constant FROM p")
def constant_blocks(spark, d):
    built = read(spark, d, "part").select("p_partkey", F.unhex(F.expr(_BLOCK)).alias("w"))
    return built.select("p_partkey", magic.is_constant(F.col("w")).alias("is_constant"))


_DIM = ", ".join(f"({c}, '{n}', '{h}')" for c, n, h, _ in types.TYPES)


@query(f"WITH dim(code, name, human) AS (VALUES {_DIM}), asked AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN lower(name) ELSE name END AS asked FROM part JOIN dim ON code = p_partkey % 256) SELECT p_partkey, asked, code, human FROM asked JOIN dim ON lower(asked) = lower(name)")
def type_name_lookup(spark, d):
    dim = spark.createDataFrame([(c, n, h) for c, n, h, _ in types.TYPES], "code int, name string, human string")
    asked = read(spark, d, "part").join(F.broadcast(dim), F.col("code") == F.col("p_partkey") % 256).select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.lower("name")).otherwise(F.col("name")).alias("asked"))
    return asked.join(F.broadcast(dim), F.lower("asked") == F.lower("name")).select("p_partkey", "asked", "code", "human")


# --- blocks ----------------------------------------------------------------------------------------------

_HEX_BLOCKS = "b AS (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, (strlen(text) - 1) // 512 + 1)) AS block FROM documents WHERE strlen(text) > 0)"


@query(f"WITH {_HEX_BLOCKS} SELECT doc_id, block, md5(h[block * 1024 + 1:block * 1024 + 1024]) AS digest FROM b")
def block_scan(spark, d):
    docs = read(spark, d, "documents").select("doc_id", payload().alias("data"))
    return blocks.column_blocks(docs, "doc_id", "data").select("doc_id", "block", F.md5(F.hex("data").cast("binary")).alias("digest"))


@query(f"WITH {_HEX_BLOCKS} SELECT doc_id, block, CAST(least(len(h) // 2 - block * 512, 2048) AS INTEGER) AS window_len, md5(h[block * 1024 + 1:block * 1024 + 4096]) AS digest FROM b WHERE block >= 1")
def block_window_lookahead(spark, d):
    docs = read(spark, d, "documents").select("doc_id", payload().alias("data"))
    return blocks.column_blocks(docs, "doc_id", "data", start=1).select("doc_id", "block", "window_len", F.md5(F.hex("window").cast("binary")).alias("digest"))


@query("WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM a) SELECT user_id, min(event_id) AS first_event, any_value(event_type) AS event_type, count(*) AS n FROM b GROUP BY user_id, run")
def constant_runs(spark, d):
    events = read(spark, d, "events").withColumn("first_event", F.col("event_id"))
    found = claims.runs(events.select("user_id", F.struct("ts", "event_id").alias("at"), "event_type"), "user_id", ["at"], "event_type")
    return found.select("user_id", F.col("start.event_id").alias("first_event"), "event_type", "n")


# first_event above is that of the earliest row; DuckDB's min(event_id) equals it only if ids grow with time
ORACLE_SQL["constant_runs"] = ORACLE_SQL["constant_runs"].replace("min(event_id) AS first_event", "arg_min(event_id, (ts, event_id)) AS first_event")

_CLAIMS = "SELECT l_suppkey, CAST(l_partkey * 3 % 5000 AS BIGINT) AS pos, CAST(l_linenumber AS BIGINT) AS len FROM lineitem"


def _claims(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") * 3 % 5000).alias("pos"), F.col("l_linenumber").cast("long").alias("len"))


@query(f"WITH c AS ({_CLAIMS}), a AS (SELECT *, max(pos + len) OVER (PARTITION BY l_suppkey ORDER BY pos, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM c), b AS (SELECT *, sum(CASE WHEN pos <= e THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey ORDER BY pos, len ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT l_suppkey, min(pos) AS pos, max(pos + len) - min(pos) AS len FROM b GROUP BY l_suppkey, g")
def merge_claims(spark, d):
    return claims.merge_claims(_claims(spark, d), "l_suppkey")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey * 100 AS off, CAST(l_quantity * 40 AS BIGINT) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, (off + 511) // 512 AS first_block, CASE WHEN (off + n - 1) // 512 >= (off + 511) // 512 THEN (off + n - 1) // 512 END AS last_block, CASE WHEN l_linenumber <> 3 THEN off // 512 END AS pos, CASE WHEN l_linenumber <> 3 THEN (n + 511) // 512 END AS len FROM r")
def claims_from_bytes(spark, d):
    r = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 100).alias("off"), (F.col("l_quantity") * 40).cast("long").alias("n"))
    r = r.select("*", claims.claim_of_bytes(F.col("off"), F.col("n")).alias("b"), claims.claim_of_length(F.col("off"), F.col("n"), F.col("l_linenumber") != 3).alias("c"))
    return r.select("l_orderkey", "l_linenumber", F.expr("(off + 511) div 512").alias("first_block"), F.col("b.last").alias("last_block"), "c.pos", "c.len")


_BLOCKS = "SELECT DISTINCT l_suppkey, CAST(l_orderkey * 7 % 5000 AS BIGINT) AS block FROM lineitem"


def _blocks(spark, d) -> DataFrame:
    return read(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 7 % 5000).alias("block")).distinct()


@query(f"WITH c AS ({_CLAIMS}), b AS ({_BLOCKS}) SELECT l_suppkey, block FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.l_suppkey = b.l_suppkey AND block >= pos AND block < pos + len)")
def claim_block_membership(spark, d):
    return claims.blocks_outside(_blocks(spark, d), _claims(spark, d), "l_suppkey", bin_size=64)


@query(f"WITH c AS ({_CLAIMS}), b AS ({_BLOCKS}) SELECT b.l_suppkey, block, count(*) AS n_claims, min(pos) AS first_pos FROM b JOIN c ON c.l_suppkey = b.l_suppkey AND block >= pos AND block < pos + len GROUP BY b.l_suppkey, block")
def claim_block_join_bucketed(spark, d):
    found = claims.blocks_inside(_blocks(spark, d), _claims(spark, d), "l_suppkey", bin_size=64)
    return found.groupBy("l_suppkey", "block").agg(F.count("*").alias("n_claims"), F.min("pos").alias("first_pos"))


@query(f"WITH c AS ({_CLAIMS}), e AS (SELECT l_suppkey, pos, unnest(range(pos, pos + len)) AS block FROM c) SELECT l_suppkey, block, max(pos) AS owner FROM e WHERE block <> pos GROUP BY l_suppkey, block")
def continuation_rows(spark, d):
    found = claims.continuations(_claims(spark, d)).where("block <> pos")
    return found.groupBy("l_suppkey", "block").agg(F.max("pos").alias("owner"))


_ORDERED = "SELECT l_suppkey, CAST(l_partkey * 3 % 5000 AS BIGINT) AS pos, CAST(l_linenumber AS BIGINT) AS len, l_orderkey * 10 + l_linenumber AS writer FROM lineitem"


@query(f"WITH c AS ({_ORDERED}), e AS (SELECT l_suppkey, writer, unnest(range(pos, pos + len)) AS block FROM c) SELECT l_suppkey, block, min(writer) AS writer FROM e GROUP BY l_suppkey, block")
def first_writer_owner(spark, d):
    rows = read(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") * 3 % 5000).alias("pos"), F.col("l_linenumber").cast("long").alias("len"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("writer"))
    return claims.first_writer(rows, "l_suppkey", "writer", "writer")


@query("WITH RECURSIVE c AS (SELECT o_custkey, o_orderkey % 1000 AS block, max(o_orderkey % 1000 + 1 + o_orderkey % 97) AS claim_end FROM orders GROUP BY 1, 2), k AS (SELECT o_custkey, min(block) AS block FROM c GROUP BY 1 UNION ALL SELECT x.o_custkey, (SELECT min(n.block) FROM c n WHERE n.o_custkey = x.o_custkey AND n.block >= x.claim_end) FROM (SELECT k.o_custkey, c.claim_end FROM k JOIN c ON c.o_custkey = k.o_custkey AND c.block = k.block) x WHERE EXISTS (SELECT 1 FROM c n WHERE n.o_custkey = x.o_custkey AND n.block >= x.claim_end)) SELECT o_custkey, block FROM k")
def accept_sweep(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 1000).alias("block"), (F.col("o_orderkey") % 1000 + 1 + F.col("o_orderkey") % 97).alias("claim_end"))
    rows = rows.groupBy("o_custkey", "block").agg(F.max("claim_end").alias("claim_end")).withColumn("constant", F.lit(False))
    return claims.accept_sweep(rows, "o_custkey").select("o_custkey", "block")


# --- routing and arbitration -----------------------------------------------------------------------------

_REG = ", ".join(f"('{c}', {code}, {types.PRECEDENCE.index(c) if c in types.PRECEDENCE else types.LAST})" for code, _, _, c in types.TYPES if c)
_CODES = [code for code, *_ in types.TYPES]
_ITEMS_SQL = f"items AS (SELECT p_partkey, list_extract({_CODES}, CAST(p_partkey % {len(_CODES)} + 1 AS BIGINT)) AS t1, list_extract({_CODES}, CAST(p_partkey * 7 % {len(_CODES)} + 1 AS BIGINT)) AS t2 FROM part), reg(classifier, code, precedence) AS (VALUES {_REG}), pairs AS (SELECT p_partkey, t1 AS t FROM items UNION SELECT p_partkey, t2 FROM items)"


def _items(spark, d) -> DataFrame:
    codes = F.array(*[F.lit(c) for c in _CODES])
    at = lambda k: F.get(codes, (F.col("p_partkey") * k % len(_CODES)).cast("int"))
    return read(spark, d, "part").select("p_partkey", F.array_distinct(F.array(at(1), at(7))).alias("types"))


@query(f"WITH {_ITEMS_SQL}, r AS (SELECT p_partkey, classifier, min(precedence) AS precedence FROM pairs JOIN reg ON code = t GROUP BY 1, 2) SELECT p_partkey, classifier, CAST(precedence AS INTEGER) AS precedence, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY precedence, classifier) AS INTEGER) AS rank FROM r")
def registry_route(spark, d):
    return routing.route(_items(spark, d), types.registry(spark), "p_partkey")


@query(f"WITH {_ITEMS_SQL} SELECT p_partkey, CAST(t AS INTEGER) AS type_code, -1 AS confidence FROM pairs WHERE t NOT IN (SELECT code FROM reg)")
def unsupported_types(spark, d):
    return routing.unsupported(_items(spark, d), types.registry(spark), "p_partkey")


_VERDICTS = "v AS (SELECT l_orderkey, CASE l_suppkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'text' WHEN 2 THEN 'pdf' ELSE 'zlib' END AS classifier, CAST(l_partkey % 101 AS INTEGER) AS confidence, l_linenumber AS ord, CASE l_suppkey % 4 WHEN 3 THEN 20 ELSE 50 END AS threshold FROM lineitem)"


def _verdicts(spark, d) -> DataFrame:
    """One verdict per line item; thresholds come from a table of classifiers with the general one as default."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("image", "text", "pdf", "zlib")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
    own = spark.createDataFrame([("zlib", 20)], "classifier string, own int")
    rows = read(spark, d, "lineitem").select("l_orderkey", kind.alias("classifier"), (F.col("l_partkey") % 101).cast("int").alias("confidence"), F.col("l_linenumber").alias("ord"))
    return routing.with_thresholds(rows, own, types.THRESHOLD)


@query(f"WITH {_VERDICTS} SELECT l_orderkey, classifier, confidence, ord, threshold FROM v WHERE confidence >= threshold")
def threshold_filter(spark, d):
    return routing.satisfied(_verdicts(spark, d)).select("l_orderkey", "classifier", "confidence", "ord", "threshold")


_BEST = f"{_VERDICTS}, best AS (SELECT l_orderkey, classifier, max((confidence, ord)) AS m FROM v WHERE confidence >= threshold GROUP BY 1, 2)"


@query(f"WITH {_BEST} SELECT l_orderkey, classifier, m[1] AS confidence, m[2] AS ord FROM best")
def best_verdict_ties_latest(spark, d):
    return routing.best_verdicts(_verdicts(spark, d), "l_orderkey")


@query(f"WITH {_BEST}, o AS (SELECT l_orderkey, min((list_position({types.PRECEDENCE + ['zlib']}, classifier), classifier, m[1])) AS f FROM best GROUP BY 1) SELECT l_orderkey, f[2] AS classifier, f[3] AS confidence FROM o")
def first_satisfied_classifier(spark, d):
    return routing.first_satisfied(routing.best_verdicts(_verdicts(spark, d), "l_orderkey"), types.registry(spark), "l_orderkey")


@query(f"WITH {_VERDICTS}, t AS (SELECT l_orderkey, classifier || ':' || lpad(CAST(confidence AS VARCHAR), 3, '0') AS s FROM v) SELECT l_orderkey, string_agg(s, ' ' ORDER BY s) AS verdicts FROM t GROUP BY 1")
def collect_all_verdicts(spark, d):
    return routing.collect_all(_verdicts(spark, d), "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber % 2 = 0")
def report_to_item(spark, d):
    reports = read(spark, d, "lineitem").where("l_linenumber % 2 = 0").select("l_orderkey", "l_linenumber")
    items = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return routing.reports_to_items(reports, items, "l_orderkey").select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')")
def orphan_reports(spark, d):
    wanted = read(spark, d, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return routing.orphan_reports(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), wanted, "l_orderkey")


# --- text ------------------------------------------------------------------------------------------------

_PREFIX = "regexp_extract(text, '^[\\x20-\\x7E\\t\\n\\f\\r]*')"


@query(f"SELECT doc_id, CAST(length({_PREFIX}) AS INTEGER) AS n, md5({_PREFIX}) AS digest FROM documents")
def printable_prefix(spark, d):
    p = text.printable_prefix(payload())
    return read(spark, d, "documents").select("doc_id", F.length(p).alias("n"), F.md5(p.cast("binary")).alias("digest"))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _count_sql(t: str, p: str) -> str:
    return f"len(regexp_extract_all({t}, {_q(p)}))"


def _xml_sql(t: str) -> str:
    start = _count_sql(t, text.TAG_START)
    return f"least(100, CASE WHEN {start} > 3 THEN 40 ELSE {start} * 10 END + ({_count_sql(t, text.TAG_END)} + {_count_sql(t, text.TAG_SELF)}) * 10)"


def _html_sql(t: str) -> str:
    return "((" + " + ".join(f"CASE WHEN regexp_matches({t}, '<{x}.*>') THEN 1 ELSE 0 END" for x in text.HTML_TAGS) + ") * 100 // 8)"


def _csv_look_sql(t: str, d: str, n: int) -> str:
    c = f"list_transform(list_filter(list_slice(string_split({t}, chr(10)), 1, {n}), lambda x: length(x) > 2), lambda x: length(x) - length(replace(x, {d}, '')))"
    m, s, q = (f"list_aggregate({c}, '{f}')" for f in ("avg", "stddev_samp", "median"))
    return f"CASE WHEN len({c}) < 2 OR {m} = 0 THEN 0.0 WHEN {s} / {m} > 1 OR {q} < 1 THEN 0.0 ELSE (1 - {s} / {m}) * 100 END"


def _csv_sql(t: str, d: str) -> str:
    d = {"\t": "chr(9)"}.get(d, f"'{d}'")
    (a, low), (b, high) = text.CSV_LOOKS
    return f"CASE WHEN {_csv_look_sql(t, d, a)} >= {low} AND {_csv_look_sql(t, d, b)} >= {high} THEN {_csv_look_sql(t, d, b)} ELSE 0.0 END"


def _log_sql(t: str) -> str:
    breaks = _count_sql(t, text.BREAKS)
    each = [f"CASE WHEN regexp_matches(substring({t}, 1, 1024), {_q(p)}) AND {breaks} > 0 THEN least(100, {_count_sql(t, p)} * 100 // {breaks}) ELSE 0 END" for p in text.LOGS]
    return f"greatest({', '.join(each)})"


def _base64_sql(t: str) -> str:
    joined = f"regexp_replace({t}, '[\\r\\n]', '', 'g')"
    return f"CASE WHEN NOT regexp_full_match({t}, {_q(text.BASE64.strip('^$'))}) THEN 0 WHEN regexp_full_match({joined}, {_q(text.BASE64_WHOLE.strip('^$'))}) AND length({joined}) % 4 = 0 THEN 100 ELSE 60 END"


def _verdict_sql(t: str) -> tuple[str, str]:
    """SQL of brief and confidence of a prefix."""
    full = lambda p: f"regexp_full_match({t}, {_q(p.removeprefix('^').removesuffix('$'))})"
    steps = [(f"length({t}) < 32", "NULL", "NULL"), (full(text.BLANK), "'WHITESPACE'", "100"), ("xml >= 50 AND html >= 50", "'HTML'", "html"), ("xml >= 50", "'XML'", "xml"), (full(text.HEX), "'HEX'", "100"), ("b64 > 0", "'BASE64'", "b64"), (full(text.BASE85), "'BASE85'", "100")]
    steps += [(f"csv{i} > 0", "'CSV'", f"floor(csv{i})") for i in range(4)] + [("log >= 50", "'LOG'", "log")]
    brief = "CASE " + " ".join(f"WHEN {c} THEN {b}" for c, b, _ in steps) + " ELSE 'TEXT' END"
    conf = "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, _, x in steps) + " ELSE 100 END"
    return brief, f"CAST({conf} AS INTEGER)"


def _cascade_sql(source: str, key: str) -> str:
    """CTE ``v``: key, brief, confidence of the column ``t`` of the CTE ``source``."""
    csv = ", ".join(f"{_csv_sql('t', x)} AS csv{i}" for i, x in enumerate(text.CSV_DELIMITERS))
    brief, conf = _verdict_sql("t")
    return f"m AS (SELECT {key}, t, {_xml_sql('t')} AS xml, {_html_sql('t')} AS html, {_base64_sql('t')} AS b64, {_log_sql('t')} AS log, {csv} FROM {source}), v AS (SELECT {key}, {brief} AS brief, {conf} AS confidence FROM m)"


#: A document's own prefix, or one of several shapes made from keys, so that every branch of the cascade is met.
_SHAPES = [
    ("repeat(' ', 40)", "repeat(' ', 40)"),
    ("concat('<a><b>', n, '</b><c>y</c><d>z w v</d></a> more words here')",) * 2,
    ("concat('<html><head><title>', n, '</title></head><body><div><p><span>w</span></p></div></body></html>')",) * 2,
    ("repeat(lpad(hex(doc_id), 8, '0'), 8)",) * 2,
    ("repeat('QUJDRg+z', 8)",) * 2,
    ("repeat(concat('x,y,z', n, chr(10)), 12)",) * 2,
    ("repeat(concat('2024-01-01 00:00:01 why ', repeat('w ', 1 + CAST(doc_id % 5 AS INT)), n, chr(10)), 12)",) * 2,
]


def _shape_case() -> str:
    cases = " ".join(f"WHEN {k} THEN {s[0]}" for k, s in enumerate(_SHAPES))
    return f"CASE doc_id % {2 * len(_SHAPES)} {cases} ELSE text END"


_SHAPED = f"n_ AS (SELECT doc_id, text, CAST(doc_id AS VARCHAR) AS n FROM documents), p AS (SELECT doc_id, regexp_extract({_shape_case()}, '^[\\x20-\\x7E\\t\\n\\f\\r]*') AS t FROM n_)"


def _shaped(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("n", F.col("doc_id").cast("string"))
    return docs.select("doc_id", text.printable_prefix(F.encode(F.expr(_shape_case()), "UTF-8")).alias("t"))


@query(f"WITH {_SHAPED}, {_cascade_sql('p', 'doc_id')} SELECT doc_id, brief, confidence FROM v")
def text_verdict(spark, d):
    return _shaped(spark, d).select("doc_id", text.verdict(F.col("t")).alias("v")).select("doc_id", "v.brief", "v.confidence")


_DOC_TYPES = f"WITH p AS (SELECT doc_id, {_PREFIX} AS t FROM documents), {_cascade_sql('p', 'doc_id')} SELECT coalesce(brief, 'UNIDENTIFIED') AS brief, count(*) AS n, sum(coalesce(confidence, 0)) AS confidence FROM v GROUP BY 1"


@query(_DOC_TYPES.replace("sum(coalesce(confidence, 0))", "CAST(sum(coalesce(confidence, 0)) AS BIGINT)"))
def document_types(spark, d):
    found = read(spark, d, "documents").select(text.verdict(text.printable_prefix(payload())).alias("v"))
    return found.groupBy(F.coalesce("v.brief", F.lit("UNIDENTIFIED")).alias("brief")).agg(F.count("*").alias("n"), F.sum(F.coalesce("v.confidence", F.lit(0))).alias("confidence"))


@query(f"SELECT page_id, CAST({_xml_sql('html')} AS INTEGER) AS xml, CAST({_html_sql('html')} AS INTEGER) AS html FROM pages")
def xml_html_confidence(spark, d):
    h = F.col("html")
    return read(spark, d, "pages").select("page_id", text.xml_confidence(h).alias("xml"), text.html_confidence(h).alias("html"))


_CSV_ROWS = "r AS (SELECT c_custkey // 20 AS g, c_custkey, concat(c_mktsegment, ',', c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN ',x' ELSE '' END, '|', c_name) AS line FROM customer), t AS (SELECT g, string_agg(line, chr(10) ORDER BY c_custkey) AS t FROM r GROUP BY g)"


@query(f"WITH {_CSV_ROWS} SELECT g, " + ", ".join(f"round({_csv_sql('t', x)}, 6) AS {n}" for n, x in (("comma", ","), ("bar", "|"), ("space", " "))) + " FROM t")
def csv_confidence(spark, d):
    line = F.expr("concat(c_mktsegment, ',', c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN ',x' ELSE '' END, '|', c_name)")
    rows = read(spark, d, "customer").select(F.expr("c_custkey div 20").alias("g"), "c_custkey", line.alias("line"))
    t = rows.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return t.select("g", *[F.round(text.csv_confidence(F.col("t"), x), 6).alias(n) for n, x in (("comma", ","), ("bar", "|"), ("space", " "))])


_LOG_ROWS = "r AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), ' ', event_type) WHEN 1 THEN concat('[ ', event_id, '.5] kernel ', event_type) ELSE concat('Jan 12 10:11:12 host ', event_type) END AS line FROM events), t AS (SELECT user_id, string_agg(line, chr(10) ORDER BY event_id) AS t FROM r GROUP BY 1)"


@query(f"WITH {_LOG_ROWS} SELECT user_id, CAST({_log_sql('t')} AS INTEGER) AS confidence FROM t")
def log_confidence(spark, d):
    line = F.expr("CASE event_id % 3 WHEN 0 THEN concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), ' ', event_type) WHEN 1 THEN concat('[ ', event_id, '.5] kernel ', event_type) ELSE concat('Jan 12 10:11:12 host ', event_type) END")
    rows = read(spark, d, "events").select("user_id", "event_id", line.alias("line"))
    t = rows.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "line"))), lambda x: x["line"]), "\n").alias("t"))
    return t.select("user_id", text.log_confidence(F.col("t")).alias("confidence"))


@query("SELECT doc_id, md5(text) AS digest, true AS base64_equal, true AS hex_equal FROM documents")
def hex_base64_decode(spark, d):
    docs = read(spark, d, "documents").select("doc_id", payload().alias("p"))
    made = docs.select("doc_id", "p", by.base64_decode(F.base64("p")).alias("b"), by.hex_decode(F.concat(F.regexp_replace(F.hex("p"), "(.{64})", "$1\n"), F.lit("\nF"))).alias("h"))
    return made.select("doc_id", F.md5("b").alias("digest"), (F.col("b") == F.col("p")).alias("base64_equal"), (F.col("h") == F.col("p")).alias("hex_equal"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def payload_md5(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(payload()).alias("digest"))


# --- boot records, containers ----------------------------------------------------------------------------

_MBR = "concat(repeat('00', 446), " + ", ".join(f"CASE WHEN s_suppkey % 5 >= {i} THEN concat(CASE WHEN s_suppkey % 2 = {i % 2} THEN '80' ELSE '00' END, '010100', lpad(hex(s_suppkey * {i + 1} % 256), 2, '0'), 'FEFFFF', lpad(hex(s_suppkey % 256), 2, '0'), '{i:02X}0000', lpad(hex(s_nationkey + {i + 1}), 2, '0'), '000100') ELSE repeat('00', 16) END" for i in range(4)) + ", '55AA')"


@query(f"WITH s AS (SELECT s_suppkey, {_MBR} AS h FROM supplier), e AS (SELECT s_suppkey, CAST(unnest(range(0, 4)) AS INTEGER) AS entry, h FROM s), x AS (SELECT s_suppkey, entry, h[893 + entry * 32:924 + entry * 32] AS r FROM e) SELECT s_suppkey, entry, CAST('0x' || r[1:2] AS BIGINT) AS boot, CAST('0x' || r[9:10] AS BIGINT) AS type, CAST('0x' || r[17:18] AS BIGINT) + 256 * CAST('0x' || r[19:20] AS BIGINT) + 65536 * CAST('0x' || r[21:22] AS BIGINT) + 16777216 * CAST('0x' || r[23:24] AS BIGINT) AS first_sector, CAST('0x' || r[25:26] AS BIGINT) + 256 * CAST('0x' || r[27:28] AS BIGINT) + 65536 * CAST('0x' || r[29:30] AS BIGINT) + 16777216 * CAST('0x' || r[31:32] AS BIGINT) AS sectors, CAST('0x' || r[1:2] AS BIGINT) IN (0, 128) AS valid_boot FROM x WHERE r <> repeat('0', 32)")
def mbr_entries(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.unhex(F.expr(_MBR)).alias("data"))
    e = s.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("entry"), "data")
    e = e.select("s_suppkey", "entry", F.substring(F.col("data"), F.col("entry") * 16 + 447, F.lit(16)).alias("r")).where(F.hex("r") != "0" * 32)
    r = F.col("r")
    return e.select("s_suppkey", "entry", by.le_uint(r, 0, 1).alias("boot"), by.le_uint(r, 4, 1).alias("type"), by.le_uint(r, 8, 4).alias("first_sector"), by.le_uint(r, 12, 4).alias("sectors"), by.le_uint(r, 0, 1).isin(0, 128).alias("valid_boot"))


_MEMBERS = ["[Content_Types].xml", "_rels/.rels", "word/document.xml", "xl/workbook.xml", "ppt/presentation.xml", "a.txt"]


@query(f"WITH m AS (SELECT p_partkey, list_filter({_MEMBERS}, lambda x, i: (p_partkey // (1 << CAST(i - 1 AS INT))) % 2 = 1) AS names FROM part) SELECT p_partkey, CASE WHEN list_contains(names, '[Content_Types].xml') AND list_contains(names, '_rels/.rels') THEN concat_ws('/', CASE WHEN list_contains(names, 'word/document.xml') THEN 'DOCX' END, CASE WHEN list_contains(names, 'xl/workbook.xml') THEN 'XLSX' END, CASE WHEN list_contains(names, 'ppt/presentation.xml') THEN 'PPTX' END) ELSE '' END AS kinds FROM m")
def office_container(spark, d):
    names = F.filter(F.array(*[F.when(F.expr(f"(p_partkey div {1 << i}) % 2 = 1"), n) for i, n in enumerate(_MEMBERS)]), lambda x: x.isNotNull())
    have = lambda n: F.array_contains("names", n)
    kinds = F.concat_ws("/", *[F.when(have(m), k) for m, k in (("word/document.xml", "DOCX"), ("xl/workbook.xml", "XLSX"), ("ppt/presentation.xml", "PPTX"))])
    return read(spark, d, "part").select("p_partkey", names.alias("names")).select("p_partkey", F.when(have("[Content_Types].xml") & have("_rels/.rels"), kinds).otherwise("").alias("kinds"))


# --- paths and rendering ---------------------------------------------------------------------------------

_PATH = "concat('/src/', l_orderkey, CASE WHEN l_linenumber > 1 THEN concat(':mnt-zip/', l_suppkey) ELSE '' END, CASE WHEN l_linenumber > 3 THEN concat(':mnt-pdf/', l_partkey) ELSE '' END)"


@query(f"WITH p AS (SELECT l_orderkey, l_linenumber, {_PATH} AS path FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(len(string_split(path, ':mnt')) - 1 AS INTEGER) AS depth, string_split(path, '/')[-1] AS name, concat_ws(',', CAST(l_orderkey AS VARCHAR), nullif(regexp_extract(path, ':mnt-zip/([0-9]+)', 1), ''), nullif(regexp_extract(path, ':mnt-pdf/([0-9]+)', 1), '')) AS streams FROM p")
def path_parse(spark, d):
    p = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_PATH).alias("path"))
    return p.select("l_orderkey", "l_linenumber", by.path_depth(F.col("path")).alias("depth"), by.basename(F.col("path")).alias("name"), F.array_join(by.path_streams(F.col("path")), ",").alias("streams"))


@query("WITH k AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'TEXT' WHEN 'N' THEN 'ZLIB' ELSE 'JPG' END AS brief, min(l_linenumber) AS o FROM lineitem WHERE l_partkey % 3 > 0 GROUP BY 1, 2), s AS (SELECT l_orderkey, concat('-(', string_agg(brief, ' ' ORDER BY o, brief), ')') AS s FROM k GROUP BY 1) SELECT CAST(o_orderkey AS VARCHAR) AS node, concat('PDF', coalesce(s, '')) AS shown FROM orders LEFT JOIN s ON l_orderkey = o_orderkey")
def sibling_collapse(spark, d):
    root = read(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit(0).alias("ord"), F.lit("PDF").alias("brief"), F.lit(100).alias("confidence"))
    brief = F.when(F.col("l_returnflag") == "A", "TEXT").when(F.col("l_returnflag") == "N", "ZLIB").otherwise("JPG")
    kids = read(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("node"), F.col("l_orderkey").cast("string").alias("parent"), F.lit(1).alias("depth"), F.col("l_linenumber").alias("ord"), brief.alias("brief"), (F.col("l_partkey") % 3).cast("int").alias("confidence"))
    return render.nested_text(root.unionByName(kids), 1)


@query(f"WITH p AS (SELECT doc_id, {_PREFIX} AS t, strlen(text) AS n FROM documents WHERE strlen(text) > 0), {_cascade_sql('p', 'doc_id')}, b AS (SELECT doc_id, unnest(range(0, (n - 1) // 512 + 1)) AS block FROM p), j AS (SELECT doc_id, block, coalesce(brief, 'Unidentified') AS brief, length(t) AS len FROM b JOIN v USING (doc_id) JOIN p USING (doc_id)) SELECT doc_id, block * 512 AS \"offset\", CASE WHEN block = 0 OR brief = 'Unidentified' OR block * 512 >= len THEN format('{{:13d}} {{:<12s}} # {{}} Path:/src/{{}}', block * 512, CASE WHEN block > 0 AND block * 512 >= len THEN 'Unidentified' ELSE brief END, CASE WHEN block > 0 OR brief = 'Unidentified' THEN '' ELSE concat('text of length: ', len, ' bytes.') END, doc_id) ELSE format('{{:13d}} {{:<12s}} # Continuation of data starting at block {{}}', block * 512, brief, 0) END AS line FROM j")
def dfrws_lines(spark, d):
    docs = read(spark, d, "documents").select("doc_id", payload().alias("data"))
    seen = docs.select("doc_id", text.printable_prefix(F.col("data")).alias("t")).select("doc_id", F.length("t").cast("long").alias("len"), text.verdict(F.col("t")).alias("v"))
    cut = blocks.column_blocks(docs, "doc_id", "data").select("doc_id", "block").join(seen, "doc_id")
    first, found = F.col("block") == 0, F.col("v.brief").isNotNull()
    claimed = found & (first | (F.col("block") * 512 < F.col("len")))
    rows = cut.select(
        "doc_id", (F.col("block") * 512).alias("offset"), F.when(claimed, F.col("v.brief")).otherwise("Unidentified").alias("brief"),
        F.when(first & found, F.concat(F.lit("text of length: "), F.col("len").cast("string"), F.lit(" bytes."))).alias("description"),
        F.concat(F.lit("/src/"), F.col("doc_id").cast("string")).alias("path"), F.when(claimed & ~first, F.lit(0).cast("long")).alias("owner_offset"),
    )
    keyed = rows.withColumn("line", render.block_lines_column())
    return keyed.select("doc_id", "offset", "line")


@query(f"WITH p AS (SELECT doc_id, {_PREFIX} AS t FROM documents), {_cascade_sql('p', 'doc_id')} SELECT concat('/src/', doc_id) AS path, format('{{}} {{}} # text of length: {{}} bytes. Path:/src/{{}}', CASE WHEN doc_id % 2 = 0 THEN doc_id * 512 ELSE -1 END, brief, length(t), doc_id) AS line FROM v JOIN p USING (doc_id) WHERE confidence > 0")
def path_lines(spark, d):
    seen = read(spark, d, "documents").select("doc_id", text.printable_prefix(payload()).alias("t")).select("doc_id", "t", text.verdict(F.col("t")).alias("v"))
    items = seen.select(F.concat(F.lit("/src/"), F.col("doc_id").cast("string")).alias("path"), "v.brief", "v.confidence", F.concat(F.lit("text of length: "), F.length("t").cast("string"), F.lit(" bytes.")).alias("description"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 512).alias("abs_off"))
    return render.path_lines(items)


@query("WITH s AS (SELECT event_id, ts, user_id, event_type, CAST(1 + event_id % 5 AS INTEGER) AS severity FROM events) SELECT event_id, severity, CASE severity WHEN 5 THEN 'severe' ELSE 'general' END AS sink FROM s WHERE severity >= 2")
def severity_route(spark, d):
    records = read(spark, d, "events").select("event_id", (F.col("event_id") % 5 + 1).cast("int").alias("severity"))
    return logs.route(records, least=2).select("event_id", "severity", "sink")


for part in (catalog_formats, catalog_ranges):
    QUERIES.update(part.QUERIES)
    ORACLE_SQL.update(part.ORACLE_SQL)
