"""Exact duplicates by stateful streaming: disk-backed keyed state without expiry, full bytes checked on hits.

A stream reads the files of a table as they come. Its state, kept in RocksDB on the executors' disks with its log in
the shared folder, has one entry per digest of the normalised text: how many rows came, and of the row that stays its
stable identifier and the locator of its content (file and row number in it). Nothing expires, so a copy is known
however much later it comes, and a stream that is started again on the same folder reads new files only. Rows are
summed per task before they are shuffled, without their texts, so a text with any number of copies costs one row a task.

``resolve`` gives every row its group. The hits (digests that several rows have) are checked on their full bytes: of a
digest the least and the greatest normalised text are equal only if all are; this sum too is begun in each task before
anything is shuffled. Rows of a digest that stands for several texts are grouped by the text itself.

The row with the most code points in the original text stays, of these the one of least id (null last), of these the
first by file and row. Digests that hold more than one row in ``HOT_SHARE`` are joined by broadcast: there are fewer than ``HOT_SHARE``.

Cases: null, empty and white-space texts are equal and form one group; texts of any length are read whole; rows that
repeat an id are rows of their own, one of a group stays; null ids are kept and stay only where no other row of the
group is as long; an empty table gives an empty result; extra columns are ignored, whatever their names. The
table's files must not change while the state is in use (new ones may be added).
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import remove, shared_path

#: Characters that do not count (fixed values: space and 9 to 13).
OFTEN, SELDOM = " \n", "\t\x0b\x0c\r"
#: At most so many digests can each hold more than this share of all rows; they are broadcast.
HOT_SHARE = 50_000
#: Digests with hits are broadcast up to this many (some 100 bytes each); beyond it all texts are summed.
BROADCAST_ROWS = 250_000
#: Bytes of new files that one micro-batch takes.
TRIGGER_BYTES = 256 << 30
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each part of the state sets 4 MB of disk aside
    "spark.sql.streaming.stateStore.maintenanceInterval": "10s",  # parts that no stream uses any more are let go of
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Session options for what is run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """The text without white space; null is empty. The four rare characters are looked for only where one is there."""
    out = text = F.coalesce(text, F.lit(""))
    for c in OFTEN:
        out = F.replace(out, F.lit(c), F.lit(""))
    every = out
    for c in SELDOM:
        every = F.replace(every, F.lit(c), F.lit(""))
    return F.when(text.rlike(f"[{SELDOM}]"), every).otherwise(out)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _seen(df: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    """id, points, file, row, digest, body of each row of a table in files."""
    text = F.col(f"`{text_col}`")
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"), F.length(F.coalesce(text, F.lit(""))).alias("points"), normalised(text).alias("body"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    return rows.withColumn("digest", digest(F.col("body")))


def _best() -> Column:
    return F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("no_id"), "id", "file", "row"))


def ingest(spark: SparkSession, source: str, at: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_trigger: int | None = None) -> None:
    """Takes the files of ``source`` that the state under ``at`` has not seen into it, in micro-batches, and ends.

    A run that was broken off goes on from its last whole micro-batch: the state of a batch counts once it is committed.
    """
    schema = spark.read.parquet(source).schema
    bound = {"maxFilesPerTrigger": files_per_trigger} if files_per_trigger else {"maxBytesPerTrigger": TRIGGER_BYTES}
    # as a pattern: a table may be a folder or one file, of which the stream's reader takes only the former by name
    rows = spark.readStream.schema(schema).options(**bound).parquet(f"{source[:-1]}[{source[-1]}]")
    state = _seen(rows, id_col, text_col, digest).groupBy("digest").agg(F.count("*").alias("n"), _best().alias("best"))
    with settings(spark, STATE):
        stream = state.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{at}/stream").trigger(availableNow=True).start()
        stream.awaitTermination()


def held(spark: SparkSession, at: str) -> DataFrame:
    """digest, n, keep_id, keep_file, keep_row: the state as it is."""
    state = spark.read.format("statestore").load(f"{at}/stream")
    names = dict(zip(("n", "best"), state.schema["value"].dataType.names, strict=True))
    key = state.schema["key"].dataType.names[0]
    value = F.col("value")
    best = value[names["best"]]
    return state.select(F.col("key")[key].alias("digest"), value[names["n"]].alias("n"), best["id"].alias("keep_id"), best["file"].alias("keep_file"), best["row"].alias("keep_row"))


def mixed_digests(rows: DataFrame) -> DataFrame:
    """Digests that stand for texts which differ in some byte, among rows (digest, body)."""
    sums = rows.groupBy("digest").agg(F.min("body").alias("least"), F.max("body").alias("greatest"))
    return sums.where("least != greatest").select("digest")


def resolve(spark: SparkSession, source: str, at: str, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """id, keep_id, group_size, kept, digest of every row; written under ``at``."""
    held(spark, at).write.mode("overwrite").parquet(f"{at}/held")
    state = spark.read.parquet(f"{at}/held")
    n, multi = state.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 1)).first()
    texts = _seen(spark.read.parquet(source), id_col, text_col, digest)
    few = multi <= BROADCAST_ROWS  # then the hits' bodies are kept by the pass that makes the rows
    marked = texts.join(F.broadcast(state.where("n > 1").select("digest", F.lit(True).alias("hit"))), "digest", "left") if few else texts.withColumn("hit", F.lit(False))
    marked.select("id", "points", "file", "row", "digest", F.when(F.col("hit"), F.col("body")).alias("body")).write.mode("overwrite").parquet(f"{at}/rows")
    kept = spark.read.parquet(f"{at}/rows")
    rows = kept.select("id", "file", "row", "digest")
    mixed_digests(kept.where("body is not null") if few else texts).write.mode("overwrite").parquet(f"{at}/mixed")
    mixed = spark.read.parquet(f"{at}/mixed")

    def told(df: DataFrame) -> DataFrame:
        stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
        return df.select("id", "keep_id", F.col("n").alias("group_size"), stays.alias("kept"), "digest")

    n_mixed = mixed.count()
    if n_mixed:
        state = state.join(mixed, "digest", "left_anti")
        apart = (kept if few else texts).join(F.broadcast(mixed) if n_mixed <= BROADCAST_ROWS else mixed, "digest", "left_semi")
        groups = apart.groupBy("digest", "body").agg(F.count("*").alias("n"), _best().alias("best")).select("digest", "body", "n", F.col("best.id").alias("keep_id"), F.col("best.file").alias("keep_file"), F.col("best.row").alias("keep_row"))
        told(apart.join(groups, ["digest", "body"])).write.mode("overwrite").parquet(f"{at}/apart")
    hot = F.col("n") > max(1000, n // HOT_SHARE)
    often = rows.join(F.broadcast(state.where(hot)), "digest", "left")
    seldom = often.where("n is null").select("id", "file", "row", "digest").join(state.where(~hot), "digest")
    out = told(often.where("n is not null")).unionByName(told(seldom))
    return out.unionByName(spark.read.parquet(f"{at}/apart")) if n_mixed else out


def deduplicate(spark: SparkSession, source: str, at: str | None = None, id_col: str = "doc_id", text_col: str = "text", digest=sha256, files_per_trigger: int | None = None) -> DataFrame:
    """id, keep_id, group_size, kept, digest of every row of the Parquet table ``source``.

    ``at``: folder of the state that goes on growing; without one the state is dropped at the end.
    """
    place = at or shared_path(spark, "exact")
    ingest(spark, source, place, id_col, text_col, digest, files_per_trigger)
    found = resolve(spark, source, place, id_col, text_col, digest)
    result = shared_path(spark, "exact-groups")
    found.write.parquet(result)
    if at is None:
        remove(spark, place)
    return spark.read.schema(found.schema).parquet(result)


def op11_stream_dedup(spark, sf_dir: str) -> DataFrame:
    """The group of every document."""
    found = deduplicate(spark, f"{sf_dir}/documents.parquet")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size, row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST)
"""
