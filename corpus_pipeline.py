"""A training corpus from ``documents``: toxicity, quality, near duplicates, repeated passages, packing.

Each stage is a function (spark, docs, sf_dir) over all rows that the stage before it kept; its result is
written as Parquet under the shared folder and read again, so a lost executor never repeats more than one
stage; tables of earlier stages are deleted. All stages but the last return the columns of ``documents``.

Cases, in every stage: a null or empty text is no toxic one, has too few words for the quality rules and goes there;
texts of any length are read whole; rows that repeat an id and text are kept or dropped alike (near duplicates keep the
rows of the least id of a group, so exact repeats of that row stay); rows with a null id pass the near-duplicate stages;
an empty table gives empty results; further columns pass through all stages but packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import common, minhash, packing, quality, toxicity, windows
from strata.llm.common import remove, shared_path, table


#: Rows of the Arrow batches in all stages: whole texts of any length pass through them.
BATCH_ROWS = "1000"
#: Distinct chunks that a worker remembers while packing: it shares its executor with what earlier stages left idle.
CHUNKS = 120_000


def small_batches(spark) -> None:
    """For what a stage returns, which is run later, so the option stays set; ``run`` sets it back when all stages are written."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. The model learns from labelled rows of the whole table."""
    small_batches(spark)
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.filter_toxic(docs, model)


def drop_low_quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no quality rule."""
    return quality.filter_quality(docs)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least id, of each component over 5-word shingles with a similarity of 0.8 or more."""
    small_batches(spark)
    return minhash.drop_near_duplicates(docs, width=5, percent=80)


def cut_repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words stay in the document of least id that holds them."""
    small_batches(spark)
    return windows.cut_passages(docs)


def pack_sequences(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 4096."""
    small_batches(spark)
    import public_tokenizers

    packed = packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), chunks=CHUNKS)
    return packed.select(F.col("id").alias("doc_id"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: A trained model and a tokenizer are beyond SQL; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's table; those of the stages before it are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    with common.small_batches(spark, int(BATCH_ROWS)):
        for name, stage in STAGES:
            path = shared_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if before is not None:
                remove(spark, before)
            before = path
    return docs
