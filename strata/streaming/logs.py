"""Log fan-in: records routed by severity, as a stream or a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: severities (fixed values)
SEVERITIES = {1: "DEBUG", 2: "INFO", 3: "WARNING", 4: "ERROR", 5: "SEVERE"}


def route(records: DataFrame, least: int = 1, own_files: tuple[int, ...] = (5,)) -> DataFrame:
    """Adds ``sink``: a file per severity in ``own_files``, ``general`` for the rest at or above ``least``, others dropped."""
    name = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    sink = F.when(F.col("severity").isin(*own_files), F.lower(F.element_at(name, F.col("severity")))).otherwise("general")
    return records.where(F.col("severity") >= least).withColumn("sink", sink)


def line():
    return F.format_string("%s %s: %s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.col("sender_id"), F.col("message"))


def start(records: DataFrame, path: str, checkpoint: str, **routing):
    """A streaming query that appends each sink's lines to its own folder."""
    out = route(records, **routing).select(line().alias("value"), "sink")
    return out.writeStream.format("text").partitionBy("sink").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
