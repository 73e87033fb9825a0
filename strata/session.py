"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none in local mode (tests) a local folder is made and set; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.master != "local" and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that all its machines share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "strata-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df):
    """A reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
