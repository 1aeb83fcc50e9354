"""Reliable intermediate storage for iterative jobs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and ends its lineage by a checkpoint in the shared folder that spark.checkpoint.dir names.

    Only where that is unset and Spark runs in one process is a local folder taken; on a cluster it must be set. With
    spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes checkpoints that nothing refers to any more.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at:
            if not re.fullmatch(r"local(\[[^]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="graphloom-steps-")
            atexit.register(shutil.rmtree, at, ignore_errors=True)
            at = "file://" + at
        context.setCheckpointDir(at)
    return df.checkpoint(eager=True)
