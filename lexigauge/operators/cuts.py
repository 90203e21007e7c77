"""Cutting a plan: what a loop has made so far goes to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df as written to spark.checkpoint.dir, each task once. A local master without that setting gets a folder of its own.

    A checkpoint would run the last stage twice, once to count and once to write.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        into = tempfile.mkdtemp(prefix="lexigauge-cuts-")
        atexit.register(shutil.rmtree, into, ignore_errors=True)
        sc.setCheckpointDir(into)
    path = f"{sc.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
