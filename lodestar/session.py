"""Session settings that the package needs."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_ROWS = "1000"
ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where it is not installed, and keep the batches they get small: texts can be
    long, and a batch of Spark's default 10,000 rows takes a large part of a small executor's memory."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark
