"""A folder that all executors share, for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, or below the warehouse where that is unset: the driver and all executors share both."""
    base = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base}/{name}-{uuid.uuid4().hex}"
