"""A folder for tables that a query makes for itself."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """Below ``spark.checkpoint.dir``, which all executors share; where that is unset, a local folder in local mode and an error on a cluster."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
