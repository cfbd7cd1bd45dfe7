"""The shared folder that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; a cluster session
    is refused, because its executors do not share the driver's disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="ledgerleaf-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/ledgerleaf/{name}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """The rows written to the shared folder and read again, so that no plan repeats their work."""
    spark = rows.sparkSession
    path = work_dir(spark, name)
    rows.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
