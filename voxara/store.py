"""Tables kept between the rounds of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL = ""


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session that has none gets a temporary folder, and a cluster must name one."""
    global _LOCAL
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _LOCAL = _LOCAL or tempfile.mkdtemp(prefix="voxara-raster-")
        at = f"file://{_LOCAL}"
    return at.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """df as a table that was written to the shared folder, which cuts its lineage."""
    path = f"{shared_folder(df.sparkSession)}/voxara-raster-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
