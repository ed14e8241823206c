"""Written intermediate tables, in the shared folder named by the session."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    A session on ``local`` or ``local[n]`` without that setting gets a temporary folder; on a
    cluster a missing setting is an error, because no machine-local folder is
    visible to every executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="haulplan-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/haulplan/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return it as a table scan.

    The result survives lost executors, is never evaluated twice, and its file
    sizes let the planner decide about broadcasting from facts.
    """
    path = staging_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
