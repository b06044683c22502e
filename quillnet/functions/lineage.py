"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where it is unset and the master is local, as in tests."""
    context = spark.sparkContext
    jsc = context._jsc.sc()
    conf = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not conf and jsc.getCheckpointDir().isDefined():
        conf = jsc.getCheckpointDir().get()
    if not conf:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="quillnet-")
    if not jsc.getCheckpointDir().isDefined():
        context.setCheckpointDir(conf)
    return conf


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/quillnet-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from files in the shared folder; a lost executor costs nothing before them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
