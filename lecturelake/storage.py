"""Scratch tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder name in the folder that spark.checkpoint.dir names, which the whole cluster shares.

    Where the setting is missing and the master is this machine alone, as in tests, a temporary folder is set for the
    session. On a cluster executors could not share it, so there the setting must be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lecturelake-{uuid.uuid4().hex}"


def spread(df: DataFrame) -> DataFrame:
    """A plain scan dealt over the cores where its files give fewer parts than there are cores; else as it is.

    Files of one row group are one task, however large; costly work on each row should not wait for it. Large inputs have
    parts enough, so they are never shuffled for this. Not for what follows a shuffle, whose parts Spark sets as it runs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
