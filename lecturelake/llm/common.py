"""Shared helpers: scratch tables in the cluster's shared folder, and small text expressions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For the same step on bytes; bytes.split() then splits at exactly the characters that WORD leaves out.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Bytes of an Arrow batch on its way to a Python worker.
BATCH_BYTES = 4 << 20


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def word_count(c: Column) -> Column:
    """Number of words, a long; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


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


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of the session hold BATCH_BYTES and one row more at most, unless it has a bound of its own.

    By default they hold 10,000 rows, so that an executor and its workers each keep 10,000 whole texts a task, however
    long. The setting decides how rows are dealt, never what is found.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, schema: str | None = None, codec: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: what reads it needs no lineage, so lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.options(**{"compression": codec} if codec else {}).parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)
