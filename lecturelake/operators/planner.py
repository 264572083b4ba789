"""Chunk strategy and chunk plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions import chunk_name, megabytes


@dataclass(frozen=True)
class Limits:
    """Settings of the remote provider."""

    request_seconds: float = 13500.0
    request_mb: float = 450.0
    chunk_seconds: int = 3600
    overlap_seconds: int = 2


def chunk_strategy(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds chunk_strategy, and chunk_seconds and overlap_seconds as they are to be used.

    Reads provider_name, clip_seconds, audio_bytes, chunk_seconds, overlap_seconds. A remote clip within the limits is
    one request, whose chunk is the whole clip; other remote clips get long chunks; the local provider keeps its own.
    """
    remote = F.col("provider_name") == "together"
    single = remote & (F.col("clip_seconds") <= limits.request_seconds) & (F.col("audio_bytes") / 1048576.0 <= limits.request_mb)
    return df.withColumns(
        {
            "chunk_strategy": F.when(single, "together_single_request").when(remote, "together_adaptive_chunks").otherwise("local_chunks"),
            "chunk_seconds": F.when(remote, F.lit(limits.chunk_seconds)).otherwise(F.col("chunk_seconds")).cast("long"),
            "overlap_seconds": F.when(remote, F.lit(limits.overlap_seconds)).otherwise(F.col("overlap_seconds")).cast("long"),
            "prepared_audio_mb": megabytes("audio_bytes"),
        }
    )


def plan_chunks(df: DataFrame) -> DataFrame:
    """A row per chunk: index, start_seconds, duration_seconds, next to all columns of df.

    Reads clip_seconds, chunk_seconds, overlap_seconds, and chunk_strategy if there is one. Chunks start every
    chunk - overlap seconds; the last one takes a rest of max(30, 2 * overlap) seconds or less with it. No chunks for a
    clip without length; an error for an impossible configuration. A closed form, so no loop and no Python.
    """
    d, c, o = F.col("clip_seconds"), F.col("chunk_seconds"), F.col("overlap_seconds")
    step = (c - o).cast("double")
    tail = F.greatest(F.lit(30.0), 2.0 * o)
    whole = F.col("chunk_strategy") == "together_single_request" if "chunk_strategy" in df.columns else F.lit(False)
    wrong = (d > 0) & ~whole & ((c <= 0) | (o < 0) | (o >= c))
    last = F.when(whole, F.lit(0)).when(wrong, F.raise_error(F.lit("chunk and overlap seconds do not fit")).cast("long"))
    last = last.otherwise(F.greatest(F.lit(0), F.ceil((d - c - tail) / step))).cast("long")
    index = F.when(d > 0, F.sequence(F.lit(0).cast("long"), last))
    rows = df.withColumn("_last", last).withColumn("index", F.explode(index))
    start = F.col("index") * step
    length = F.when(F.col("index") < F.col("_last"), c.cast("double")).otherwise(d - start)
    return rows.withColumns({"start_seconds": F.when(F.col("index") == 0, F.lit(0.0)).otherwise(start), "duration_seconds": F.when(whole, d).otherwise(length)}).drop("_last")


def manifests(plans: DataFrame, key: str = "job_id") -> DataFrame:
    """The planned chunks of each job as one array in order, with file names, which are made once the chunks are together."""
    one = F.struct(F.col("index").cast("int").alias("index"), "start_seconds", "duration_seconds", "provider_name")
    named = lambda x: F.struct(x["index"].alias("index"), x["start_seconds"].alias("start_seconds"), x["duration_seconds"].alias("duration_seconds"), chunk_name(x["index"], x["provider_name"]).alias("path"))
    return plans.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(one)), named).alias("chunk_manifest"))


def explode_manifest(jobs: DataFrame, key: str = "job_id") -> DataFrame:
    """A row per chunk of each job's manifest; a job with an empty or missing one gets a row with the error."""
    rows = jobs.select(key, F.explode_outer("chunk_manifest").alias("c"))
    error = F.when(F.col("c").isNull(), F.lit("empty manifest"))
    return rows.select(key, "c.index", "c.start_seconds", "c.duration_seconds", "c.path", error.alias("error"))
