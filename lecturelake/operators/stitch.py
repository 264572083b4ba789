"""Stitching: repeated words at chunk borders, segments already covered, transcripts, prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import normalize_text, normalize_words, strip, words

MAX_WORDS, MIN_WORDS, EPSILON = 40, 3, 0.05


def dedup_overlap(chunks: DataFrame, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds clean_text and removed_words to chunks (job_id, chunk_index, text).

    The longest run of max_words to min_words words that ends the previous chunk's raw text and, word by word after
    normalisation, begins this one's is removed. Words are normalised before the window, which keeps that work out of
    the search for the longest run; of a long chunk only the first and last max_words are. The window has each chunk's text
    and those words, and a length is tried only where the run's first word fits.
    """
    order = Window.partitionBy("job_id").orderBy("chunk_index")
    rows = chunks.withColumn("_w", words("text"))
    ends = F.concat(F.slice("_w", 1, max_words), F.slice("_w", F.size("_w") - max_words + 1, max_words))
    rows = rows.withColumn("_e", F.when(F.size("_w") > 2 * max_words, ends).otherwise(F.col("_w"))).select(*chunks.columns, normalize_words("_e").alias("_n"))
    rows = rows.withColumn("_p", F.coalesce(F.lag("_n").over(order), F.array().cast("array<string>")))
    rows = rows.withColumn("_before", F.slice("_p", F.greatest(F.size("_p") - max_words + 1, F.lit(1)), max_words)).withColumn("_head", F.slice("_n", 1, max_words))
    most = F.least(F.size("_before"), F.size("_head"))
    starts = lambda k: F.get("_before", F.size("_before") - k) == F.get("_head", F.lit(0))
    fits = F.filter(F.sequence(most, F.lit(min_words), F.lit(-1)), lambda k: starts(k) & (F.slice("_before", F.size("_before") - k + 1, k) == F.slice("_head", F.lit(1), k)))
    removed = F.when(most >= min_words, F.coalesce(F.get(fits, 0), F.lit(0))).otherwise(F.lit(0))
    rows = rows.withColumn("removed_words", removed.cast("long"))
    rest = F.array_join(F.slice(words("text"), (F.col("removed_words") + 1).cast("int"), F.greatest(F.length("text"), F.lit(1))), " ")
    clean = F.when(F.col("removed_words") > 0, rest).otherwise(strip("text"))
    return rows.withColumn("clean_text", clean).select(*chunks.columns, "clean_text", "removed_words")


def merge_transcript(parts: DataFrame, text: str = "clean_text", *also: Column) -> DataFrame:
    """One text per job: its chunks' parts that are not blank, in order, with a blank line between; further aggregates in `also`."""
    part = strip(text)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(part != "", F.struct(F.col("chunk_index"), part.alias("t"))))), lambda x: x["t"]), "\n\n")
    return parts.groupBy("job_id").agg(strip(joined).alias("transcript_text"), *also)


def chunk_text(segments: DataFrame) -> DataFrame:
    """The text of each chunk: its segments' texts in order of position, normalised."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("position", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    return segments.groupBy("job_id", "chunk_index").agg(normalize_text(F.array_join(ordered, " ")).alias("text"))


def nonblank(segments: DataFrame) -> DataFrame:
    """Segments whose text is more than white space, normalised."""
    return segments.withColumn("text", normalize_text("text")).where(F.length("text") > 0)


def absolutise(segments: DataFrame) -> DataFrame:
    """Segment times from the chunk's start (chunk_start) to the clip's."""
    return segments.withColumns({"start_seconds": F.col("chunk_start") + F.col("start_seconds"), "end_seconds": F.col("chunk_start") + F.col("end_seconds")})


def namespace_speaker(segments: DataFrame) -> DataFrame:
    """Speaker labels made distinct by chunk: remote jobs of several chunks only (provider_name, total_chunks)."""
    apply = (F.col("provider_name") == "together") & (F.col("total_chunks") > 1) & (F.coalesce("speaker_label", F.lit("")) != "")
    return segments.withColumn("speaker_label", F.when(apply, F.format_string("CHUNK_%02d_%s", F.col("chunk_index") + 1, F.col("speaker_label"))).otherwise(F.col("speaker_label")))


def _folded(eps: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps the rows, sorted within jobs, that end after the last kept end of their job plus eps; one value is carried."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, last = object(), -1.0
        for batch in batches:
            keep = []
            for one, end in zip(batch.column("job_id").to_pylist(), batch.column("end_seconds").to_pylist()):
                if one != job:
                    job, last = one, -1.0
                keep.append(end is not None and float(end) > last + eps)
                if keep[-1]:
                    last = max(last, float(end))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return fold


def highwater(segments: DataFrame, order: tuple[str, ...] = ("chunk_index", "position"), eps: float = EPSILON) -> DataFrame:
    """Segments (job_id, end_seconds, order) without those that end by the last kept end plus eps.

    The last kept end starts at -1 and moves on kept rows only. Against the running maximum m of all earlier ends, an end
    of m or less is dropped and one above m + eps is kept, whatever happened before; jobs with an end in between, which
    are few, pass row by row through a fold, sorted within partitions. Both paths work within a job, and neither gathers one.
    """
    before = Window.partitionBy("job_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = segments.withColumn("_m", F.coalesce(F.max("end_seconds").over(before), F.lit(-1.0)))
    between = (F.col("end_seconds") > F.col("_m")) & (F.col("end_seconds") <= F.col("_m") + eps)
    rows = rows.withColumn("_fold", F.coalesce(F.max(between).over(Window.partitionBy("job_id")), F.lit(False)))
    sure = rows.where(~F.col("_fold") & (F.col("end_seconds") > F.col("_m") + eps)).select(*segments.columns)
    near = rows.where("_fold").select(*segments.columns).repartition("job_id").sortWithinPartitions("job_id", *order)
    return sure.union(near.mapInArrow(_folded(eps), segments.schema))


def prompts(chunks: DataFrame) -> DataFrame:
    """Adds prompt: 80 vocabulary terms at most and the last 500 characters of the previous chunk's raw text; null without both."""
    order = Window.partitionBy("job_id").orderBy("chunk_index")
    terms = F.array_join(F.slice("vocabulary", 1, 80), ", ")
    known = F.when(F.coalesce(terms, F.lit("")) != "", F.concat(F.lit("Vocabulario esperado: "), terms, F.lit(".")))
    tail = F.lag(F.right("text", F.lit(500))).over(order)
    context = F.when(F.coalesce(tail, F.lit("")) != "", F.concat(F.lit("Contexto anterior: "), tail))
    return chunks.withColumn("prompt", F.nullif(F.concat_ws(" ", known, context), F.lit("")))


def jobs_with_segments(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """Each job with its segments by start, an empty list if it has none."""
    one = F.struct("start_seconds", "end_seconds", "segment_id", "speaker_label", "text")
    lists = segments.groupBy("job_id").agg(F.array_sort(F.collect_list(one)).alias("segments"))
    kind = lists.schema["segments"].dataType.simpleString()
    return jobs.join(lists, "job_id", "left").withColumn("segments", F.coalesce("segments", F.array().cast(kind)))
