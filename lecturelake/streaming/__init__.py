"""Streaming operators: arrivals, job state, progress, stitching, cancels, replacement, duplicates, monitoring."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.stitch import EPSILON, MAX_WORDS, MIN_WORDS
from ..schemas import TERMINAL
from ..sources import MAX_GB, landing_fault, store_segments, stored_segments
from ..storage import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name[:-1]}[{name[-1]}]")  # a stream takes one file by a pattern only


def run_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there; write may see a batch twice and must then give the same result."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def drained(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """What a stream gives for all that is there, as a table; in update mode the last row of each key."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    run_batches(stream, write, f"{path}/state", mode)
    rows = spark.read.schema(schema.add("batch", "long")).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    if keys:
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "batch").alias("r")).select("r.*")
    return rows.drop("batch")


def stream_ingest(arrivals: DataFrame, gate: Callable[[DataFrame], DataFrame], path: str) -> None:
    """Arriving recordings through a gate (ingest_recordings with its tables bound), batch by batch: accepted and rejected
    rows go to two folders, a batch's folder being replaced if the batch runs again. A batch is read once."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        rows = gate(batch).persist()
        rows.where("reject_reason is null").drop("reject_reason").write.mode("overwrite").parquet(f"{path}/accepted/batch={number}")
        rows.where("reject_reason is not null").write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        rows.unpersist()
        batch.unpersist()

    run_batches(arrivals, write, f"{path}/state")


def stream_landing(spark: SparkSession, folder: str, archive: str | None = None, files: int = 1000) -> DataFrame:
    """Files that land under folder, as a stream (path, length, modificationTime); their content is not read.

    A batch takes `files` at most. With an archive, a folder outside the landing one, files are moved there once the
    batch after theirs is on its way, so that listings stay short; a file is taken once either way. Folders are listed by
    tasks of many folders each, as a task for each one would take longer than its listing."""
    spark.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", 4 * spark.sparkContext.defaultParallelism)
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stream = stream.option("maxFilesPerTrigger", files).option("recursiveFileLookup", True)
    if archive:
        spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", 8)  # one thread falls behind the batches
        stream = stream.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return stream.load(folder).select("path", "length", "modificationTime").coalesce(spark.sparkContext.defaultParallelism)  # else a task for every few files


def gate_landed(files: DataFrame, declared: DataFrame, probed: Callable[[DataFrame], DataFrame], max_gb: float = MAX_GB) -> DataFrame:
    """Landed files with declared's columns (path, declared_bytes and what is known of the recording) and reject_reason.

    Size goes first: files that are too large, or not all there, never reach `probed`, which takes the others and gives
    them back with reject_reason; the columns that it adds are null for those refused. A file that nobody declared is
    refused as well."""
    rows = files.join(declared.withColumn("_declared", F.lit(True)), "path", "left")
    reason = F.when(F.col("_declared").isNull(), "undeclared").otherwise(landing_fault(max_gb))
    rows = rows.withColumn("reject_reason", reason).drop("declared_bytes", "_declared")
    refused, fit = rows.where("reject_reason is not null"), rows.where("reject_reason is null").drop("reject_reason")
    return probed(fit).unionByName(refused, allowMissingColumns=True)


def stream_latest_status(events: DataFrame) -> DataFrame:
    """The latest status of each job (job_id, seq, status); late events do not set it back. Update mode."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))


def stream_progress(done: DataFrame, delay: str = "1 day") -> DataFrame:
    """Finished chunks of each job (job_id, chunk_index, ts), each counted once however often it is reported within delay."""
    once = done.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id", "chunk_index"])
    return once.groupBy("job_id").agg(F.count("*").alias("completed_chunks"))


#: What words lose to be compared; they hold no spaces themselves. \w is letters, numbers and underscores.
PLAIN = re.compile(r"[^\w ]+")
_STITCHED = "job_id string, chunk_index long, clean_text string, removed_words long, segment_ids array<string>"


def _cleaned(previous: str | None, current: str | None, most: int = MAX_WORDS, least: int = MIN_WORDS) -> tuple[str | None, int]:
    """current without the words that repeat the end of previous, and their number; a null text stays null."""
    if current is None:
        return None, 0
    plain = lambda ws: PLAIN.sub("", " ".join(ws).lower()).split(" ") if ws else []
    a, b = (previous or "").split(), current.split()
    tail, head = plain(a[-most:]), plain(b[:most])
    size = next((k for k in range(min(len(tail), len(head)), least - 1, -1) if tail[-k] == head[0] and tail[-k:] == head[:k]), 0)
    return (" ".join(b[size:]) if size else current.strip()), size


class JobState(StatefulProcessor):
    """A job's place in its chunks: value `place` (next index, last words of the chunk before, last kept end), map `early`
    of the chunks that came too soon. All goes with the last chunk, with a terminal status, or when the watermark passes
    the job's last row, and what waits is given up."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "expected long, previous string, last double")
        self.early = handle.getMapState("early", "chunk_index long", "text string, segment_ids array<string>, ends array<double>, total_chunks long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, out, ended, total = self.place.get(), [], False, None
        # a job without a place has no other state; each look at the state is a call to the executor
        at, waits, seen = (known, self.early.exists(), list(self.handle.listTimers())) if known else ((0, "", -1.0), False, [])
        newest = max(seen, default=0)
        for frame in rows:
            for row in frame.sort_values("chunk_index").itertuples(index=False):
                ended = ended or row.status in TERMINAL
                newest = max(newest, row.millis)
                if pd.isna(row.chunk_index) or row.chunk_index < at[0]:
                    continue  # a status alone, or a chunk that comes again
                count = None if pd.isna(row.total_chunks) else int(row.total_chunks)
                held = (row.text, None if row.segment_ids is None else list(row.segment_ids), None if row.ends is None else [None if pd.isna(e) else float(e) for e in row.ends], count)
                if row.chunk_index > at[0]:
                    self.early.updateValue((int(row.chunk_index),), held)
                    waits = True
                    continue
                while held is not None:
                    at, total = self._take(key, at, held, out), held[3] if held[3] is not None else total
                    held = self.early.getValue((at[0],)) if waits and self.early.containsKey((at[0],)) else None
                    if held is not None:
                        self.early.removeKey((at[0],))
        for timer in seen:
            self.handle.deleteTimer(timer)
        if ended or (total is not None and at[0] >= total):
            if known or waits:
                self._clear()
        else:
            self.place.update(at)
            self.handle.registerTimer(int(newest))
        yield pd.DataFrame(out, columns=["job_id", "chunk_index", "clean_text", "removed_words", "segment_ids"])

    @staticmethod
    def _take(key: tuple, at: tuple, held: tuple, out: list) -> tuple:
        (index, previous, last), (text, ids, ends, _) = at, held
        kept = []
        for segment, end in zip(ids or (), ends or ()):
            if end is not None and end > last + EPSILON:
                kept.append(segment)
                last = end
        out.append((key[0], index, *_cleaned(previous, text), kept))
        return index + 1, " ".join((text or "").split()[-MAX_WORDS:]), last

    def _clear(self) -> None:
        self.place.clear()
        self.early.clear()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_chunks(chunks: DataFrame, idle: str = "1 day") -> DataFrame:
    """dedup_overlap and highwater in one pass over a stream of chunks: (job_id, chunk_index, clean_text, removed_words,
    segment_ids), a row for each chunk in the order of its job, with the segments that end after the last one kept.

    chunks has job_id and chunk_index from 0, and may have text, segment_ids, ends, total_chunks, status and ts, else the
    time at which a row is read. Chunks that
    come too early wait; a chunk that comes again changes nothing, unless its job has gone; a row without chunk_index says
    a status only. A segment without an end is left out. JobState tells what is kept, and until when: a job is given up
    that is silent until others have rows `idle` later, and a row as late as that is left out. State lies in RocksDB, so that it need not fit in memory."""
    spark = chunks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fields = {"chunk_index": "long", "text": "string", "segment_ids": "array<string>", "ends": "array<double>", "total_chunks": "long", "status": "string"}
    rows = chunks.select("job_id", *(F.col(c).cast(kind).alias(c) if c in chunks.columns else F.lit(None).cast(kind).alias(c) for c, kind in fields.items()), F.col("ts") if "ts" in chunks.columns else F.current_timestamp().alias("ts"))
    rows = rows.withColumn("millis", F.unix_millis("ts")).withWatermark("ts", idle)
    return rows.groupBy("job_id").transformWithStateInPandas(JobState(), _STITCHED, "Append", "EventTime")


def stream_stitch(chunks: DataFrame, idle: str = "1 day") -> DataFrame:
    """stream_chunks' texts: (job_id, chunk_index, clean_text, removed_words)."""
    return stream_chunks(chunks, idle).select("job_id", "chunk_index", "clean_text", "removed_words")


def stream_highwater(chunks: DataFrame, idle: str = "1 day") -> DataFrame:
    """stream_chunks' segments: (job_id, segment_id)."""
    return stream_chunks(chunks, idle).select("job_id", F.explode("segment_ids").alias("segment_id"))


def drop_cancelled(chunks: DataFrame, cancels: DataFrame, within: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """chunks of jobs that were not cancelled before: both streams have job_id and ts.

    A chunk is kept if no cancel of its job lies at its time or up to `within` before it. Both streams may be late by
    `delay`; a cancel that comes later than that is not seen. A chunk is given once the watermark, which the slower
    stream sets, has passed it; with it go the chunk's state, and a cancel's `within` later, so that no state is for ever."""
    c = chunks.withWatermark("ts", delay).alias("c")
    x = cancels.select(F.col("job_id").alias("_job"), F.col("ts").alias("_ts")).withWatermark("_ts", delay).alias("x")
    met = F.expr(f"c.job_id = x._job and x._ts <= c.ts and x._ts >= c.ts - interval {within}")
    return c.join(x, met, "left_outer").where("_job is null").select(*(f"c.{k}" for k in chunks.columns))


def replace_stream(segments: DataFrame, path: str, buckets: int = 64) -> None:
    """Segments (job_id, attempt, segment_id and more) into a stored table, batch by batch.

    A job's rows are replaced by those of a later attempt, never by a later batch, so that an attempt may come in any
    number of pieces, and a batch that runs again, or rows that come twice, change nothing."""
    run_batches(segments, lambda batch, number: store_segments(batch, f"{path}/rows", buckets), f"{path}/state")


def current_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments that replace_stream has stored, of each job's latest attempt."""
    return stored_segments(spark, f"{path}/rows")


def _refused(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (active,) = state.get if state.exists else (False,)
    rows, out = pd.concat(list(batches)).sort_values("seq"), []
    for seq, kind in zip(rows["seq"], rows["kind"]):
        if kind == "request":
            out.append((key[0], int(seq), bool(active)))
            active = True
        elif kind in TERMINAL:
            active = False
    if active:
        state.update((True,))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["interval", "seq", "refused"])


def stream_reject_duplicates(events: DataFrame) -> DataFrame:
    """Of (interval string, seq long, kind request or a job state) each request, refused while its interval is active.

    Only active intervals have state."""
    return events.groupBy("interval").applyInPandasWithState(_refused, "interval string, seq long, refused boolean", "active boolean", "append", GroupStateTimeout.NoTimeout)


def stream_ops_metrics(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Counts and sums by window and event type (ts, event_type, value); what is later than delay is dropped. Append mode
    gives a window once the watermark has passed it, update mode as it grows."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def paired_runs(starts: DataFrame, ends: DataFrame, longest: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Runs (ts, provider_name, failed, wait, run, rtf) from two streams: starts (job_id, provider_name, created_at, ts) and
    ends (job_id, status, clip_seconds, ts), where an end lies within `longest` after its job's start; ts is the end's.

    Either stream may be late by `delay`. State goes with the watermark: a start waits for its end as long as one may come."""
    s = starts.select(F.col("job_id").alias("_job"), "provider_name", "created_at", F.col("ts").alias("_started")).withWatermark("_started", delay)
    met = F.expr(f"job_id = _job and ts >= _started and ts <= _started + interval {longest}")
    seconds = lambda late, early: (F.unix_micros(late) - F.unix_micros(early)) / 1e6
    run = seconds("ts", "_started")
    return ends.withWatermark("ts", delay).join(s, met).select(
        "ts", "provider_name", (F.col("status") == "ERROR").alias("failed"), seconds("_started", "created_at").alias("wait"), run.alias("run"), F.when(F.col("clip_seconds") > 0, run / F.col("clip_seconds")).alias("rtf")
    )


_SUMS = ("jobs", "failures", "wait", "run", "rtf", "rtf_jobs")


def hourly_runs(runs: DataFrame, width: str = "1 hour") -> DataFrame:
    """Sums of runs by window w and provider, given once the watermark has passed a window; null providers are one group."""
    return runs.groupBy(F.window("ts", width).alias("w"), "provider_name").agg(
        F.count("*").alias("jobs"), F.count_if("failed").alias("failures"), F.sum("wait").alias("wait"), F.sum("run").alias("run"), F.sum("rtf").alias("rtf"), F.count("rtf").alias("rtf_jobs")
    )


def longer_windows(sums: DataFrame, width: str = "1 day") -> DataFrame:
    """hourly_runs summed up by longer windows, in the same stream: a window counts at its last moment."""
    return sums.groupBy(F.window(F.window_time("w"), width).alias("w"), "provider_name").agg(*(F.sum(c).alias(c) for c in _SUMS))


def run_report(sums: DataFrame) -> DataFrame:
    """(window_start, provider_name, jobs, failures, mean_wait, mean_run, mean_rtf) of sums by window."""
    mean = lambda c, n: F.try_divide(c, n)
    return sums.select(F.col("w.start").alias("window_start"), "provider_name", "jobs", "failures", mean("wait", "jobs").alias("mean_wait"), mean("run", "jobs").alias("mean_run"), mean("rtf", "rtf_jobs").alias("mean_rtf"))
