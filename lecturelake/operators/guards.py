"""Guards: references, locations, intervals, jobs, uniqueness, duplicates. A row's first failing test is its reject_reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import fallback, seconds_between
from ..schemas import ACTIVE

MODELS = ("large-v3", "turbo", "medium", "small")


def fk_violations(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows of child whose key is not null and not in parent; a parent's active flag does not matter."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)), key, "left_anti").select(*child.columns)


def fk_valid(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(key)), key, "left_semi").select(*child.columns)


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share all keys with another row; nulls never conflict. Keys are counted before the rows are joined back."""
    some = df.dropna(subset=keys)
    twice = some.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return some.join(twice, keys, "left_semi").select(*df.columns)


def guard_location(df: DataFrame, classrooms: DataFrame, cameras: DataFrame) -> DataFrame:
    """Adds reject_reason to df (site_id, classroom_id, camera_id): the classroom must be active and in the site, the camera
    active and in the classroom now; the site's own flag is not looked at."""
    rooms = classrooms.select(F.col("id").alias("classroom_id"), F.col("site_id").alias("_site"), F.col("active").alias("_room"))
    seen = cameras.select(F.col("id").alias("camera_id"), F.col("classroom_id").alias("_at"), F.col("active").alias("_camera"))
    rows = df.join(rooms, "classroom_id", "left").join(seen, "camera_id", "left")
    room = F.coalesce(F.col("_room") & (F.col("_site") == F.col("site_id")), F.lit(False))
    camera = F.coalesce(F.col("_camera") & (F.col("_at") == F.col("classroom_id")), F.lit(False))
    return rows.withColumn("reject_reason", F.when(~room, "classroom").when(~camera, "camera")).select(*df.columns, "reject_reason")


def with_offsets(df: DataFrame) -> DataFrame:
    """Adds the class's offsets in seconds from the recording's start."""
    return df.withColumns({"offset_start_seconds": seconds_between("recording_started_at", "class_started_at"), "offset_end_seconds": seconds_between("recording_started_at", "class_ended_at")})


def interval_reason() -> Column:
    end = F.col("recording_started_at") + F.make_dt_interval(secs=F.col("duration_seconds").cast("decimal(18,6)"))
    return F.when(F.col("class_started_at") < F.col("recording_started_at"), "starts before the recording").when(F.col("class_ended_at") > end, "ends after the recording")


def guard_interval(df: DataFrame) -> DataFrame:
    return df.withColumn("reject_reason", interval_reason())


def job_reason(provider: str = "local", remote_ready: bool = True) -> Column:
    """In order: interval, overlap, model, remote key, remote model."""
    c = F.when(F.col("class_ended_at") <= F.col("class_started_at"), "interval").when(F.col("overlap_seconds") >= F.col("chunk_seconds"), "overlap").when(~F.col("model_name").isin(*MODELS), "model")
    if provider == "together":
        c = c.when(F.lit(not remote_ready), "remote key").when(F.col("model_name") != "large-v3", "remote model")
    return c


def guard_job(df: DataFrame, provider: str = "local", remote_ready: bool = True) -> DataFrame:
    return df.withColumn("reject_reason", job_reason(provider, remote_ready))


def guard_schedule(df: DataFrame, update: bool = False) -> DataFrame:
    """Times in order; validity dates in order too, but not on a partial update."""
    c = F.when(F.col("end_time") <= F.col("start_time"), "time")
    return df.withColumn("reject_reason", c if update else c.when(F.col("valid_until") < F.col("valid_from"), "validity"))


def patched_schedule_guard(base: DataFrame, patch: DataFrame) -> DataFrame:
    """The time check on effective values: a patch's (id, start_time, end_time) where not null, else the row's."""
    p = patch.select("id", F.col("start_time").alias("_s"), F.col("end_time").alias("_e"))
    rows = base.join(p, "id").withColumns({"start_time": F.coalesce("_s", "start_time"), "end_time": F.coalesce("_e", "end_time")})
    return guard_schedule(rows.drop("_s", "_e"), update=True)


def reject_duplicates(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Adds duplicate: an active job has the same recording and interval, or an earlier request of this batch has them.

    Requests: request_id, recording_id, class_started_at, class_ended_at. The window over a key holds that interval's
    requests only."""
    keys = ["recording_id", "class_started_at", "class_ended_at"]
    held = jobs.where(F.col("status").isin(*ACTIVE)).select(*keys).distinct().withColumn("_held", F.lit(True))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("request_id"))
    rows = requests.withColumn("_nth", nth).join(held, keys, "left")
    return rows.withColumn("duplicate", F.coalesce("_held", F.lit(False)) | (F.col("_nth") > 1)).select(*requests.columns, "duplicate")


def enrich_jobs(requests: DataFrame, recordings: DataFrame, schedules: DataFrame) -> DataFrame:
    """Requests with their recording's columns, professor_id and course_id filled from the schedule, and reject_reason.

    The recording must exist; a schedule that is named must be active and in the recording's classroom. An empty text
    counts as missing."""
    recs = recordings.select(F.col("id").alias("recording_id"), F.col("classroom_id").alias("_room"), "recording_started_at", "duration_seconds", F.lit(True).alias("_found"))
    named = schedules.select(F.col("id").alias("schedule_id"), F.col("professor_id").alias("_p"), F.col("course_id").alias("_c"), F.col("classroom_id").alias("_slot"), F.col("active").alias("_active"))
    rows = requests.join(recs, "recording_id", "left").withColumn("schedule_id", F.nullif("schedule_id", F.lit(""))).join(named, "schedule_id", "left")
    asked = F.col("schedule_id").isNotNull()
    reason = F.when(F.col("_found").isNull(), "recording").when(asked & ~F.coalesce("_active", F.lit(False)), "schedule").when(asked & (F.col("_slot") != F.col("_room")), "schedule classroom")
    rows = rows.withColumns({"professor_id": fallback("professor_id", "_p"), "course_id": fallback("course_id", "_c"), "reject_reason": reason})
    return rows.drop("_room", "_found", "_p", "_c", "_slot", "_active")


def ingest_recordings(landed: DataFrame, probes: DataFrame, classrooms: DataFrame, cameras: DataFrame) -> DataFrame:
    """Landed recordings (id, site_id, classroom_id, camera_id) with their probe's columns and reject_reason: location
    first, then a duration above zero, then audio. One pass; write accepted and rejected rows from it."""
    rows = guard_location(landed, classrooms, cameras).join(probes, "id", "left")
    silent = ~F.coalesce("has_audio", F.lit(False))
    reason = F.coalesce("reject_reason", F.when(F.coalesce("duration_seconds", F.lit(0.0)) <= 0, "duration").when(silent, "audio"))
    return rows.withColumn("reject_reason", reason)
