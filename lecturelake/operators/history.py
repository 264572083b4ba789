"""Camera assignments: effective-dated history, as-of lookups, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def assignment_history(events: DataFrame, mode: str = "event_time") -> DataFrame:
    """Intervals from assignment events (event_id, camera_id, classroom_id, started_at): each new one closes the one before.

    mode event_time orders by started_at, mode arrival by event_id, in which case an end can lie before a start. An
    event without a classroom closes without opening. A camera's events meet in one task, not those of all cameras."""
    order = ["started_at", "event_id"] if mode == "event_time" else ["event_id"]
    after = F.lead("started_at").over(Window.partitionBy("camera_id").orderBy(*order))
    rows = events.withColumn("ended_at", after).where(F.col("classroom_id").isNotNull())
    return rows.withColumn("active", F.col("ended_at").isNull())


def opening_events(cameras: DataFrame, event_id: Column) -> DataFrame:
    """The assignment events that cameras (id, classroom_id, created_at) made with a classroom open themselves."""
    placed = cameras.where(F.coalesce("classroom_id", F.lit("")) != "")
    return placed.select(event_id.alias("event_id"), F.col("id").alias("camera_id"), "classroom_id", F.col("created_at").alias("started_at"))


def close_assignments(history: DataFrame, closes: DataFrame) -> DataFrame:
    """history with explicit closes (event_id, closed_at): an assignment ends at its first close, or before it if another
    one took its place, and is active no more. Unknown ids change nothing."""
    ends = closes.groupBy("event_id").agg(F.min("closed_at").alias("_closed"))
    rows = history.join(ends, "event_id", "left")
    return rows.withColumns({"ended_at": F.least("ended_at", "_closed"), "active": F.col("active") & F.col("_closed").isNull()}).select(*history.columns)


def clear_classrooms(cameras: DataFrame, closed: DataFrame) -> DataFrame:
    """cameras (id, classroom_id) without their classroom, where a closed assignment (camera_id, classroom_id) names it."""
    gone = closed.select(F.col("camera_id").alias("id"), "classroom_id").distinct().withColumn("_gone", F.lit(True))
    rows = cameras.join(gone, ["id", "classroom_id"], "left")
    return rows.withColumn("classroom_id", F.when(F.col("_gone").isNull(), F.col("classroom_id"))).select(*cameras.columns)


def current_classrooms(history: DataFrame) -> DataFrame:
    return history.where("active").select("camera_id", "classroom_id")


def asof_classroom(recordings: DataFrame, history: DataFrame) -> DataFrame:
    """Adds asof_classroom: where the recording's camera was at its start, null if nowhere.

    Recordings and intervals of a camera are put in order of time together, and each recording takes the last interval
    begun: work is in proportion to both, where a join on the camera would pair each of its recordings with all of its
    intervals. Intervals must not overlap, as those of assignment_history by event time; of several that
    start at once the last to end counts. Recordings without a camera or a start stay, with null."""
    rec = recordings.select(F.struct(*recordings.columns).alias("rec"), F.col("camera_id").alias("camera"), F.col("recording_started_at").alias("at"))
    span = F.when(F.col("ended_at").isNull() | (F.col("ended_at") > F.col("started_at")), F.struct("classroom_id", "ended_at"))
    until = F.coalesce("ended_at", F.lit("9999-12-31").cast("timestamp"))
    begun = history.select(F.col("camera_id").alias("camera"), F.col("started_at").alias("at"), span.alias("span"), until.alias("until")).where("span is not null and camera is not null")
    order = Window.partitionBy("camera").orderBy("at", F.col("rec").isNotNull(), "until").rowsBetween(Window.unboundedPreceding, 0)
    rows = rec.unionByName(begun, allowMissingColumns=True).withColumn("open", F.last("span", ignorenulls=True).over(order)).where("rec is not null")
    held = (F.col("open.ended_at").isNull() | (F.col("at") < F.col("open.ended_at"))) & F.col("at").isNotNull()
    return rows.select("rec.*", F.when(held, F.col("open.classroom_id")).alias("asof_classroom"))


def assignment_drift(cameras: DataFrame, history: DataFrame) -> DataFrame:
    """Cameras whose own classroom differs from their open assignment's, null counting as a value."""
    open_ = current_classrooms(history).select(F.col("camera_id").alias("id"), F.col("classroom_id").alias("assigned"))
    both = cameras.select("id", F.col("classroom_id").alias("current")).join(open_, "id", "full_outer")
    return both.where(~F.col("current").eqNullSafe(F.col("assigned")))
