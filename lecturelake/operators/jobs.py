"""Job state: sets, queue positions, progress, change-sets, reviews, metrics documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schemas import ACTIVE, DEFAULTS, ACTIVE_DEFAULT, MILESTONES, PRIVATE, QUEUEABLE, STATUS_SETS


def active(df: DataFrame) -> DataFrame:
    return df.where("active")


def deactivate(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """df with active false for the keys at hand; unknown keys change nothing."""
    gone = keys.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    return df.join(gone, key, "left").withColumn("active", F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("active"))).select(*df.columns)


def status_in(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("status").isin(*STATUS_SETS[name]))


def public_view(df: DataFrame, table: str) -> DataFrame:
    """df without the table's private columns."""
    return df.select(*(c for c in df.columns if c not in PRIVATE.get(table, ())))


def with_defaults(df: DataFrame, table: str, now: Column) -> DataFrame:
    """Nulls in columns at hand filled with the table's defaults; created_at with now, arrays with empty ones."""
    values = {k: F.lit(v) for k, v in (ACTIVE_DEFAULT | DEFAULTS.get(table, {})).items()} | {"created_at": now}
    values |= {f.name: F.array().cast(f.dataType) for f in df.schema if f.dataType.typeName() == "array"}
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items() if c in df.columns})


def ensure_column(df: DataFrame, name: str, default: Column) -> DataFrame:
    """df with the column, made or with its nulls filled; applying it twice changes nothing."""
    return df.withColumn(name, F.coalesce(F.col(name), default) if name in df.columns else default)


def require_columns(df: DataFrame, names: set[str]) -> DataFrame:
    if missing := sorted(names - set(df.columns)):
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def queue_position(jobs: DataFrame) -> DataFrame:
    """Adds queue_position: for a job that can be queued, 1 and the active jobs created strictly earlier; null for others.

    Active jobs are counted by created_at; counts run up within a day, and day totals (one row a day) before them, so no
    task sees more than a day's distinct times."""
    counts = jobs.where(F.col("status").isin(*ACTIVE) & F.col("created_at").isNotNull()).groupBy("created_at").agg(F.count("*").alias("n")).withColumn("day", F.to_date("created_at"))
    past = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = counts.groupBy("day").agg(F.sum("n").alias("n")).select("day", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("before"))
    within = Window.partitionBy("day").orderBy("created_at").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0))).join(days, "day").select("created_at", (F.col("before") + F.col("inner") + 1).alias("_rank"))
    rows = jobs.join(ranks, "created_at", "left")
    return rows.withColumn("queue_position", F.when(F.col("status").isin(*QUEUEABLE), F.coalesce("_rank", F.lit(1))).cast("long")).select(*jobs.columns, "queue_position")


def progress(done: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs (job_id, status, total_chunks) with completed_chunks and progress; done has a row per finished chunk."""
    counts = done.groupBy("job_id").agg(F.count_distinct("chunk_index").alias("completed_chunks"))
    rows = jobs.join(counts, "job_id", "left").withColumn("completed_chunks", F.coalesce("completed_chunks", F.lit(0)).cast("long"))
    running = F.least(F.lit(92), 22 + (70 * F.col("completed_chunks") / F.col("total_chunks")).cast("int"))
    fixed = F.try_element_at(F.create_map(*(F.lit(x) for kv in MILESTONES.items() for x in kv)), F.col("status"))
    return rows.withColumn("progress", F.when((F.col("status") == "TRANSCRIBING") & (F.col("total_chunks") > 0), running).otherwise(fixed).cast("long"))


def real_time_factor(elapsed: str = "processing_seconds", clip: str = "clip_seconds") -> Column:
    return F.when(F.col(clip) > 0, F.col(elapsed) / F.col(clip))


def last_runtime(chunks: DataFrame) -> DataFrame:
    """What the last chunk of each job says of device, precision, language probability and model."""
    one = F.max_by(F.struct("device", "compute_type", "language_probability", "provider_model"), F.col("chunk_index"))
    return chunks.groupBy("job_id").agg(one.alias("r")).select("job_id", "r.*")


def metrics_doc(jobs: DataFrame, recordings: DataFrame, batch_size: int = 2, beam_size: int = 3) -> DataFrame:
    """(job_id, metrics): what preparation said, overlaid by what the run says; batch and beam for the local provider only.

    Preparation speaks through the stored metrics where jobs hold them (null if it said nothing), else through columns of
    its own; the run's fields replace stored ones, by null too."""
    said = [F.col(f"metrics.{c}" if "metrics" in jobs.columns else c).alias(c) for c in ("chunk_strategy", "prepared_audio_mb", "selected_interval_seconds")]
    recs = recordings.select(F.col("id").alias("recording_id"), F.col("duration_seconds").alias("recording_duration_seconds"))
    local = F.col("provider_name") == "local"
    doc = F.struct(
        *said, F.col("provider_name").alias("provider"), "provider_model", "language_probability",
        F.col("clip_seconds").alias("clip_duration_seconds"), "recording_duration_seconds", F.col("total_chunks").alias("chunks"), F.when(local, F.lit(batch_size)).alias("batch_size"), F.when(local, F.lit(beam_size)).alias("beam_size"),
    )
    return jobs.join(recs, "recording_id", "left").select("job_id", doc.alias("metrics"))


def apply_reviews(jobs: DataFrame, reviews: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Reviews (job_id, reviewed_text, approve) applied to jobs that have a transcript; outcome says what became of them.

    Of several reviews of a job the last one by the order columns counts, as if they came one after the other; without
    order columns the greatest by text, then approval."""
    r = latest(reviews, ["job_id"], list(order) or ["reviewed_text", "approve"])
    r = r.select("job_id", F.col("reviewed_text").alias("_text"), F.col("approve").alias("_approve"), F.lit(True).alias("_asked"))
    rows = jobs.join(r, "job_id", "left")
    ok = F.coalesce(F.col("_asked") & (F.coalesce("transcript_text", F.lit("")) != ""), F.lit(False))
    return rows.withColumns(
        {
            "reviewed_text": F.when(ok, F.col("_text")).otherwise(F.col("reviewed_text")),
            "status": F.when(ok, F.when(F.col("_approve"), "APPROVED").otherwise("READY_FOR_REVIEW")).otherwise(F.col("status")),
            "outcome": F.when(ok, "reviewed").when(F.col("_asked"), "no transcript"),
        }
    ).select(*jobs.columns, "outcome")


def apply_cancels(jobs: DataFrame, cancels: DataFrame) -> DataFrame:
    """Cancel requests (job_id) applied to active jobs; for others outcome is conflict."""
    asked = cancels.select("job_id").distinct().withColumn("_asked", F.lit(True))
    rows, ok = jobs.join(asked, "job_id", "left"), F.col("_asked") & F.col("status").isin(*ACTIVE)
    return rows.withColumns(
        {"outcome": F.when(ok, "cancelling").when(F.col("_asked"), "conflict"), "cancel_requested": F.coalesce(ok, F.lit(False)) | F.col("cancel_requested")}
    ).withColumn("status", F.when(F.col("outcome") == "cancelling", "CANCEL_REQUESTED").otherwise(F.col("status"))).select(*jobs.columns, "outcome")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by the order columns; a grouped maximum, combined before the shuffle."""
    row = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r")).select("r.*")


def apply_patch(base: DataFrame, patches: DataFrame, key: str = "id", order: tuple[str, ...] = ()) -> DataFrame:
    """Partial updates: patches (key, patch map<string,string>) change the fields they hold, also to null; others stay.

    Several patches of a key apply one after the other by the order columns, so that each field has the value of the last
    patch that holds it; without order columns, the greatest value, null least. A patch names no fields twice."""
    each = patches.select(key, *order, F.explode("patch").alias("_field", "_value"))
    at = F.struct(*order) if order else F.struct("_value")
    last = each.groupBy(key, "_field").agg(F.max_by(F.struct("_value"), at)["_value"].alias("_value"))
    one = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_field", "_value"))).alias("_p"))
    rows = base.join(one, key, "left")
    kinds = {f.name: f.dataType for f in base.schema}

    def new(c: str) -> Column:
        held = F.coalesce(F.map_contains_key("_p", F.lit(c)), F.lit(False))
        return F.when(held, F.try_element_at("_p", F.lit(c)).cast(kinds[c])).otherwise(F.col(c))

    return rows.withColumns({c: new(c) for c in base.columns if c != key}).select(*base.columns)


def merge_job_state(jobs: DataFrame, updates: DataFrame, key: str = "job_id", order: tuple[str, ...] = (), given: str | None = None) -> DataFrame:
    """Updates (key and some columns) over jobs; unknown keys are left out.

    An update gives the columns that the array in its column `given` names, null ones too; without such a column, or
    where it is null, those that are not null. Several updates of a job apply one after the other by the order columns:
    each column has what the last update that gives it says. Without order columns the greatest value counts, null least."""
    changed = [c for c in updates.columns if c not in (key, given, *order)]

    def said(c: str) -> Column:
        there = F.col(c).isNotNull()
        if given:
            there = F.when(F.col(given).isNull(), there).otherwise(F.array_contains(given, c))
        return F.max_by(F.struct(F.col(c).alias("v")), F.when(there, F.struct(*(order or (c,))))).alias(f"_{c}")

    u = updates.groupBy(key).agg(*map(said, changed))
    return jobs.join(u, key, "left").withColumns({c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}.v")).otherwise(F.col(c)) for c in changed}).select(*jobs.columns)
