"""Declarative row validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import is_email

# Bounds of each entity's fields. A length rule holds for null unless the field is required.
LENGTHS = {
    "site": {"code": (2, 40), "name": (2, 120), "address": (0, 240)},
    "classroom": {"code": (1, 40), "name": (2, 120), "floor": (0, 40)},
    "camera": {"code": (2, 60), "name": (2, 120), "brand": (0, 80), "model": (0, 100), "serial_number": (0, 120), "source_uri": (0, 500)},
    "assignment": {"notes": (0, 300)},
    "professor": {"code": (2, 40), "full_name": (3, 160)},
    "course": {"code": (2, 40), "name": (2, 160)},
    "schedule": {},
    "job": {"requested_by": (2, 120)},
    "review": {"reviewed_text": (1, None)},
}
RANGES = {"classroom": {"capacity": (1, 10000)}, "schedule": {"day_of_week": (0, 6)}, "job": {"chunk_seconds": (60, 1800), "overlap_seconds": (0, 30), "priority": (0, 9)}}
REQUIRED = {
    "site": ("code", "name"), "classroom": ("site_id", "code", "name"), "camera": ("code", "name"), "assignment": ("camera_id", "classroom_id"), "professor": ("code", "full_name"),
    "course": ("code", "name"), "schedule": ("professor_id", "course_id", "classroom_id", "day_of_week", "start_time", "end_time"), "job": ("recording_id", "class_started_at", "class_ended_at"), "review": ("reviewed_text",),
}
SOURCE_TYPES = ("pending", "local", "nvr", "nas", "cloud", "external_api")


def rules(entity: str, columns: list[str], update: bool = False) -> dict[str, Column]:
    """Rule id -> condition that a row must meet, for the columns at hand; an update requires nothing."""
    out: dict[str, Column] = {}
    for c in () if update else REQUIRED[entity]:
        out[f"{c}.required"] = F.col(c).isNotNull()
    for c, (least, most) in LENGTHS[entity].items():
        if c in columns:
            out[f"{c}.length"] = (F.length(c) >= least) & (F.length(c) <= most if most is not None else F.lit(True))
    for c, (least, most) in RANGES.get(entity, {}).items():
        if c in columns:
            out[f"{c}.range"] = F.col(c).between(least, most)
    if entity == "camera" and "source_type" in columns:
        out["source_type.enum"] = F.col("source_type").isin(*SOURCE_TYPES)
    if entity == "professor" and "email" in columns:
        out["email.form"] = is_email("email")
    if entity == "schedule":
        out["end_time.order"] = F.col("end_time") > F.col("start_time")
        if not update and {"valid_from", "valid_until"} <= set(columns):
            out["valid_until.order"] = F.col("valid_until") >= F.col("valid_from")
    if entity == "job":
        out["class_ended_at.order"] = F.col("class_ended_at") > F.col("class_started_at")
        if {"chunk_seconds", "overlap_seconds"} <= set(columns):
            out["overlap_seconds.order"] = F.col("overlap_seconds") < F.col("chunk_seconds")
    return out


def validate(df: DataFrame, entity: str, update: bool = False) -> DataFrame:
    """df with `errors`, the ids of the rules that a row breaks, in one pass; rows with none are valid. A condition on null holds."""
    broken = [F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules(entity, df.columns, update).items()]
    return df.withColumn("errors", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))


def split_valid(df: DataFrame, entity: str, update: bool = False) -> tuple[DataFrame, DataFrame]:
    checked = validate(df, entity, update)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)
