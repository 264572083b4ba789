"""The ten tables' schemas, public column sets and defaults."""

from __future__ import annotations

from functools import cache

from pyspark.sql.types import StructType

MANIFEST = "array<struct<index:int,start_seconds:double,duration_seconds:double,path:string>>"
METRICS = (
    "struct<chunk_strategy:string,prepared_audio_mb:double,selected_interval_seconds:double,provider:string,provider_model:string,language_probability:double,"
    "clip_duration_seconds:double,recording_duration_seconds:double,chunks:int,batch_size:int,beam_size:int>"
)
# The columns of the tables; times of day are seconds of the day.
TABLES = {
    "sites": "id string, code string, name string, address string, active boolean, created_at timestamp",
    "classrooms": "id string, site_id string, code string, name string, floor string, capacity int, active boolean, created_at timestamp",
    "cameras": "id string, classroom_id string, code string, name string, brand string, model string, serial_number string, source_type string, source_uri string, active boolean, created_at timestamp",
    "camera_assignments": "id string, camera_id string, classroom_id string, started_at timestamp, ended_at timestamp, active boolean, notes string",
    "professors": "id string, code string, full_name string, email string, active boolean, created_at timestamp",
    "courses": "id string, code string, name string, description string, vocabulary array<string>, active boolean, created_at timestamp",
    "schedules": "id string, professor_id string, course_id string, classroom_id string, day_of_week int, start_time int, end_time int, valid_from date, valid_until date, active boolean, created_at timestamp",
    "recordings": "id string, site_id string, classroom_id string, camera_id string, source_type string, source_uri string, original_name string, recording_started_at timestamp, duration_seconds double, container_format string, video_codec string, audio_codec string, audio_sample_rate int, audio_channels int, has_audio boolean, file_size_bytes bigint, created_at timestamp",
    "transcription_jobs": "id string, recording_id string, schedule_id string, professor_id string, course_id string, requested_by string, class_started_at timestamp, class_ended_at timestamp, offset_start_seconds double, offset_end_seconds double, status string, progress int, priority int, cancel_requested boolean, provider_name string, model_name string, language string, chunk_seconds int, overlap_seconds int, device_used string, compute_type_used string, work_dir string, prepared_audio_uri string, "
    f"chunk_manifest {MANIFEST}, total_chunks int, completed_chunks int, transcript_text string, reviewed_text string, error_message string, processing_seconds double, real_time_factor double, metrics {METRICS}, created_at timestamp, started_at timestamp, completed_at timestamp",
    "transcript_segments": "id string, job_id string, chunk_index int, start_seconds double, end_seconds double, text string, avg_logprob double, no_speech_prob double, speaker_label string",
}


@cache
def table_schema(name: str) -> StructType:
    """A table's schema; needs a session, as Spark parses it."""
    return StructType.fromDDL(TABLES[name])


# Columns that stay inside.
PRIVATE = {
    "recordings": {"source_uri"},
    "transcription_jobs": {"cancel_requested", "work_dir", "prepared_audio_uri", "chunk_manifest", "transcript_text", "reviewed_text", "metrics"},
}
# Defaults at insertion; created_at is the caller's "now".
DEFAULTS = {
    "cameras": {"active": True, "source_type": "pending"},
    "transcription_jobs": {
        "requested_by": "Administrador", "status": "PENDING", "progress": 0, "priority": 5, "cancel_requested": False, "provider_name": "local", "model_name": "large-v3",
        "language": "es", "chunk_seconds": 300, "overlap_seconds": 3, "total_chunks": 0, "completed_chunks": 0,
    },
}
ACTIVE_DEFAULT = {"active": True}

# Job states.
QUEUEABLE = ("PENDING", "VALIDATING", "EXTRACTING", "CHUNKING", "QUEUED_TRANSCRIPTION")
ACTIVE = (*QUEUEABLE, "TRANSCRIBING", "MERGING")
TERMINAL = ("READY_FOR_REVIEW", "APPROVED", "CANCELLED", "ERROR")
REVIEWABLE = ("READY_FOR_REVIEW", "APPROVED")
STATUS_SETS = {"active": ACTIVE, "queueable": QUEUEABLE, "cancellable": ACTIVE, "reviewable": REVIEWABLE, "terminal": TERMINAL}
MILESTONES = {"PENDING": 0, "VALIDATING": 3, "EXTRACTING": 8, "CHUNKING": 15, "QUEUED_TRANSCRIPTION": 20, "TRANSCRIBING": 22, "MERGING": 95, "READY_FOR_REVIEW": 100, "CANCELLED": 0, "ERROR": 0}
