"""The driver's tables in the roles of the ten tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import words
from ..storage import spread

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

ROLES = {
    "sites": "SELECT CAST(r_regionkey AS STRING) AS id, concat('S', r_regionkey) AS code, r_name AS name, CAST(NULL AS STRING) AS address, r_regionkey <> 4 AS active FROM {region}",
    "classrooms": "SELECT CAST(n_nationkey AS STRING) AS id, CAST(n_regionkey AS STRING) AS site_id, concat('C', n_nationkey) AS code, n_name AS name, n_nationkey * 900 AS capacity, n_nationkey % 7 <> 0 AS active FROM {nation}",
    "cameras": "SELECT CAST(s_suppkey AS STRING) AS id, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE CAST(s_nationkey AS STRING) END AS classroom_id, s_name AS code, s_name AS name, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE CAST(s_suppkey % 97 AS STRING) END AS serial_number, CASE WHEN s_suppkey % 13 = 0 THEN 'tape' ELSE 'nvr' END AS source_type, s_acctbal > 0 AS active FROM {supplier}",
    "professors": "SELECT CAST(c_custkey AS STRING) AS id, concat('P', c_custkey) AS code, c_name AS full_name, CASE WHEN c_custkey % 9 = 0 THEN 'bad@' WHEN c_custkey % 4 = 0 THEN NULL ELSE concat('p', c_custkey, '@example.org') END AS email, c_acctbal > 0 AS active FROM {customer}",
    "courses": "SELECT CAST(p_partkey AS STRING) AS id, concat('K', p_partkey) AS code, p_name AS name, split(concat(p_type, ' ', p_name), ' ') AS vocabulary, p_size > 5 AS active FROM {part}",
    "schedules": "SELECT CAST(p_partkey AS STRING) AS id, CAST(p_partkey % 150 + 1 AS STRING) AS professor_id, CAST(p_partkey AS STRING) AS course_id, CAST(p_partkey % 25 AS STRING) AS classroom_id, CAST(p_partkey % 7 AS INT) AS day_of_week, CAST((p_partkey % 16 + 6) * 3600 AS INT) AS start_time, CAST((p_partkey % 16 + 6) * 3600 + (p_size - 5) * 600 AS INT) AS end_time, CASE WHEN p_partkey % 2 = 0 THEN DATE '2024-01-01' + CAST(p_partkey % 40 AS INT) END AS valid_from, CASE WHEN p_partkey % 3 = 0 THEN DATE '2024-01-15' + CAST(p_partkey % 60 AS INT) END AS valid_until, p_size > 3 AS active FROM {part}",
    "recordings": "SELECT CAST(event_id AS STRING) AS id, CASE WHEN event_id % 17 = 0 THEN '0' ELSE CAST(n_regionkey AS STRING) END AS site_id, CAST(n_nationkey AS STRING) AS classroom_id, CAST(user_id % 100 + 1 AS STRING) AS camera_id, CAST(ts AS TIMESTAMP) AS recording_started_at, CAST(ts AS TIMESTAMP) AS created_at, value * 1000 AS duration_seconds, event_type <> 'error' AS has_audio, CAST(floor(value * 1000000) AS BIGINT) AS file_size_bytes FROM {events} JOIN {nation} ON n_nationkey = user_id % 25",
    "jobs": "SELECT CAST(o_orderkey AS STRING) AS job_id, CAST(o_custkey AS STRING) AS recording_id, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE CAST(o_orderkey % 2500 AS STRING) END AS schedule_id, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS professor_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 200 AS STRING) END AS course_id, concat('u', o_custkey % 50) AS requested_by, CASE WHEN o_orderkey % 13 = 0 THEN 'ERROR' WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'APPROVED' WHEN o_orderstatus = 'F' THEN 'READY_FOR_REVIEW' WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderkey % 4 = 0 THEN 'VALIDATING' ELSE 'TRANSCRIBING' END AS status, CAST(o_orderkey % 10 AS INT) AS priority, CASE WHEN o_orderkey % 3 = 0 THEN 'together' ELSE 'local' END AS provider_name, CASE WHEN o_orderkey % 11 = 0 THEN 'huge' WHEN o_orderkey % 2 = 0 THEN 'turbo' ELSE 'large-v3' END AS model_name, o_totalprice / 10 AS clip_seconds, CAST(floor(o_totalprice * 3000) AS BIGINT) AS audio_bytes, CAST(300 AS BIGINT) AS chunk_seconds, CAST(o_orderkey % 40 AS BIGINT) AS overlap_seconds, CAST(7 AS BIGINT) AS total_chunks, o_totalprice / 70 AS processing_seconds, o_totalprice / 900 AS prepare_seconds, o_orderpriority AS error_message, o_orderkey % 6 = 0 AS cancel_requested, CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat('text ', o_orderkey) END AS transcript_text, CASE WHEN o_orderkey % 9 = 0 THEN concat('reviewed ', o_orderkey) WHEN o_orderkey % 2 = 0 THEN '' END AS reviewed_text, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM {orders}",
    "segments": "SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_quantity AS INT) AS STRING), CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING)) AS segment_id, CAST(l_orderkey AS STRING) AS job_id, CAST(l_linenumber AS INT) AS chunk_index, CAST(l_partkey * 100000 + l_suppkey AS BIGINT) AS position, CAST(l_linenumber AS DOUBLE) * 300 AS chunk_start, l_quantity - 1 AS start_seconds, l_quantity AS end_seconds, CASE WHEN l_suppkey % 10 = 0 THEN '  ' ELSE concat(' item ', l_partkey, '  of ', l_suppkey, ' ') END AS text, CASE WHEN l_suppkey % 3 = 0 THEN NULL WHEN l_suppkey % 3 = 1 THEN '' ELSE concat('s', l_suppkey % 4) END AS speaker_label FROM {lineitem}",
    "assignments": "SELECT event_id, CAST(user_id % 100 + 1 AS STRING) AS camera_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 25 AS STRING) END AS classroom_id, CAST(ts AS TIMESTAMP) AS started_at FROM {events}",
    "requests": "SELECT event_id AS request_id, CAST(event_id AS STRING) AS recording_id, CAST(ts AS TIMESTAMP) AS class_started_at, value FROM {events}",
    "turns": "SELECT CAST(conv_id AS STRING) AS job_id, CAST(turn AS INT) AS chunk_index, role AS speaker_label, text FROM {conversations}",
}


class Inputs:
    """Tables and roles of a folder, by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name not in ROLES:
            raise AttributeError(name)
        sql = ROLES[name]
        return self.spark.sql(sql, **{t: getattr(self, t) for t in BASE if f"{{{t}}}" in sql})

    def chunks(self) -> DataFrame:
        """Documents as overlapping chunks: windows of 50 words, every 45 words."""
        rows = spread(self.documents.select("doc_id", "text")).select(F.col("doc_id").alias("job_id"), words("text").alias("w"))
        last = F.greatest(F.lit(0), F.ceil((F.size("w") - 50) / 45)).cast("int")
        # slices are made before the explode, so that no chunk carries its document's words
        pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i * 45 + 1, 50), " "))
        return rows.select("job_id", F.posexplode(pieces).alias("chunk_index", "text"))


def with_roles(sql: str) -> str:
    """SQL over the roles for DuckDB; it may begin with a comma and further common tables."""
    ctes = ", ".join(f"{name} AS ({body.format(**{t: t for t in BASE})})" for name, body in ROLES.items())
    return f"WITH {ctes}{sql}" if sql.lstrip().startswith(",") else f"WITH {ctes} {sql}"
