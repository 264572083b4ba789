"""A query per operator, with the SQL that DuckDB compares it with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import functions as fn, sources, streaming
from ..operators import guards, history, jobs as state, metrics, planner, providers, rules, schedules, stitch, views
from ..storage import scratch, spread
from .inputs import Inputs, with_roles

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Inputs under a name, with its SQL over the roles."""

    def add(f: Callable[[Inputs], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, folder: f(Inputs(spark, folder))
        if sql:
            _SQL[name] = with_roles(sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


NORM = r"trim(regexp_replace({0}, '[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+', ' ', 'g'))"
ACTIVE = "('PENDING', 'VALIDATING', 'EXTRACTING', 'CHUNKING', 'QUEUED_TRANSCRIPTION', 'TRANSCRIBING', 'MERGING')"
QUEUEABLE = "('PENDING', 'VALIDATING', 'EXTRACTING', 'CHUNKING', 'QUEUED_TRANSCRIPTION')"


def norm(c: str) -> str:
    return NORM.format(c)


#: The chunks of Inputs.chunks and their stitching, as common tables.
CHUNKS = rf""", dw AS (SELECT doc_id AS job_id, list_filter(string_split({norm('text')}, ' '), lambda x: x <> '') AS w FROM documents),
ck AS (SELECT job_id, i AS chunk_index, w[i * 45 + 1 : i * 45 + 50] AS cw FROM (SELECT job_id, w, unnest(range(0, greatest(0, ceil((len(w) - 50) / 45.0))::INT + 1)) AS i FROM dw)),
nw AS (SELECT *, list_transform(cw, lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}_]', '', 'g')) AS n FROM ck),
pv AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY job_id ORDER BY chunk_index), []) AS p FROM nw),
st AS (SELECT job_id, chunk_index, cw, coalesce(list_max(list_filter(range(3, least(40, len(p), len(n)) + 1), lambda k: p[len(p) - k + 1 : len(p)] = n[1 : k])), 0)::BIGINT AS removed_words FROM pv),
cl AS (SELECT job_id, chunk_index, removed_words, array_to_string(cw[removed_words + 1 :], ' ') AS clean_text FROM st)"""


# ---- functions ----


@query("fn_text", rf"SELECT doc_id, md5({norm('text')}) AS normal, len(list_filter(string_split({norm('text')}, ' '), lambda x: x <> ''))::BIGINT AS n_words, md5(array_to_string(list_transform(string_split({norm('text')}, ' '), lambda x: regexp_replace(lower(x), '[^\p{{L}}\p{{N}}_]', '', 'g')), ' ')) AS plain, len(list_filter(list_transform(string_split(text, ','), lambda x: {norm('x')}), lambda x: x <> ''))::BIGINT AS n_terms FROM documents")
def _(t: Inputs) -> DataFrame:
    plain = F.array_join(F.transform(F.split(fn.normalize_text("text"), " "), fn.normalize_word), " ")
    return t.documents.select("doc_id", F.md5(fn.normalize_text("text")).alias("normal"), F.size(fn.words("text")).cast("long").alias("n_words"), F.md5(plain).alias("plain"), F.size(fn.terms("text")).cast("long").alias("n_terms"))


@query("fn_names", r"""SELECT page_id, coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'recording.bin') AS safe, page_id || '_' || coalesce(nullif(trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'recording.bin') AS stored,
 coalesce(nullif(trim(url_decode(url)), ''), 'recording.bin') AS decoded, CASE WHEN url LIKE '%.html' THEN 'text/html' ELSE 'application/octet-stream' END AS media_type, printf('chunk_%05d.%s', page_id, CASE WHEN page_id % 2 = 0 THEN 'flac' ELSE 'wav' END) AS chunk FROM pages""")
def _(t: Inputs) -> DataFrame:
    provider = F.when(F.col("page_id") % 2 == 0, "together").otherwise("local")
    return t.pages.select("page_id", fn.safe_name("url").alias("safe"), fn.stored_name("page_id", "url").alias("stored"), fn.decoded_name("url").alias("decoded"), fn.media_type("url").alias("media_type"), fn.chunk_name("page_id", provider).alias("chunk"))


@query("fn_numbers", """SELECT o_orderkey, printf('%02d:%02d:%02d', floor(o_totalprice + 0.5)::BIGINT // 3600, floor(o_totalprice + 0.5)::BIGINT % 3600 // 60, floor(o_totalprice + 0.5)::BIGINT % 60) AS duration,
 CASE WHEN o_totalprice * 100 < 1024 THEN printf('%.0f B', round(o_totalprice * 100)) WHEN o_totalprice * 100 < 1048576 THEN printf('%.0f KB', round(o_totalprice * 100 / 1024)) ELSE printf('%.2f MB', round(o_totalprice * 100 / 1048576, 2)) END AS size,
 round_even(floor(o_totalprice * 3000) / 1048576, 3) AS mb, printf('%02d:%02d', o_orderkey % 86400 // 3600, o_orderkey % 3600 // 60) AS clock,
 ['Lunes', 'Martes', 'Miércoles', 'Jueves', 'Viernes', 'Sábado', 'Domingo'][o_orderkey % 7 + 1] AS weekday, try_cast(o_orderpriority[1:1] AS DOUBLE) AS lenient FROM orders""")
def _(t: Inputs) -> DataFrame:
    return t.orders.select(
        "o_orderkey", fn.duration_text("o_totalprice").alias("duration"), fn.bytes_text(F.col("o_totalprice") * 100).alias("size"), fn.megabytes(F.floor(F.col("o_totalprice") * 3000)).alias("mb"),
        fn.clock_text(F.col("o_orderkey") % 86400).alias("clock"), fn.weekday_name(F.col("o_orderkey") % 7).alias("weekday"), fn.lenient_double(F.substring("o_orderpriority", 1, 1)).alias("lenient"),
    )


@query("fn_times", "SELECT event_id, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M') AS local, epoch_us(ts)::BIGINT // 1000 + floor(value * 1000)::BIGINT AS absolute_ms, (epoch_us(ts)::BIGINT - 1704067200000000) / 1000000.0::DOUBLE AS seconds FROM events")
def _(t: Inputs) -> DataFrame:
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", fn.local_minute("ts", "Etc/GMT-2").alias("local"), F.unix_millis(fn.absolute_at("ts", "value")).alias("absolute_ms"), fn.seconds_between(F.lit("2024-01-01 00:00:00").cast("timestamp"), "ts").alias("seconds"))


@query("prj_labels", "SELECT job_id, CASE status WHEN 'ERROR' THEN 'Error' WHEN 'APPROVED' THEN 'Aprobada' WHEN 'READY_FOR_REVIEW' THEN 'Pendiente de revisión' WHEN 'PENDING' THEN 'En cola' WHEN 'VALIDATING' THEN 'Validando' ELSE 'Transcribiendo' END AS label, coalesce(course_id, '—') AS course FROM jobs")
def _(t: Inputs) -> DataFrame:
    return t.jobs.select("job_id", fn.status_label("status").alias("label"), F.coalesce("course_id", F.lit(fn.DASH)).alias("course"))


@query("prj_final_text", "SELECT job_id, CASE WHEN coalesce(reviewed_text, '') <> '' THEN reviewed_text ELSE transcript_text END AS final_text FROM jobs")
def _(t: Inputs) -> DataFrame:
    return t.jobs.select("job_id", fn.final_text().alias("final_text"))


# ---- sources and sinks ----


#: The ten tables, each with the role that stands in for it and the role's key.
TEN = {n: (n, "id") for n in ("sites", "classrooms", "cameras", "professors", "courses", "schedules", "recordings")}
TEN |= {"camera_assignments": ("assignments", "event_id"), "transcription_jobs": ("jobs", "job_id"), "transcript_segments": ("segments", "segment_id")}


@query("src_tables", " UNION ALL ".join(f"SELECT '{name}' AS name, count({key}) AS n FROM {role}" for name, (role, key) in TEN.items()))
def _(t: Inputs) -> DataFrame:
    from ..schemas import table_schema

    path = scratch(t.spark)
    for name, (role, key) in TEN.items():
        df = getattr(t, role).withColumnRenamed(key, "id")
        df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_schema(name))).write.parquet(f"{path}/{name}")
    out = None
    for name, df in sources.load_tables(t.spark, path).items():
        n = df.agg(F.count("id").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.union(n)
    return out


@query("src_landed_files", "SELECT page_id, CASE WHEN page_id % 50 = 0 THEN 'size' WHEN page_id % 7 = 0 AND page_id % 3 <> 0 THEN 'incomplete' END AS reject_reason FROM pages")
def _(t: Inputs) -> DataFrame:
    size = F.when(F.col("page_id") % 50 == 0, F.lit(90).cast("long") * (1 << 30)).otherwise(F.octet_length("html").cast("long"))
    listing = t.pages.select("page_id", F.col("page_id").cast("string").alias("path"), size.alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    declared = t.pages.where("page_id % 3 <> 0").select(F.col("page_id").cast("string").alias("path"), (F.octet_length("html") + F.when(F.col("page_id") % 7 == 0, 1).otherwise(0)).cast("long").alias("declared_bytes"))
    return sources.landed_files(listing, declared).select("page_id", "reject_reason")


@query("src_probe_parse", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 4 <> 0 THEN l_quantity ELSE greatest(l_extendedprice, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE l_tax END) END AS duration_seconds, 'mp4' AS container_format,
 'h264' AS video_codec, CASE WHEN l_partkey % 5 <> 0 THEN 'aac' END AS audio_codec, CASE WHEN l_partkey % 5 <> 0 THEN 48000 END AS audio_sample_rate, CASE WHEN l_partkey % 5 <> 0 THEN l_linenumber END AS audio_channels, l_partkey % 5 <> 0 AS has_audio FROM lineitem""")
def _(t: Inputs) -> DataFrame:
    p = F.col("l_partkey")
    stream = lambda kind, codec, duration: F.struct(F.lit(kind).alias("codec_type"), F.lit(codec).alias("codec_name"), duration.alias("duration"), F.lit("48000").alias("sample_rate"), F.col("l_linenumber").alias("channels"))
    video, audio = stream("video", "h264", F.col("l_extendedprice").cast("string")), stream("audio", "aac", F.when(p % 3 == 0, "N/A").otherwise(F.col("l_tax").cast("string")))
    other = stream("data", "bin", F.when(p % 3 == 0, "N/A").otherwise(F.col("l_tax").cast("string")))
    form = F.struct(F.when(p % 4 == 0, "N/A").otherwise(F.col("l_quantity").cast("string")).alias("duration"), F.lit("mp4").alias("format_name"))
    rows = t.lineitem.withColumn("probe_json", F.to_json(F.struct(form.alias("format"), F.when(p % 5 == 0, F.array(video, other)).otherwise(F.array(video, audio)).alias("streams"))))
    out = sources.parse_probe(rows)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "duration_seconds", "container_format", "video_codec", "audio_codec", "audio_sample_rate", "audio_channels", "has_audio")


def _responses(t: Inputs) -> DataFrame:
    """A response per order: its lines as segments, some blank, some with words only, some responses with text only."""
    word = lambda c: F.struct(c.alias("word"))
    blank, only = F.col("l_suppkey") % 10 == 0, F.col("l_suppkey") % 10 == 1
    part = F.concat(F.lit("item "), F.col("l_partkey"))
    seg = F.struct(
        F.col("l_quantity").alias("start"), F.when(F.col("l_suppkey") % 4 != 0, F.col("l_quantity") + 1).alias("end"), F.when(blank, "  ").when(~only, part).alias("text"),
        F.when(only, F.array(word(F.lit("item")), word(F.lit(None).cast("string")), word(F.col("l_partkey").cast("string")))).alias("words"), F.col("l_tax").alias("avg_logprob"), F.concat(F.lit("s"), F.col("l_linenumber")).alias("speaker_id"),
    )
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", seg.alias("s")))).alias("items"))
    segs = F.transform("items", lambda x: x["s"])
    text = F.concat(F.lit(" whole  "), F.col("l_orderkey"))
    none = F.col("l_orderkey") % 6 == 0
    doc = F.struct(F.when(F.col("l_orderkey") % 2 == 0, text).alias("text"), F.lit("").alias("language"), F.col("l_orderkey").cast("double").alias("duration"), F.when(~none, segs).alias("segments"))
    return items.select(F.col("l_orderkey").cast("string").alias("job_id"), F.lit("es").alias("language"), F.to_json(doc).alias("asr_json"))


@query("src_asr_response", """, s AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'item ' || l_partkey END AS text, l_quantity AS start_seconds, CASE WHEN l_suppkey % 4 <> 0 THEN l_quantity + 1 ELSE 0 END AS end_seconds, l_tax AS avg_logprob, 's' || l_linenumber AS speaker_label FROM lineitem WHERE l_orderkey % 6 <> 0 AND l_suppkey % 10 <> 0),
 k AS (SELECT o::VARCHAR AS job_id, 'es' AS language, (row_number() OVER (PARTITION BY o ORDER BY ln, l_partkey, l_suppkey, l_extendedprice) - 1)::INT AS position, start_seconds, end_seconds, text, avg_logprob, speaker_label FROM s),
 e AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey::VARCHAR NOT IN (SELECT job_id FROM k))
 SELECT * FROM k UNION ALL SELECT l_orderkey::VARCHAR, 'es', 0, 0.0, l_orderkey::DOUBLE, 'whole ' || l_orderkey, NULL, NULL FROM e WHERE l_orderkey % 2 = 0 UNION ALL SELECT l_orderkey::VARCHAR, 'es', NULL, NULL, NULL, NULL, NULL, NULL FROM e WHERE l_orderkey % 2 <> 0""")
def _(t: Inputs) -> DataFrame:
    return sources.parse_asr_response(_responses(t)).drop("no_speech_prob")


@query("src_telemetry_csv", "SELECT l_linenumber AS index, 'gpu' || l_partkey AS name, l_suppkey::INT AS memory_mb, l_returnflag AS driver, l_quantity::INT AS utilization_percent FROM lineitem WHERE l_suppkey % 5 <> 0 AND l_partkey % 7 <> 0")
def _(t: Inputs) -> DataFrame:
    line = F.concat_ws(", ", "l_linenumber", F.concat(F.lit("gpu"), F.col("l_partkey")), F.when(F.col("l_suppkey") % 5 == 0, "n/a").otherwise(F.col("l_suppkey").cast("string")), "l_returnflag", F.when(F.col("l_partkey") % 7 != 0, F.col("l_quantity").cast("int")))
    return sources.parse_gpu_csv(t.lineitem.select(line.alias("line")))


@query("prj_http_class", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'r' || event_id WHEN event_id % 3 = 1 THEN 'cf' || event_id ELSE 'sin-id' END AS request_id,
 CASE event_id % 5 WHEN 0 THEN 'capacity' WHEN 1 THEN 'rate limit' WHEN 2 THEN 'error' WHEN 3 THEN 'not json' ELSE 'ok' END AS outcome, CASE event_id % 5 WHEN 1 THEN 'no indicado'
 WHEN 2 THEN CASE event_id % 4 WHEN 0 THEN 'm' || event_id WHEN 1 THEN 'c' || event_id WHEN 2 THEN '{"kind":' || event_id || '}' ELSE 'd' || event_id END END AS message FROM events""")
def _(t: Inputs) -> DataFrame:
    i = F.col("event_id")
    headers = F.when(i % 3 == 0, F.create_map(F.lit("x-request-id"), F.concat(F.lit("r"), i))).when(i % 3 == 1, F.create_map(F.lit("x-request-id"), F.lit(""), F.lit("cf-ray"), F.concat(F.lit("cf"), i))).otherwise(F.create_map(F.lit("a"), F.lit("b")))
    code = F.element_at(F.array(*map(F.lit, (503, 429, 400, 200, 200))), (i % 5 + 1).cast("int"))
    forms = ['{"error": {"message": "m%d"}}', '{"error": {"message": "", "code": "c%d"}, "message": "x"}', '{"error": {"kind": %d}, "message": "x"}', '{"error": "x", "detail": "d%d"}']
    failed = F.element_at(F.array(*(F.format_string(f, i) for f in forms)), (i % 4 + 1).cast("int"))
    body = F.when(i % 5 == 2, failed).when(i % 5 == 3, "oops").otherwise(F.col("props"))
    return sources.classify_response(t.events.select("event_id", headers.alias("headers"), code.alias("status_code"), body.alias("body"))).select("event_id", "request_id", "outcome", "message")


@query("snk_export_txt", "SELECT job_id::BIGINT AS job_id, coalesce(CASE WHEN coalesce(reviewed_text, '') <> '' THEN reviewed_text ELSE transcript_text END, '') AS text FROM jobs")
def _(t: Inputs) -> DataFrame:
    path = scratch(t.spark)
    sources.export_txt(t.jobs, path, buckets=16)
    line = F.split("value", "\t", 2)
    return t.spark.read.text(path).select(line[0].cast("long").alias("job_id"), line[1].alias("text"))


@query("snk_export_json", """, l AS (SELECT job_id, string_agg(round(start_seconds, 2) || ':' || coalesce(speaker_label, '-') || ':' || text, '|' ORDER BY start_seconds, segment_id) AS segs, count(*) AS n FROM segments GROUP BY job_id)
 SELECT j.job_id, status, CASE WHEN coalesce(reviewed_text, '') <> '' THEN reviewed_text ELSE transcript_text END AS text, coalesce(n, 0) AS n, segs FROM jobs j LEFT JOIN l USING (job_id)""")
def _(t: Inputs) -> DataFrame:
    path = scratch(t.spark)
    sources.export_json(t.jobs, t.segments, path)
    shape = "struct<job_id:string,status:string,text:string,segments:array<struct<start:double,end:double,speaker:string,text:string>>>"
    d = t.spark.read.text(path).select(F.from_json("value", shape).alias("d")).select("d.*")
    one = F.transform("segments", lambda s: F.concat_ws(":", F.round(s["start"], 2), F.coalesce(s["speaker"], F.lit("-")), s["text"]))
    return d.select("job_id", "status", "text", F.size("segments").cast("long").alias("n"), F.when(F.size("segments") > 0, F.array_join(one, "|")).alias("segs"))


@query("snk_replace_segments", """, n AS (SELECT job_id, segment_id || '-new' AS segment_id FROM segments WHERE CAST(job_id AS BIGINT) % 10 = 0 AND chunk_index = 1)
 SELECT job_id, segment_id FROM segments WHERE job_id NOT IN (SELECT job_id FROM n) AND CAST(job_id AS BIGINT) % 25 <> 1 UNION ALL SELECT * FROM n""")
def _(t: Inputs) -> DataFrame:
    """A stored table: a first attempt of every job, a second one of some, twice, and one that has found nothing."""
    path, number = scratch(t.spark), F.col("job_id").cast("long")
    first = t.segments.select("job_id", F.lit(1).cast("long").alias("attempt"), "segment_id")
    again = t.segments.where((number % 10 == 0) & (F.col("chunk_index") == 1)).select("job_id", F.lit(2).cast("long").alias("attempt"), F.concat("segment_id", F.lit("-new")).alias("segment_id"))
    begun = t.segments.where(number % 25 == 1).select("job_id", F.lit(2).cast("long").alias("attempt"), F.lit(None).cast("string").alias("segment_id")).distinct()
    for rows in (first, again, again, begun):
        sources.store_segments(rows, path, 8)
    return sources.stored_segments(t.spark, path).select("job_id", "segment_id")


_LOCATION = "CASE WHEN NOT coalesce(r.active AND r.site_id = x.site_id, false) THEN 'classroom' WHEN NOT coalesce(c.active AND c.classroom_id = x.classroom_id, false) THEN 'camera' END"
_PLACES = "FROM recordings x LEFT JOIN classrooms r ON r.id = x.classroom_id LEFT JOIN cameras c ON c.id = x.camera_id"


@query("jon_location_guard", f"SELECT x.id, {_LOCATION} AS reject_reason {_PLACES}")
def _(t: Inputs) -> DataFrame:
    return guards.guard_location(t.recordings, t.classrooms, t.cameras).select("id", "reject_reason")


@query("snk_ingest_gate", f"SELECT x.id, coalesce({_LOCATION}, CASE WHEN x.duration_seconds < 100 THEN 'duration' WHEN NOT x.has_audio THEN 'audio' END) AS reject_reason {_PLACES}")
def _(t: Inputs) -> DataFrame:
    return _ingested(t).select("id", "reject_reason")


def _ingested(t: Inputs) -> DataFrame:
    probes = t.recordings.select("id", F.when(F.col("duration_seconds") >= 100, F.col("duration_seconds")).otherwise(0.0).alias("duration_seconds"), "has_audio")
    return guards.ingest_recordings(t.recordings.select("id", "site_id", "classroom_id", "camera_id"), probes, t.classrooms, t.cameras)


@query("snk_merge_state", """SELECT job_id, CASE WHEN CAST(job_id AS BIGINT) % 4 = 0 THEN 'MERGING' ELSE status END AS status, CASE WHEN CAST(job_id AS BIGINT) % 4 = 0 AND CAST(job_id AS BIGINT) % 8 <> 0 THEN 9 ELSE priority END AS priority,
 CASE WHEN CAST(job_id AS BIGINT) % 4 <> 0 THEN error_message END AS error_message FROM jobs""")
def _(t: Inputs) -> DataFrame:
    """Two updates of every fourth job: the second sets the error to null, and says nothing of every other one's priority."""
    j, names = F.col("job_id").cast("long"), F.array(*map(F.lit, ("status", "priority", "error_message")))

    def update(seq: int, status: str, priority: int, error: str | None, given: Column) -> DataFrame:
        return t.jobs.where(j % 4 == 0).select(
            "job_id", F.lit(seq).alias("seq"), F.lit(status).alias("status"), F.when(j % 8 != 0, priority).alias("priority"), F.lit(error).cast("string").alias("error_message"), given.alias("given")
        )

    first = update(1, "QUEUED", 8, "e", F.lit(None).cast("array<string>"))
    updates = update(2, "MERGING", 9, None, F.when(j % 8 == 0, F.array_remove(names, "priority")).otherwise(names)).union(first)
    updates = updates.union(updates.withColumn("job_id", F.concat(F.lit("x"), "job_id")))
    return state.merge_job_state(t.jobs.select("job_id", "status", "priority", "error_message"), updates, order=("seq",), given="given")


@query("sch_add_column", "SELECT job_id, coalesce(course_id, 'none') AS course_id, 'es' AS language FROM jobs")
def _(t: Inputs) -> DataFrame:
    df = state.ensure_column(t.jobs.select("job_id", "course_id"), "course_id", F.lit("none"))
    return state.ensure_column(state.ensure_column(df, "language", F.lit("es")), "language", F.lit("en"))


@query("sch_require_columns", "SELECT count(*) AS n FROM jobs")
def _(t: Inputs) -> DataFrame:
    return state.require_columns(t.jobs, {"job_id", "status"}).agg(F.count("*").alias("n"))


@query("sch_defaults", "SELECT job_id, 'Administrador' AS requested_by, coalesce(CASE WHEN priority > 4 THEN priority END, 5) AS priority, 'es' AS language, false AS cancel_requested FROM jobs")
def _(t: Inputs) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    rows = t.jobs.select("job_id", null("string").alias("requested_by"), F.when(F.col("priority") > 4, F.col("priority")).alias("priority"), null("string").alias("language"), null("boolean").alias("cancel_requested"))
    return state.with_defaults(rows, "transcription_jobs", F.lit("2024-01-01").cast("timestamp"))


# ---- projections and guards ----


@query("prj_validate", """SELECT 'professor' AS entity, id, CASE WHEN email = 'bad@' THEN 'email.form' ELSE '' END AS errors FROM professors UNION ALL SELECT 'camera', id, CASE WHEN source_type = 'tape' THEN 'source_type.enum' ELSE '' END FROM cameras UNION ALL
 SELECT 'classroom', id, CASE WHEN capacity < 1 OR capacity > 10000 THEN 'capacity.range' ELSE '' END FROM classrooms UNION ALL SELECT 'schedule', id, concat_ws(',', CASE WHEN end_time <= start_time THEN 'end_time.order' END, CASE WHEN valid_until < valid_from THEN 'valid_until.order' END) FROM schedules""")
def _(t: Inputs) -> DataFrame:
    one = lambda df, e: rules.validate(df, e).select(F.lit(e).alias("entity"), "id", F.array_join("errors", ",").alias("errors"))
    return one(t.professors, "professor").union(one(t.cameras, "camera")).union(one(t.classrooms, "classroom")).union(one(t.schedules, "schedule"))


@query("prj_validate_more", """SELECT 'site' AS entity, id, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'code.length' ELSE '' END AS errors FROM sites UNION ALL SELECT 'course', id, CASE WHEN CAST(id AS BIGINT) % 3 < 2 THEN 'name.length' ELSE '' END FROM courses
 UNION ALL SELECT 'assignment', event_id::VARCHAR, concat_ws(',', CASE WHEN classroom_id IS NULL THEN 'classroom_id.required' END, CASE WHEN event_id % 3 = 2 THEN 'notes.length' END) FROM assignments
 UNION ALL SELECT 'job', event_id::VARCHAR, concat_ws(',', CASE WHEN event_id % 13 = 0 THEN 'overlap_seconds.range' END, CASE WHEN event_id % 11 = 10 THEN 'priority.range' END, CASE WHEN @length <= 0 THEN 'class_ended_at.order' END, CASE WHEN event_id % 13 = 0 THEN 'overlap_seconds.order' END) FROM events
 UNION ALL SELECT 'review', job_id, CASE WHEN reviewed_text IS NULL THEN 'reviewed_text.required' WHEN reviewed_text = '' THEN 'reviewed_text.length' ELSE '' END FROM jobs""".replace("@length", "CASE WHEN event_id % 11 = 0 THEN 0 ELSE floor(value * 700)::INT END"))
def _(t: Inputs) -> DataFrame:
    one = lambda df, e: rules.validate(df, e).select(F.lit(e).alias("entity"), F.col("id").cast("string").alias("id"), F.array_join("errors", ",").alias("errors"))
    site = t.sites.withColumn("code", F.left("code", F.col("id").cast("int") % 2 + 1))
    course = t.courses.withColumn("name", F.left("name", F.col("id").cast("int") % 3))
    assignment = t.assignments.select(F.col("event_id").alias("id"), "camera_id", "classroom_id", F.repeat(F.lit("x"), (F.col("event_id") % 3 + 299).cast("int")).alias("notes"))
    job = _requests(t).withColumns({"id": F.col("request_id"), "priority": F.col("request_id") % 11})
    review = t.jobs.select(F.col("job_id").alias("id"), "reviewed_text")
    return one(site, "site").union(one(course, "course")).union(one(assignment, "assignment")).union(one(job, "job")).union(one(review, "review"))


@query("prj_active_only", "SELECT id, code FROM cameras WHERE active")
def _(t: Inputs) -> DataFrame:
    return state.active(t.cameras).select("id", "code")


@query("prj_deactivate", "SELECT id, active AND NOT coalesce(CAST(id AS BIGINT) IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0), false) AS active FROM professors")
def _(t: Inputs) -> DataFrame:
    gone = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_custkey").cast("string").alias("id"))
    return state.deactivate(t.professors, gone).select("id", "active")


@query("prj_status_in", f"SELECT 'active' AS name, job_id FROM jobs WHERE status IN {ACTIVE} UNION ALL SELECT 'queueable', job_id FROM jobs WHERE status IN {QUEUEABLE} UNION ALL SELECT 'reviewable', job_id FROM jobs WHERE status IN ('READY_FOR_REVIEW', 'APPROVED') UNION ALL SELECT 'cancellable', job_id FROM jobs WHERE status IN {ACTIVE} UNION ALL SELECT 'terminal', job_id FROM jobs WHERE status IN ('READY_FOR_REVIEW', 'APPROVED', 'CANCELLED', 'ERROR')")
def _(t: Inputs) -> DataFrame:
    one = lambda name: state.status_in(t.jobs, name).select(F.lit(name).alias("name"), "job_id")
    return one("active").union(one("queueable")).union(one("reviewable")).union(one("cancellable")).union(one("terminal"))


@query("prj_public_views", "SELECT job_id, schedule_id, requested_by, status, priority, provider_name, model_name, error_message FROM jobs")
def _(t: Inputs) -> DataFrame:
    view = state.public_view(t.jobs, "transcription_jobs")
    return view.select(*(c for c in ("job_id", "schedule_id", "requested_by", "status", "priority", "provider_name", "model_name", "error_message", "transcript_text") if c in view.columns))


@query("prj_patch", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'N' || id ELSE name END AS name, CASE WHEN CAST(id AS BIGINT) % 6 = 0 THEN NULL ELSE classroom_id END AS classroom_id, CASE WHEN CAST(id AS BIGINT) % 9 = 0 THEN false ELSE active END AS active FROM cameras")
def _(t: Inputs) -> DataFrame:
    i, text = F.col("id").cast("long"), lambda c: F.lit(c).cast("string")
    patch = F.create_map(text("name"), F.concat(F.lit("N"), "id"))
    patch = F.when(i % 6 == 0, F.map_concat(patch, F.create_map(text("classroom_id"), text(None)))).otherwise(patch)
    patch = F.when(i % 9 == 0, F.map_concat(patch, F.create_map(text("active"), text("false")))).otherwise(patch)
    patches = t.cameras.where(i % 3 == 0).select("id", patch.alias("patch"), F.lit(2).alias("seq"))
    before = t.cameras.where(i % 9 == 0).select("id", F.create_map(text("name"), text("older"), text("active"), text("true")).alias("patch"), F.lit(1).alias("seq"))
    return state.apply_patch(t.cameras, before.union(patches), order=("seq",)).select("id", "name", "classroom_id", "active")


def _requests(t: Inputs) -> DataFrame:
    i = F.col("request_id")
    shift = F.when(i % 7 == 0, -60).otherwise(F.floor(F.col("value") * 100)).cast("int")
    start = F.timestamp_add("SECOND", shift, F.col("class_started_at"))
    end = F.timestamp_add("SECOND", F.floor(F.col("value") * 700).cast("int"), start)
    return t.requests.select(
        "request_id", "recording_id", start.alias("class_started_at"), F.when(i % 11 == 0, start).otherwise(end).alias("class_ended_at"), F.col("class_started_at").alias("recording_started_at"), (F.col("value") * 750).alias("duration_seconds"),
        F.when(i % 5 == 0, "huge").otherwise("large-v3").alias("model_name"), F.lit(300).alias("chunk_seconds"), F.when(i % 13 == 0, 300).otherwise(3).alias("overlap_seconds"),
    )


_SHIFT = "CASE WHEN event_id % 7 = 0 THEN -60 ELSE floor(value * 100)::INT END"
_LENGTH = "CASE WHEN event_id % 11 = 0 THEN 0 ELSE floor(value * 700)::INT END"


@query("prj_offsets", f"SELECT event_id AS request_id, ({_SHIFT})::DOUBLE AS offset_start_seconds, ({_SHIFT} + {_LENGTH})::DOUBLE AS offset_end_seconds FROM events")
def _(t: Inputs) -> DataFrame:
    return guards.with_offsets(_requests(t)).select("request_id", "offset_start_seconds", "offset_end_seconds")


@query("prj_interval_guard", f"SELECT event_id AS request_id, CASE WHEN {_SHIFT} < 0 THEN 'starts before the recording' WHEN {_SHIFT} + {_LENGTH} > value * 750 THEN 'ends after the recording' END AS reject_reason FROM events")
def _(t: Inputs) -> DataFrame:
    return guards.guard_interval(_requests(t)).select("request_id", "reject_reason")


@query("prj_job_guard", f"SELECT event_id AS request_id, CASE WHEN {_LENGTH} <= 0 THEN 'interval' WHEN event_id % 13 = 0 THEN 'overlap' WHEN event_id % 5 = 0 THEN 'model' END AS reject_reason FROM events")
def _(t: Inputs) -> DataFrame:
    return guards.guard_job(_requests(t)).select("request_id", "reject_reason")


@query("prj_schedule_guard", "SELECT id, CASE WHEN end_time <= start_time THEN 'time' WHEN valid_until < valid_from THEN 'validity' END AS reject_reason FROM schedules")
def _(t: Inputs) -> DataFrame:
    return guards.guard_schedule(t.schedules).select("id", "reject_reason")


@query("prj_schedule_patch", "SELECT id, CASE WHEN end_time <= CASE WHEN CAST(id AS BIGINT) % 8 = 0 THEN 50000 ELSE start_time END THEN 'time' END AS reject_reason FROM schedules WHERE CAST(id AS BIGINT) % 4 = 0")
def _(t: Inputs) -> DataFrame:
    i = F.col("id").cast("long")
    patch = t.schedules.where(i % 4 == 0).select("id", F.when(i % 8 == 0, 50000).alias("start_time"), F.lit(None).cast("int").alias("end_time"))
    return guards.patched_schedule_guard(t.schedules, patch).select("id", "reject_reason")


_STRATEGY = "SELECT job_id, CASE WHEN provider_name <> 'together' THEN 'local_chunks' WHEN clip_seconds <= 13500 AND audio_bytes / 1048576.0 <= 450 THEN 'together_single_request' ELSE 'together_adaptive_chunks' END AS chunk_strategy, CASE WHEN provider_name = 'together' THEN 3600 ELSE chunk_seconds END AS c, CASE WHEN provider_name = 'together' THEN 2 ELSE overlap_seconds END AS o, clip_seconds AS d FROM jobs"


@query("prj_chunk_strategy", f"SELECT job_id, chunk_strategy, c AS chunk_seconds, o AS overlap_seconds FROM ({_STRATEGY})")
def _(t: Inputs) -> DataFrame:
    return planner.chunk_strategy(t.jobs).select("job_id", "chunk_strategy", "chunk_seconds", "overlap_seconds")


_PLAN = f""", s AS ({_STRATEGY}), n AS (SELECT *, CASE WHEN chunk_strategy = 'together_single_request' THEN 0 ELSE greatest(0, ceil((d - c - greatest(30.0, 2 * o)) / (c - o)))::BIGINT END AS last FROM s WHERE d > 0),
 p AS (SELECT *, unnest(range(0, last + 1)) AS index FROM n), pl AS (SELECT job_id, index, (index * (c - o))::DOUBLE AS start_seconds, CASE WHEN index < last THEN c::DOUBLE ELSE d - index * (c - o) END AS duration_seconds FROM p)"""


@query("win_chunk_plan", f"{_PLAN} SELECT job_id, index, round(start_seconds, 3) AS start_seconds, round(duration_seconds, 3) AS duration_seconds FROM pl")
def _(t: Inputs) -> DataFrame:
    plans = planner.plan_chunks(planner.chunk_strategy(t.jobs))
    return plans.select("job_id", "index", F.round("start_seconds", 3).alias("start_seconds"), F.round("duration_seconds", 3).alias("duration_seconds"))


@query("src_manifest_explode", f"{_PLAN} SELECT job_id, index::INT AS index, printf('chunk_%05d.%s', index, CASE WHEN provider_name = 'together' THEN 'flac' ELSE 'wav' END) AS path, NULL AS error FROM pl JOIN jobs USING (job_id) WHERE CAST(job_id AS BIGINT) % 5 <> 0 UNION ALL SELECT job_id, NULL, NULL, 'empty manifest' FROM jobs WHERE CAST(job_id AS BIGINT) % 5 = 0")
def _(t: Inputs) -> DataFrame:
    made = planner.manifests(planner.plan_chunks(planner.chunk_strategy(t.jobs.where("cast(job_id as bigint) % 5 <> 0"))))
    jobs = t.jobs.select("job_id").join(made, "job_id", "left")
    return planner.explode_manifest(jobs).select("job_id", "index", "path", "error")


@query("prj_blank_segments", f"SELECT segment_id, {norm('text')} AS text FROM segments WHERE {norm('text')} <> ''")
def _(t: Inputs) -> DataFrame:
    return stitch.nonblank(t.segments).select("segment_id", "text")


@query("prj_speaker_prefix", "SELECT segment_id, CASE WHEN provider_name = 'together' AND coalesce(speaker_label, '') <> '' THEN printf('CHUNK_%02d_%s', chunk_index + 1, speaker_label) ELSE speaker_label END AS speaker_label FROM segments JOIN jobs USING (job_id)")
def _(t: Inputs) -> DataFrame:
    rows = t.segments.join(t.jobs.select("job_id", "provider_name", "total_chunks"), "job_id")
    return stitch.namespace_speaker(rows).select("segment_id", "speaker_label")


@query("prj_absolute_times", "SELECT segment_id, chunk_start + start_seconds AS start_seconds, chunk_start + end_seconds AS end_seconds FROM segments")
def _(t: Inputs) -> DataFrame:
    return stitch.absolutise(t.segments).select("segment_id", "start_seconds", "end_seconds")


@query("prj_review", "SELECT job_id, CASE WHEN CAST(job_id AS BIGINT) % 4 = 0 AND transcript_text <> '' THEN 'new' ELSE reviewed_text END AS reviewed_text, CASE WHEN CAST(job_id AS BIGINT) % 4 = 0 AND transcript_text <> '' THEN CASE WHEN CAST(job_id AS BIGINT) % 3 = 0 THEN 'APPROVED' ELSE 'READY_FOR_REVIEW' END ELSE status END AS status, CASE WHEN CAST(job_id AS BIGINT) % 4 = 0 THEN CASE WHEN transcript_text <> '' THEN 'reviewed' ELSE 'no transcript' END END AS outcome FROM jobs")
def _(t: Inputs) -> DataFrame:
    reviews = t.jobs.where("cast(job_id as bigint) % 4 = 0").select("job_id", F.lit("new").alias("reviewed_text"), (F.col("job_id").cast("long") % 3 == 0).alias("approve"), F.lit(2).alias("seq"))
    before = reviews.where("cast(job_id as bigint) % 8 = 0").select("job_id", F.lit("older").alias("reviewed_text"), (~F.col("approve")).alias("approve"), F.lit(1).alias("seq"))
    return state.apply_reviews(t.jobs, before.union(reviews), ("seq",)).select("job_id", "reviewed_text", "status", "outcome")


@query("prj_cancel", f"SELECT job_id, CASE WHEN CAST(job_id AS BIGINT) % 5 = 0 AND status IN {ACTIVE} THEN 'CANCEL_REQUESTED' ELSE status END AS status, cancel_requested OR (CAST(job_id AS BIGINT) % 5 = 0 AND status IN {ACTIVE}) AS cancel_requested, CASE WHEN CAST(job_id AS BIGINT) % 5 = 0 THEN CASE WHEN status IN {ACTIVE} THEN 'cancelling' ELSE 'conflict' END END AS outcome FROM jobs")
def _(t: Inputs) -> DataFrame:
    return state.apply_cancels(t.jobs, t.jobs.where("cast(job_id as bigint) % 5 = 0")).select("job_id", "status", "cancel_requested", "outcome")


# ---- joins ----


@query("jon_fk_guard", "SELECT job_id, schedule_id FROM jobs WHERE schedule_id NOT IN (SELECT id FROM schedules)")
def _(t: Inputs) -> DataFrame:
    return guards.fk_violations(t.jobs.select("job_id", "schedule_id"), t.schedules, "schedule_id")


@query("jon_job_enrich", """SELECT job_id, CASE WHEN j.professor_id <> '' THEN j.professor_id ELSE s.professor_id END AS professor_id, coalesce(j.course_id, s.course_id) AS course_id,
 CASE WHEN r.id IS NULL THEN 'recording' WHEN j.schedule_id <> '' AND NOT coalesce(s.active, false) THEN 'schedule' WHEN j.schedule_id <> '' AND s.classroom_id <> r.classroom_id THEN 'schedule classroom' END AS reject_reason FROM jobs j LEFT JOIN recordings r ON r.id = j.recording_id LEFT JOIN schedules s ON s.id = j.schedule_id""")
def _(t: Inputs) -> DataFrame:
    requests = t.jobs.select("job_id", "recording_id", "schedule_id", "professor_id", "course_id")
    return guards.enrich_jobs(requests, t.recordings, t.schedules).select("job_id", "professor_id", "course_id", "reject_reason")


def _interval_sql(days: str, where: str) -> str:
    """Rooms lie in two zones; all recordings are of January, when these are one hour ahead of UTC and five behind."""
    at = "date_diff('microsecond', local_start, day::TIMESTAMP + to_seconds({0}))"
    second = f"({at} / 1000000.0)"
    return f""", z AS (SELECT *, recording_started_at + CASE WHEN CAST(classroom_id AS INT) % 2 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL (-5) HOUR END AS local_start FROM recordings), r AS (SELECT *, {days} AS day FROM z),
 x AS (SELECT r.id AS recording_id, s.id AS schedule_id, day, greatest(0.0, {second.format('start_time')})::DOUBLE AS a, least(duration_seconds, {second.format('end_time')})::DOUBLE AS b FROM r JOIN schedules s ON s.classroom_id = r.classroom_id WHERE s.active {where})
 SELECT recording_id, schedule_id, strftime(day, '%Y-%m-%d') AS day, a AS offset_start_seconds, b AS offset_end_seconds FROM x WHERE b > a"""


def _proposed(t: Inputs, mode: str) -> DataFrame:
    zone = F.when(F.col("classroom_id").cast("int") % 2 == 0, "Europe/Madrid").otherwise("America/Bogota")
    out = schedules.propose_intervals(t.recordings.withColumn("zone", zone), t.schedules, "UTC", mode, "zone")
    return out.select("recording_id", "schedule_id", F.col("day").cast("string").alias("day"), "offset_start_seconds", "offset_end_seconds")


@query("jon_schedule_interval", _interval_sql("local_start::DATE", ""))
def _(t: Inputs) -> DataFrame:
    return _proposed(t, "same_day")


@query("jon_schedule_calendar", _interval_sql("unnest(generate_series(local_start::DATE, (local_start + to_microseconds(ceil(duration_seconds * 1000000)::BIGINT))::DATE, INTERVAL 1 DAY))::DATE", "AND day_of_week = isodow(day) - 1 AND (valid_from IS NULL OR day >= valid_from) AND (valid_until IS NULL OR day <= valid_until)"))
def _(t: Inputs) -> DataFrame:
    return _proposed(t, "calendar")


@query("jon_active_duplicate", f""", k AS (SELECT l_orderkey * 100000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS request_id, l_orderkey AS r, l_quantity::INT % 3 AS q FROM lineitem),
 h AS (SELECT CAST(job_id AS BIGINT) AS r FROM jobs WHERE status IN {ACTIVE} GROUP BY 1) SELECT request_id, coalesce(h.r IS NOT NULL AND q = 0, false) OR row_number() OVER (PARTITION BY k.r, q ORDER BY request_id) > 1 AS duplicate FROM k LEFT JOIN h ON h.r = k.r""")
def _(t: Inputs) -> DataFrame:
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    at = lambda q: F.timestamp_add("HOUR", q, F.lit("2024-01-01").cast("timestamp"))
    q = F.col("l_quantity").cast("int") % 3
    requests = t.lineitem.select((F.col("l_orderkey") * 100000 + nth).alias("request_id"), F.col("l_orderkey").cast("string").alias("recording_id"), at(q).alias("class_started_at"), at(q + 1).alias("class_ended_at"))
    held = t.jobs.select(F.col("job_id").alias("recording_id"), "status", at(F.lit(0)).alias("class_started_at"), at(F.lit(1)).alias("class_ended_at"))
    return guards.reject_duplicates(requests, held).select("request_id", "duplicate")


@query("jon_job_segments", ", l AS (SELECT job_id, count(*) AS n, string_agg(segment_id, ',' ORDER BY start_seconds, end_seconds, segment_id) AS ids FROM segments GROUP BY job_id) SELECT job_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids FROM jobs LEFT JOIN l USING (job_id)")
def _(t: Inputs) -> DataFrame:
    rows = stitch.jobs_with_segments(t.jobs.select("job_id"), t.segments)
    return rows.select("job_id", F.size("segments").cast("long").alias("n"), F.array_join(F.transform("segments", lambda s: s["segment_id"]), ",").alias("ids"))


@query("jon_vocabulary", "SELECT job_id, coalesce(array_to_string(vocabulary, '|'), '') AS vocabulary FROM jobs LEFT JOIN courses ON courses.id = course_id")
def _(t: Inputs) -> DataFrame:
    return views.with_vocabulary(t.jobs, t.courses).select("job_id", F.array_join("vocabulary", "|").alias("vocabulary"))


@query("jon_display_names", "SELECT x.id, coalesce(s.name, '—') AS site_name, coalesce(r.name, 'Sin asignar') AS classroom_name, coalesce(c.name, '—') AS camera_name FROM recordings x LEFT JOIN sites s ON s.id = x.site_id LEFT JOIN classrooms r ON r.id = x.classroom_id LEFT JOIN cameras c ON c.id = x.camera_id")
def _(t: Inputs) -> DataFrame:
    return views.display_names(t.recordings, t.sites, t.classrooms, t.cameras).select("id", "site_name", "classroom_name", "camera_name")


@query("jon_site_hierarchy", "SELECT s.name AS site_name, r.name AS classroom_name, c.name AS camera_name FROM sites s JOIN classrooms r ON r.site_id = s.id JOIN cameras c ON c.classroom_id = r.id WHERE s.active AND r.active AND c.active")
def _(t: Inputs) -> DataFrame:
    return views.location_tree(t.sites, t.classrooms, t.cameras).select("site_name", "classroom_name", "camera_name")


_HISTORY = ", hi AS (SELECT *, lead(started_at) OVER (PARTITION BY camera_id ORDER BY started_at, event_id) AS ended_at FROM assignments)"


@query("jon_assignment_asof", f"{_HISTORY} SELECT r.id, h.classroom_id AS asof_classroom FROM recordings r LEFT JOIN hi h ON h.camera_id = r.camera_id AND h.classroom_id IS NOT NULL AND h.started_at <= r.recording_started_at AND (h.ended_at IS NULL OR r.recording_started_at < h.ended_at)")
def _(t: Inputs) -> DataFrame:
    return history.asof_classroom(t.recordings, history.assignment_history(t.assignments)).select("id", "asof_classroom")


@query("jon_assignment_drift", f"{_HISTORY} SELECT coalesce(c.id, h.camera_id) AS id, c.classroom_id AS current, h.classroom_id AS assigned FROM cameras c FULL JOIN (SELECT * FROM hi WHERE ended_at IS NULL AND classroom_id IS NOT NULL) h ON h.camera_id = c.id WHERE c.classroom_id IS DISTINCT FROM h.classroom_id")
def _(t: Inputs) -> DataFrame:
    return history.assignment_drift(t.cameras, history.assignment_history(t.assignments))


# ---- aggregations ----


@query("agg_queue_position", f"SELECT job_id, CASE WHEN status IN {QUEUEABLE} THEN 1 + (SELECT count(*) FROM jobs b WHERE b.status IN {ACTIVE} AND b.created_at < a.created_at) END AS queue_position FROM jobs a")
def _(t: Inputs) -> DataFrame:
    return state.queue_position(t.jobs).select("job_id", "queue_position")


@query("agg_progress", ", d AS (SELECT job_id, count(DISTINCT chunk_index) AS n FROM segments GROUP BY job_id) SELECT job_id, coalesce(n, 0) AS completed_chunks, CASE status WHEN 'TRANSCRIBING' THEN least(92, 22 + floor(70.0 * coalesce(n, 0) / total_chunks)::BIGINT) WHEN 'PENDING' THEN 0 WHEN 'VALIDATING' THEN 3 WHEN 'READY_FOR_REVIEW' THEN 100 WHEN 'ERROR' THEN 0 END::BIGINT AS progress FROM jobs LEFT JOIN d USING (job_id)")
def _(t: Inputs) -> DataFrame:
    return state.progress(t.segments.select("job_id", "chunk_index"), t.jobs.select("job_id", "status", "total_chunks")).select("job_id", "completed_chunks", "progress")


@query("win_overlap_dedup", f"{CHUNKS} SELECT job_id, chunk_index::INT AS chunk_index, removed_words, md5(clean_text) AS clean FROM cl")
def _(t: Inputs) -> DataFrame:
    return stitch.dedup_overlap(t.chunks()).select("job_id", "chunk_index", "removed_words", F.md5("clean_text").alias("clean"))


_MERGED = f"{CHUNKS}, mt AS (SELECT job_id, count(*) AS chunks, sum(removed_words)::BIGINT AS removed_words, coalesce(string_agg(clean_text, chr(10) || chr(10) ORDER BY chunk_index) FILTER (WHERE clean_text <> ''), '') AS text FROM cl GROUP BY job_id)"


@query("agg_merge_transcript", f"{_MERGED} SELECT job_id, chunks, removed_words, md5(text) AS text FROM mt")
def stitched(t: Inputs) -> DataFrame:
    """Documents cut into overlapping chunks, stitched again: one text each, with counts of chunks and removed words."""
    clean = stitch.dedup_overlap(t.chunks())
    counts = F.count("*").alias("chunks"), F.sum("removed_words").alias("removed_words")
    return stitch.merge_transcript(clean, "clean_text", *counts).select("job_id", "chunks", "removed_words", F.md5("transcript_text").alias("text"))


@query("agg_rtf", "SELECT job_id, CASE WHEN clip_seconds > 9000 THEN NULL WHEN clip_seconds > 0 THEN processing_seconds / clip_seconds END AS rtf FROM jobs")
def _(t: Inputs) -> DataFrame:
    return t.jobs.withColumn("clip_seconds", F.when(F.col("clip_seconds") > 9000, 0.0).otherwise(F.col("clip_seconds"))).select("job_id", state.real_time_factor().alias("rtf"))


@query("agg_metrics_doc", """, s AS (%s) SELECT job_id, s.chunk_strategy, round_even(audio_bytes / 1048576.0::DOUBLE, 3) AS prepared_audio_mb, provider_name AS provider, r.duration_seconds AS recording_duration_seconds, CASE WHEN provider_name = 'local' THEN 2 END AS batch_size FROM jobs j JOIN s USING (job_id) LEFT JOIN recordings r ON r.id = j.recording_id""" % _STRATEGY)
def _(t: Inputs) -> DataFrame:
    jobs = planner.chunk_strategy(t.jobs).withColumns({"selected_interval_seconds": F.col("clip_seconds"), "provider_model": F.lit("m"), "language_probability": F.lit(None).cast("double")})
    docs = state.metrics_doc(jobs, t.recordings)
    return docs.select("job_id", "metrics.chunk_strategy", "metrics.prepared_audio_mb", "metrics.provider", "metrics.recording_duration_seconds", "metrics.batch_size")


@query("agg_metrics_overlay", """SELECT job_id, CASE WHEN priority > 3 THEN 'prepared' END AS chunk_strategy, CASE WHEN priority > 3 THEN audio_bytes::DOUBLE END AS prepared_audio_mb, CASE WHEN priority > 3 THEN 7.0::DOUBLE END AS selected_interval_seconds, provider_name AS provider, 'm' AS provider_model,
 CASE WHEN priority > 5 THEN 0.5::DOUBLE END AS language_probability, clip_seconds AS clip_duration_seconds, r.duration_seconds AS recording_duration_seconds, total_chunks AS chunks, CASE WHEN provider_name = 'local' THEN 2 END AS batch_size, CASE WHEN provider_name = 'local' THEN 3 END AS beam_size FROM jobs j LEFT JOIN recordings r ON r.id = j.recording_id""")
def _(t: Inputs) -> DataFrame:
    said = F.struct(F.lit("prepared").alias("chunk_strategy"), F.col("audio_bytes").cast("double").alias("prepared_audio_mb"), F.lit(7.0).alias("selected_interval_seconds"), F.lit("stale").alias("provider"), F.lit(9).alias("batch_size"))
    jobs = t.jobs.withColumns({"metrics": F.when(F.col("priority") > 3, said), "provider_model": F.lit("m"), "language_probability": F.when(F.col("priority") > 5, 0.5)})
    return state.metrics_doc(jobs, t.recordings).select("job_id", "metrics.*")


@query("agg_chunk_text", f"SELECT job_id, chunk_index, {norm('t')} AS text FROM (SELECT job_id, chunk_index, string_agg(text, ' ' ORDER BY position, text) AS t FROM segments GROUP BY ALL)")
def _(t: Inputs) -> DataFrame:
    return stitch.chunk_text(t.segments)


@query("agg_last_runtime", "SELECT DISTINCT ON (conv_id) conv_id::VARCHAR AS job_id, role AS device, 'c' || turn AS compute_type FROM conversations ORDER BY conv_id, turn DESC")
def _(t: Inputs) -> DataFrame:
    chunks = t.turns.select("job_id", "chunk_index", F.col("speaker_label").alias("device"), F.concat(F.lit("c"), "chunk_index").alias("compute_type"), F.lit(None).cast("double").alias("language_probability"), F.lit("m").alias("provider_model"))
    return state.last_runtime(chunks).select("job_id", "device", "compute_type")


@query("agg_benchmark", "SELECT model_name, provider_name AS device_used, count(*) AS jobs, round(sum(clip_seconds), 2) AS selected_seconds, round(sum(prepare_seconds + processing_seconds), 2) AS total_seconds, round(avg(processing_seconds / clip_seconds), 6) AS mean_rtf FROM jobs GROUP BY ALL")
def _(t: Inputs) -> DataFrame:
    out = metrics.benchmark(t.jobs.withColumns({"device_used": F.col("provider_name"), "compute_type_used": F.lit("int8")}))
    return out.select("model_name", "device_used", "jobs", F.round("selected_seconds", 2).alias("selected_seconds"), F.round("total_seconds", 2).alias("total_seconds"), F.round("mean_rtf", 6).alias("mean_rtf"))


@query("agg_wait_time", "SELECT strftime(created_at, '%Y-%m-%d') AS day, provider_name, count(*) AS jobs, round(avg(floor(prepare_seconds)), 4) AS mean_wait, max(floor(prepare_seconds)) AS max_wait, round(avg(floor(processing_seconds)), 4) AS mean_run FROM jobs GROUP BY ALL")
def _(t: Inputs) -> DataFrame:
    later = lambda c, s: F.timestamp_add("SECOND", F.floor(s).cast("int"), F.col(c))
    rows = t.jobs.withColumn("started_at", later("created_at", "prepare_seconds"))
    rows = rows.withColumn("completed_at", later("started_at", "processing_seconds"))
    return metrics.wait_stats(rows).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "provider_name", "jobs", F.round("mean_wait", 4).alias("mean_wait"), "max_wait", F.round("mean_run", 4).alias("mean_run"))


def _timed(t: Inputs) -> DataFrame:
    later = lambda c, s: F.timestamp_add("SECOND", F.floor(s).cast("int"), F.col(c))
    rows = t.jobs.withColumn("started_at", F.when(F.col("priority") < 8, later("created_at", "prepare_seconds")))
    return rows.withColumn("completed_at", later("started_at", "processing_seconds"))


_MEASURES = ", tm AS (SELECT *, CASE WHEN priority < 8 THEN floor(prepare_seconds) END AS wait, CASE WHEN priority < 8 THEN floor(processing_seconds) END AS run, processing_seconds / clip_seconds AS rtf FROM jobs)"
_QUANTILES = ", ".join(f"count({n}) AS {n}_n, round(quantile_disc({n}, 0.5), 9)::DOUBLE AS {n}_p50, round(quantile_disc({n}, 0.95), 9)::DOUBLE AS {n}_p95" for n in metrics.MEASURES)


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in df.columns if c.endswith(("_p50", "_p95"))})


@query("agg_quantiles", f"{_MEASURES} SELECT strftime(created_at, '%Y-%m-%d') AS day, provider_name, model_name, count(*) AS jobs, {_QUANTILES} FROM tm GROUP BY ALL")
def _(t: Inputs) -> DataFrame:
    return _rounded(metrics.counted_quantiles(metrics.quantile_counts(_timed(t)), "day", "provider_name", "model_name")).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("agg_quantiles_weekly", f"{_MEASURES}, wk AS (SELECT *, strftime(date_trunc('week', created_at), '%Y-%m-%d') AS week FROM tm) SELECT week, provider_name, count(*) AS jobs, {_QUANTILES} FROM wk GROUP BY week, provider_name")
def _(t: Inputs) -> DataFrame:
    """Weeks from stored days: counts of values are written, read again and added up. A sketch, which is exact for 1,024 values at most, would not do."""
    path = scratch(t.spark)
    metrics.quantile_counts(_timed(t)).write.parquet(path)
    week = F.date_format(F.date_trunc("week", "day"), "yyyy-MM-dd").alias("week")
    return _rounded(metrics.counted_quantiles(t.spark.read.parquet(path), week, "provider_name"))


@query("agg_wer", "SELECT source, sum(n // 10)::BIGINT AS edits, sum(n)::BIGINT AS reference_words, sum(n // 10)::DOUBLE / nullif(sum(n), 0) AS wer FROM (SELECT source, len(list_filter(string_split(%s, ' '), lambda y: y <> ''))::BIGINT AS n FROM documents) GROUP BY source" % norm("text"))
def _(t: Inputs) -> DataFrame:
    """Every tenth word goes unheard. Each such word costs one edit and no alignment costs less than the difference in length, so SQL can count them."""
    w = fn.words("text")
    heard = F.array_join(F.filter(w, lambda x, i: (i + 1) % 10 != 0), " ")
    rows = spread(t.documents.select("source", "text")).select("source", "text", heard.alias("heard"))
    return metrics.wer(rows, "text", "heard", ["source"]).select("source", "edits", "reference_words", "wer")


@query("agg_rtf_distribution", """, r AS (SELECT *, processing_seconds / (clip_seconds * (priority + 1) / 10) AS r FROM jobs) SELECT strftime(created_at, '%Y-%m-%d') AS day, provider_name, floor(r / 0.1::DOUBLE)::BIGINT AS bin, count(*) AS jobs, round(min(r), 6) AS least, round(max(r), 6) AS greatest FROM r GROUP BY ALL""")
def _(t: Inputs) -> DataFrame:
    out = metrics.rtf_distribution(t.jobs.withColumn("clip_seconds", F.col("clip_seconds") * (F.col("priority") + 1) / 10))
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "provider_name", "bin", "jobs", F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"))


@query("agg_failures", "SELECT strftime(created_at, '%Y-%m-%d') AS day, provider_name, count(*) AS failures, min(error_message) AS first_error FROM jobs WHERE status = 'ERROR' GROUP BY ALL")
def _(t: Inputs) -> DataFrame:
    return metrics.failure_stats(t.jobs).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("agg_user_load", f"SELECT requested_by, count(*) AS active_jobs FROM jobs WHERE status IN {ACTIVE} GROUP BY 1 HAVING count(*) > 20")
def _(t: Inputs) -> DataFrame:
    return metrics.user_load(t.jobs, 20)


@query("agg_retention", f"SELECT id FROM recordings WHERE created_at < TIMESTAMP '2024-01-31' - INTERVAL 20 DAY AND id NOT IN (SELECT recording_id FROM jobs WHERE status IN {ACTIVE})")
def _(t: Inputs) -> DataFrame:
    return metrics.retention_candidates(t.recordings, t.jobs, 20, F.lit("2024-01-31").cast("timestamp")).select("id")


@query("agg_stale_work_dirs", "SELECT job_id FROM jobs WHERE status IN ('READY_FOR_REVIEW', 'APPROVED', 'CANCELLED', 'ERROR') AND priority > 2 AND created_at < TIMESTAMP '1997-01-01' - INTERVAL 30 DAY")
def _(t: Inputs) -> DataFrame:
    jobs = t.jobs.withColumns({"completed_at": F.col("created_at"), "work_dir": F.when(F.col("priority") > 2, F.concat(F.lit("/work/"), "job_id")).when(F.col("priority") > 1, "")})
    return metrics.stale_work_dirs(jobs, 30, F.lit("1997-01-01").cast("timestamp")).select("job_id")


@query("agg_storage_usage", "SELECT site_id, classroom_id, camera_id, sum(file_size_bytes)::BIGINT AS bytes, round(sum(duration_seconds) / 3600, 4) AS hours, count(*) AS recordings FROM recordings GROUP BY ROLLUP (site_id, classroom_id, camera_id)")
def _(t: Inputs) -> DataFrame:
    return metrics.storage_usage(t.recordings).withColumn("hours", F.round("hours", 4))


# ---- windows ----


@query("win_highwater", """, o AS (SELECT job_id, segment_id, end_seconds, row_number() OVER (PARTITION BY job_id ORDER BY chunk_index, position, segment_id) AS k FROM segments),
 f AS (SELECT job_id, list_reduce(list_prepend({'last': -1.0::DOUBLE, 'ids': []::VARCHAR[]}, list({'last': end_seconds, 'ids': [segment_id]} ORDER BY k)), lambda a, x: CASE WHEN x.last > a.last + 0.05 THEN {'last': greatest(a.last, x.last), 'ids': a.ids || x.ids} ELSE a END) AS r FROM o GROUP BY job_id)
 SELECT job_id, unnest(r.ids) AS segment_id FROM f""")
def _(t: Inputs) -> DataFrame:
    return stitch.highwater(t.segments.select("job_id", "segment_id", "chunk_index", "position", "end_seconds"), ("chunk_index", "position", "segment_id")).select("job_id", "segment_id")


@query("win_assignment_scd2", f"{_HISTORY} SELECT event_id, camera_id, classroom_id, epoch_us(started_at)::VARCHAR AS started, epoch_us(ended_at)::VARCHAR AS ended, ended_at IS NULL AS active FROM hi WHERE classroom_id IS NOT NULL")
def _(t: Inputs) -> DataFrame:
    return history.assignment_history(t.assignments).select("event_id", "camera_id", "classroom_id", F.unix_micros("started_at").cast("string").alias("started"), F.unix_micros("ended_at").cast("string").alias("ended"), "active")


@query("win_assignment_close", f"""{_HISTORY}, cl AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN started_at + INTERVAL 1 HOUR END AS closed_at FROM hi WHERE classroom_id IS NOT NULL)
 SELECT event_id, epoch_us(CASE WHEN closed_at < coalesce(ended_at, closed_at + INTERVAL 1 HOUR) THEN closed_at ELSE ended_at END)::VARCHAR AS ended, ended_at IS NULL AND closed_at IS NULL AS active FROM cl""")
def _(t: Inputs) -> DataFrame:
    closes = t.assignments.where("event_id % 7 = 0").select("event_id", F.timestamp_add("HOUR", F.lit(1), F.col("started_at")).alias("closed_at"))
    out = history.close_assignments(history.assignment_history(t.assignments), closes)
    return out.select("event_id", F.unix_micros("ended_at").cast("string").alias("ended"), "active")


@query("win_assignment_clear", ", cl AS (SELECT DISTINCT camera_id, classroom_id FROM assignments WHERE event_id % 7 = 0) SELECT c.id, CASE WHEN cl.camera_id IS NULL THEN c.classroom_id END AS classroom_id FROM cameras c LEFT JOIN cl ON cl.camera_id = c.id AND cl.classroom_id = c.classroom_id")
def _(t: Inputs) -> DataFrame:
    return history.clear_classrooms(t.cameras.select("id", "classroom_id"), t.assignments.where("event_id % 7 = 0"))


@query("win_assignment_opened", """, al AS (SELECT event_id, camera_id, classroom_id, started_at FROM assignments UNION ALL SELECT -CAST(id AS BIGINT), id, classroom_id, TIMESTAMP '2024-01-10' FROM cameras WHERE classroom_id IS NOT NULL),
 hi AS (SELECT *, lead(started_at) OVER (PARTITION BY camera_id ORDER BY started_at, event_id) AS ended_at FROM al) SELECT event_id, camera_id, classroom_id, epoch_us(ended_at)::VARCHAR AS ended FROM hi WHERE classroom_id IS NOT NULL""")
def _(t: Inputs) -> DataFrame:
    cameras = t.cameras.withColumn("created_at", F.lit("2024-01-10").cast("timestamp"))
    events = t.assignments.select("event_id", "camera_id", "classroom_id", "started_at").unionByName(history.opening_events(cameras, -F.col("id").cast("long")))
    return history.assignment_history(events).select("event_id", "camera_id", "classroom_id", F.unix_micros("ended_at").cast("string").alias("ended"))


@query("win_latest_per_key", "SELECT DISTINCT ON (user_id) user_id, event_id, event_type FROM events ORDER BY user_id, ts DESC, event_id DESC")
def _(t: Inputs) -> DataFrame:
    return state.latest(t.events, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("win_unique_guard", "SELECT id, serial_number FROM cameras WHERE serial_number IN (SELECT serial_number FROM cameras WHERE serial_number IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT l_orderkey::VARCHAR, l_linenumber::VARCHAR FROM lineitem SEMI JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1) x USING (l_orderkey, l_linenumber)")
def _(t: Inputs) -> DataFrame:
    lines = guards.unique_violations(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])
    return guards.unique_violations(t.cameras, ["serial_number"]).select("id", "serial_number").union(lines.select(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))


@query("win_prev_context", r""", x AS (SELECT job_id, chunk_index, text, p_type, lag(text) OVER (PARTITION BY job_id ORDER BY chunk_index) AS p FROM turns LEFT JOIN part ON p_partkey = CAST(job_id AS BIGINT) AND p_partkey % 3 = 0)
 SELECT job_id, chunk_index, md5(nullif(concat_ws(' ', 'Vocabulario esperado: ' || replace(p_type, ' ', ', ') || '.', CASE WHEN coalesce(p, '') <> '' THEN 'Contexto anterior: ' || right(p, 500) END), '')) AS prompt FROM x""")
def _(t: Inputs) -> DataFrame:
    vocabulary = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("job_id"), F.split("p_type", " ").alias("vocabulary"))
    return stitch.prompts(t.turns.join(vocabulary, "job_id", "left")).select("job_id", "chunk_index", F.md5("prompt").alias("prompt"))


# ---- orders and sets ----


@query("srt_sites", "SELECT id, name FROM sites ORDER BY name, id")
def _(t: Inputs) -> DataFrame:
    return views.listed(t.sites, "sites").select("id", "name")


@query("srt_classrooms", "SELECT id, code FROM classrooms ORDER BY code, id")
def _(t: Inputs) -> DataFrame:
    return views.listed(t.classrooms, "classrooms").select("id", "code")


@query("srt_cameras", "SELECT id, code FROM cameras ORDER BY code, id")
def _(t: Inputs) -> DataFrame:
    return views.listed(t.cameras, "cameras").select("id", "code")


@query("srt_assignments", "SELECT event_id, camera_id FROM assignments ORDER BY started_at DESC, event_id")
def _(t: Inputs) -> DataFrame:
    return views.listed(t.assignments, "camera_assignments", "event_id").select("event_id", "camera_id")


@query("srt_professors", "SELECT id, full_name FROM professors ORDER BY full_name, id")
def _(t: Inputs) -> DataFrame:
    return views.listed(t.professors, "professors").select("id", "full_name")


@query("srt_courses", "SELECT id, name FROM courses ORDER BY name, id")
def _(t: Inputs) -> DataFrame:
    return views.listed(t.courses, "courses").select("id", "name")


@query("srt_schedules", "SELECT id, day_of_week, start_time FROM schedules ORDER BY day_of_week, start_time, id")
def _(t: Inputs) -> DataFrame:
    return views.listed(t.schedules, "schedules").select("id", "day_of_week", "start_time")


@query("srt_recent_recordings", "SELECT id FROM recordings ORDER BY created_at DESC, id LIMIT 100")
def _(t: Inputs) -> DataFrame:
    return views.most_recent(t.recordings).select("id")


@query("srt_recent_jobs", "SELECT job_id, status FROM jobs ORDER BY created_at DESC, job_id LIMIT 500")
def _(t: Inputs) -> DataFrame:
    return views.most_recent(t.jobs, 500, "job_id").select("job_id", "status")


@query("srt_segments", "SELECT job_id, segment_id, start_seconds FROM segments ORDER BY ALL")
def _(t: Inputs) -> DataFrame:
    return views.segments_in_order(t.segments).select("job_id", "segment_id", "start_seconds")


#: The seven lists: table -> (role, key, what names a row, SQL order).
LISTS = {
    "sites": ("sites", "id", "name", "name"), "classrooms": ("classrooms", "id", "name", "code"), "cameras": ("cameras", "id", "name", "code"),
    "camera_assignments": ("assignments", "event_id", "camera_id", "started_at DESC"), "professors": ("professors", "id", "full_name", "full_name"),
    "courses": ("courses", "id", "name", "name"), "schedules": ("schedules", "id", "professor_id", "day_of_week, start_time"),
}


@query("set_catalog_snapshot", " UNION ALL ".join(f"SELECT '{e}' AS entity, {key}::VARCHAR AS id, {label} AS label, row_number() OVER (ORDER BY {order}, {key}::VARCHAR) AS rank FROM {role}" for e, (role, key, label, order) in LISTS.items()))
def _(t: Inputs) -> DataFrame:
    docs = views.catalog_snapshot({e: getattr(t, role).withColumn("id", F.col(key).cast("string")) for e, (role, key, _, _) in LISTS.items()})
    label = F.coalesce(*(F.get_json_object("document", f"$.{c}") for c in ("name", "full_name", "camera_id", "professor_id")))
    return docs.select("entity", "id", label.alias("label"), "rank")


@query("set_provider_union", "SELECT job_id, CASE WHEN chunk_index % 2 = 0 THEN 'local' ELSE 'together' END AS provider, CASE WHEN chunk_index % 2 = 0 THEN 0.9 END::DOUBLE AS language_probability, CASE WHEN chunk_index % 2 <> 0 THEN speaker_label END AS speaker_label FROM turns")
def _(t: Inputs) -> DataFrame:
    local = t.turns.where("chunk_index % 2 = 0").select("job_id", F.lit("local").alias("provider"), F.lit(0.9).alias("language_probability"))
    return views.provider_union(local, t.turns.where("chunk_index % 2 <> 0").select("job_id", F.lit("together").alias("provider"), "speaker_label"))


# ---- recognisers ----


def _fake(row: dict) -> dict:
    """A recogniser that gives the chunk's own path back, and fails where there is none."""
    if not row["path"]:
        raise ValueError("empty chunk")
    model = providers.cached_model(lambda *key: "/".join(key), row["model_name"], "cpu", "int8")
    return {"device": "cpu", "compute_type": "int8", "language": row["language"], "language_probability": 1.0, "text": row["path"], "segments": "[]", "provider_model": model}


@providers.batched
def _fake_batch(rows: list[dict]) -> list[dict]:
    return [_fake(r) for r in rows]


def _spoken(t: Inputs) -> DataFrame:
    """Turns as chunks: every seventh conversation's third turn is empty; turns of users go one by one, others by batch."""
    empty = (F.col("job_id").cast("long") % 7 == 0) & (F.col("chunk_index") == 2)
    name = F.when(F.col("speaker_label") == "user", "one").otherwise("batch")
    return t.turns.select(
        "job_id", "chunk_index", name.alias("provider_name"), F.when(empty, "").otherwise(F.col("text")).alias("path"), F.coalesce("speaker_label", F.lit("none")).alias("model_name"),
        F.lit("es").alias("language"), F.array().cast("array<string>").alias("vocabulary"), F.lit("").alias("prompt"),
    )


_PROVIDERS = {"one": _fake, "batch": _fake_batch}
_SPOKEN = """, sp AS (SELECT job_id, chunk_index, coalesce(speaker_label, 'none') AS model, CASE WHEN speaker_label = 'user' THEN 'one' ELSE 'batch' END AS provider,
 CASE WHEN (job_id::BIGINT % 7 = 0 AND chunk_index = 2) OR text IS NULL OR text = '' THEN NULL ELSE text END AS text FROM turns)"""


@query("udf_provider", f"""{_SPOKEN} SELECT job_id, chunk_index, provider, md5(text) AS text, CASE WHEN text IS NOT NULL THEN model || '/cpu/int8' END AS provider_model,
 CASE WHEN text IS NULL THEN 'ValueError: empty chunk' END AS error FROM sp""")
def _(t: Inputs) -> DataFrame:
    """Two providers, one of which takes batches; a chunk that fails is a row with its error, whatever batch it was in."""
    out = providers.map_chunks(_spoken(t), _PROVIDERS)
    return out.select("job_id", "chunk_index", "provider", F.md5("text").alias("text"), "provider_model", "error")


@query("udf_failed_jobs", f"{_SPOKEN} SELECT job_id, 'ERROR' AS status, 'ValueError: empty chunk' AS error_message, count(*) AS failed_chunks FROM sp WHERE text IS NULL GROUP BY job_id")
def _(t: Inputs) -> DataFrame:
    return providers.failed_jobs(providers.map_chunks(_spoken(t), _PROVIDERS))


@query("udf_worker_cache", f"{_SPOKEN} SELECT model, model || '/cpu/int8' AS provider_model, count(*) AS chunks, 1 AS most_loads FROM sp WHERE text IS NOT NULL GROUP BY model")
def _(t: Inputs) -> DataFrame:
    """Chunks by model, with the greatest number of loads of one model in any worker; without the cache that is a worker's chunks of it."""
    out = providers.map_chunks(_spoken(t), _PROVIDERS).where("error is null")
    return out.groupBy(F.split("provider_model", "/")[0].alias("model"), "provider_model").agg(F.count("*").alias("chunks"), F.max("model_loads").alias("most_loads"))


@query("udf_word_edit", rf"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN n // 10 ELSE n END::BIGINT AS edits
 FROM (SELECT doc_id, len(list_filter(string_split({norm('text')}, ' '), lambda x: x <> ''))::BIGINT AS n FROM documents)""")
def _(t: Inputs) -> DataFrame:
    """Texts between three words that they do not have, without every tenth word, and with all words changed: the distances are known."""
    w, kind = F.col("w"), F.col("doc_id") % 3
    around = F.concat(F.array(F.lit("\u0001a")), w, F.array(F.lit("\u0001b"), F.lit("\u0001c")))
    fewer = F.filter(w, lambda x, i: (i + 1) % 10 != 0)
    other = F.when(kind == 0, around).when(kind == 1, fewer).otherwise(F.transform(w, lambda x: F.concat(F.lit("\u0001"), x)))
    return spread(t.documents.select("doc_id", "text")).select("doc_id", fn.words("text").alias("w")).select("doc_id", metrics.word_edits("w", other).alias("edits"))


# ---- streams ----


def _events(t: Inputs) -> DataFrame:
    return streaming.stream_table(t.spark, t.folder, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("str_arrivals", f""", p AS (SELECT page_id, strlen(coalesce(html, '')) + 1 AS n FROM pages), x AS (SELECT page_id::VARCHAR AS id, n, CASE WHEN page_id % 17 = 0 THEN '0' ELSE n_regionkey::VARCHAR END AS site_id, n_nationkey::VARCHAR AS classroom_id, (page_id % 100 + 1)::VARCHAR AS camera_id,
 CASE WHEN page_id % 13 = 0 THEN 0 ELSE n END AS duration_seconds, page_id % 11 <> 0 AS has_audio, CASE WHEN page_id % 7 = 0 THEN 20000 WHEN page_id % 5 = 0 THEN n + 1 ELSE n END AS declared FROM p JOIN nation ON n_nationkey = page_id % 25)
 SELECT x.id, CASE WHEN n > 16384 OR declared > 16384 THEN 'size' WHEN declared <> n THEN 'incomplete' ELSE coalesce({_LOCATION}, CASE WHEN x.duration_seconds <= 0 THEN 'duration' WHEN NOT x.has_audio THEN 'audio' END) END AS reject_reason {_PLACES.replace("recordings x", "x")}""")
def _(t: Inputs) -> DataFrame:
    """Pages land as files; by declared and real size they are admitted, then probed and placed. Taken files are archived.

    What is known of the pages is stored without their html, which no batch reads again."""
    path, i = scratch(t.spark), F.col("page_id")
    pages = spread(t.pages.select("page_id", "html")).select(i, F.coalesce("html", F.lit("")).alias("html")).join(F.broadcast(t.nation.select("n_nationkey", "n_regionkey")), i % 25 == F.col("n_nationkey"))
    sources.land_texts(pages.select("page_id", "html"), f"{path}/landing")
    size = (F.octet_length("html") + 1).cast("long")  # a landed file ends with a line end
    known = pages.select(
        i.cast("string").alias("id"), F.when(i % 17 == 0, "0").otherwise(F.col("n_regionkey").cast("string")).alias("site_id"), F.col("n_nationkey").cast("string").alias("classroom_id"), (i % 100 + 1).cast("string").alias("camera_id"),
        F.when(i % 13 == 0, 0).otherwise(size).cast("double").alias("duration_seconds"), (i % 11 != 0).alias("has_audio"), F.when(i % 7 == 0, 20_000).when(i % 5 == 0, size + 1).otherwise(size).cast("long").alias("declared_bytes"),
    )
    known.write.parquet(f"{path}/known")
    known = t.spark.read.parquet(f"{path}/known")
    rooms, cameras, most = t.classrooms, t.cameras, 16_384 / (1 << 30)

    def gate(files: DataFrame) -> DataFrame:
        named = files.withColumn("id", F.regexp_extract("path", "page_id=(-?[0-9]+)", 1))
        here = F.broadcast(named.select("id", "path"))  # 1,000 files at most, so what is known is read where it lies
        declared = F.broadcast(known.join(here, "id").select("id", "site_id", "classroom_id", "camera_id", "declared_bytes", "path"))
        probes = F.broadcast(known.join(here, "id").select("id", "duration_seconds", "has_audio"))
        return streaming.gate_landed(files, declared, lambda fit: guards.ingest_recordings(fit, probes, rooms, cameras), most)

    for _ in range(2):  # a second run finds nothing new
        streaming.stream_ingest(streaming.stream_landing(t.spark, f"{path}/landing", f"{path}/archive", 1_000), gate, path)
    accepted = t.spark.read.parquet(f"{path}/accepted").select("id", F.lit(None).cast("string").alias("reject_reason"))
    return accepted.union(t.spark.read.parquet(f"{path}/rejected").select("id", "reject_reason"))


@query("str_job_state", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    events = _events(t).select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"))
    return streaming.drained(streaming.stream_latest_status(events), "update", ["job_id"]).select("job_id", "status", "seq")


@query("str_progress", "SELECT user_id AS job_id, count(DISTINCT event_id // 10) AS completed_chunks FROM events GROUP BY 1")
def _(t: Inputs) -> DataFrame:
    done = _events(t).select(F.col("user_id").alias("job_id"), F.expr("event_id div 10").alias("chunk_index"), "ts")
    return streaming.drained(streaming.stream_progress(done, "60 days"), "update", ["job_id"]).select("job_id", "completed_chunks")


@query("str_stitch", f"{CHUNKS} SELECT job_id::VARCHAR AS job_id, chunk_index::BIGINT AS chunk_index, md5(clean_text) AS clean, removed_words FROM cl")
def _(t: Inputs) -> DataFrame:
    docs = streaming.stream_table(t.spark, t.folder, "documents.parquet").select(F.col("doc_id").cast("string").alias("job_id"), fn.words("text").alias("w"))
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - 50) / 45)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("w", i * 45 + 1, 50), " "))
    chunks = docs.select("job_id", (last + 1).alias("total_chunks"), F.posexplode(pieces).alias("chunk_index", "text"))
    return streaming.drained(streaming.stream_stitch(chunks)).select("job_id", "chunk_index", F.md5("clean_text").alias("clean"), "removed_words")


@query("str_highwater", """, sg AS (SELECT conv_id::VARCHAR AS job_id, turn, unnest(range(0, 3)) AS k, turn * 6 + k * 5 - (conv_id + turn) % 3 + 0.0::DOUBLE AS e FROM conversations),
 f AS (SELECT job_id, list_reduce(list_prepend({'last': -1.0::DOUBLE, 'ids': []::VARCHAR[]}, list({'last': e, 'ids': [turn || '-' || k]} ORDER BY turn, k)), lambda a, x: CASE WHEN x.last > a.last + 0.05 THEN {'last': x.last, 'ids': a.ids || x.ids} ELSE a END) AS r FROM sg GROUP BY job_id)
 SELECT job_id, unnest(r.ids) AS segment_id FROM f""")
def _(t: Inputs) -> DataFrame:
    """Each turn is a chunk of three segments, some of which end before the last one of the turn before."""
    turns, parts = streaming.stream_table(t.spark, t.folder, "conversations.parquet"), range(3)
    ids = F.array(*(F.concat_ws("-", "turn", F.lit(k)) for k in parts))
    ends = F.array(*((F.col("turn") * 6 + k * 5 - (F.col("conv_id") + F.col("turn")) % 3).cast("double") for k in parts))
    chunks = turns.select(F.col("conv_id").cast("string").alias("job_id"), F.col("turn").cast("long").alias("chunk_index"), ids.alias("segment_ids"), ends.alias("ends"))
    return streaming.drained(streaming.stream_highwater(chunks))


def _in_files(df: DataFrame, order: str, path: str, files: int) -> None:
    """df's rows by ranges of order, a file after the other; a stream that takes one file a batch sees them in this order."""
    edges = df.agg(F.percentile_approx(order, [k / files for k in range(1, files)])).first()[0]
    part = sum((F.when(F.col(order) > e, 1).otherwise(0) for e in edges), F.lit(0))
    for k in range(files):
        df.where(part == k).coalesce(1).write.parquet(f"{path}/part={k}")


def _file_stream(t: Inputs, path: str, schema: str, files: int = 1) -> DataFrame:
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path}/part=*")


@query("str_cancel", """, c AS (SELECT user_id, ts FROM events WHERE event_type = 'error' AND event_id % 5 = 0)
 SELECT e.user_id AS job_id, event_id AS seq FROM events e WHERE NOT (event_type = 'error' AND event_id % 5 = 0) AND NOT EXISTS (SELECT 1 FROM c WHERE c.user_id = e.user_id AND c.ts <= e.ts AND c.ts >= e.ts - INTERVAL 3 DAY)""")
def _(t: Inputs) -> DataFrame:
    """Two streams of four files each, a file a batch; two rows of no job, a month later, move the watermark past the rest."""
    stop, path = (F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), scratch(t.spark)
    rows = t.events.select(F.col("user_id").cast("long").alias("job_id"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), stop.alias("stop"))
    streams = []
    for name, own in (("chunks", rows.where(~F.col("stop"))), ("cancels", rows.where("stop"))):
        own = own.drop("stop")
        _in_files(own, "ts", f"{path}/{name}", 4)
        for k in (4, 5):
            last = rows.agg(F.timestamp_add("DAY", F.lit(30 + k), F.max("ts")).alias("ts"))
            last.select(F.lit(-1).cast("long").alias("job_id"), F.lit(-1).cast("long").alias("seq"), "ts").coalesce(1).write.parquet(f"{path}/{name}/part={k}")
        streams.append(_file_stream(t, f"{path}/{name}", "job_id long, seq long, ts timestamp"))
    return streaming.drained(streaming.drop_cancelled(*streams, within="3 days", delay="2 days")).where("job_id >= 0").select("job_id", "seq")


@query("str_exactly_once", ", a AS (SELECT * FROM segments WHERE CAST(job_id AS BIGINT) % 3 <> 0) SELECT job_id, segment_id FROM a UNION ALL SELECT job_id, segment_id || '-2' FROM segments WHERE CAST(job_id AS BIGINT) % 3 = 0")
def _(t: Inputs) -> DataFrame:
    """Four deliveries, a batch each, that cut jobs anywhere: some jobs have two attempts, and the second delivery comes twice.
    A delivery has as many files as the table has parts to be read in, as one file would be one task's work."""
    path, twice = scratch(t.spark), F.col("job_id").cast("long") % 3 == 0
    attempts = F.explode(F.when(twice, F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))).otherwise(F.array(F.lit(1).cast("long")))).alias("attempt")
    rows = t.segments.select("job_id", "segment_id", "position", attempts).withColumn("segment_id", F.when(F.col("attempt") == 2, F.concat("segment_id", F.lit("-2"))).otherwise(F.col("segment_id")))
    rows = spread(rows.drop("position"))
    part, files = F.pmod(F.xxhash64("segment_id"), F.lit(4)), rows.rdd.getNumPartitions()
    for k, of in enumerate((0, 1, 1, 2, 3)):
        rows.where(part == of).write.parquet(f"{path}/in/part={k}")
    streaming.replace_stream(_file_stream(t, f"{path}/in", "job_id string, segment_id string, attempt long", files), path, 8)
    return streaming.current_segments(t.spark, path).select("job_id", "segment_id")


@query("str_active_dedup", """, k AS (SELECT (user_id || ':' || event_id % 3) AS interval, event_id AS seq, event_type <> 'error' AS request FROM events)
 SELECT interval, seq, coalesce(lag(request) OVER (PARTITION BY interval ORDER BY seq), false) AS refused FROM k QUALIFY request""")
def _(t: Inputs) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "ERROR").otherwise("request")
    events = _events(t).select(F.concat_ws(":", "user_id", F.col("event_id") % 3).alias("interval"), F.col("event_id").alias("seq"), kind.alias("kind"))
    return streaming.drained(streaming.stream_reject_duplicates(events))


@query("str_wait_window", "SELECT epoch_us(date_trunc('hour', ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def _(t: Inputs) -> DataFrame:
    out = streaming.drained(streaming.stream_ops_metrics(_events(t), "40 days"), "update", ["window_start", "event_type"])
    return out.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("str_job_windows", """, e AS (SELECT provider_name, status, floor(prepare_seconds) AS wait, floor(processing_seconds) AS run, clip_seconds, created_at + to_seconds((floor(prepare_seconds) + floor(processing_seconds))::BIGINT) AS ts FROM jobs)
 SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP)::BIGINT AS window_start, provider_name, count(*) AS jobs, count(*) FILTER (WHERE status = 'ERROR') AS failures, round(avg(wait), 6) AS mean_wait, round(avg(run), 6) AS mean_run, round(avg(run / clip_seconds), 6) AS mean_rtf FROM e GROUP BY ALL""")
def _(t: Inputs) -> DataFrame:
    """Starts and ends as two streams of four files, a file a batch, paired, summed by hour and these by day. Two rows of no
    job, a year later, move the watermark past the rest; with the second come rows of the first month, which are too late."""
    path, micros = scratch(t.spark), F.unix_micros("created_at")
    second = lambda c: F.floor(c).cast("long") * 1_000_000
    rows = t.jobs.withColumn("started", F.timestamp_micros(micros + second("prepare_seconds"))).withColumn("ended", F.timestamp_micros(F.unix_micros("started") + second("processing_seconds")))
    edge, first = rows.agg(F.max("ended").alias("ts")), rows.agg(F.timestamp_add("DAY", F.lit(30), F.min("ended"))).first()[0]
    kinds = {"starts": "job_id string, provider_name string, created_at timestamp, ts timestamp", "ends": "job_id string, status string, clip_seconds double, ts timestamp"}
    streams = []
    for name, at in (("starts", "started"), ("ends", "ended")):
        columns = [c.split()[0] for c in kinds[name].split(", ")]
        own = rows.withColumn("ts", F.col(at)).select(*columns)
        _in_files(own, "ts", f"{path}/{name}", 4)
        for k in (4, 5):
            last = edge.select(*(F.timestamp_add("DAY", F.lit(365 + k), F.col("ts")).alias(c) if c in ("ts", "created_at") else F.lit("none").alias(c) if c != "clip_seconds" else F.lit(1.0).alias(c) for c in columns))
            late = own.where(F.col("ts") < F.lit(first)) if k == 5 else own.where("false")
            last.unionByName(late).coalesce(1).write.parquet(f"{path}/{name}/part={k}")
        streams.append(_file_stream(t, f"{path}/{name}", kinds[name]))
    days = streaming.longer_windows(streaming.hourly_runs(streaming.paired_runs(*streams, longest="6 hours", delay="30 days")))
    out = streaming.run_report(streaming.drained(days)).where("provider_name <> 'none'")
    return out.withColumns({"window_start": F.unix_micros("window_start"), **{c: F.round(c, 6) for c in ("mean_wait", "mean_run", "mean_rtf")}})
