"""Sources and sinks."""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions import final_text, first_header, normalize_text, words_text
from ..schemas import TABLES, table_schema

MAX_GB = 80
PROBE = "struct<format:struct<duration:string,format_name:string>,streams:array<struct<codec_type:string,codec_name:string,duration:string,sample_rate:string,channels:int>>>"
SEGMENT = "struct<start:double,end:double,text:string,words:array<struct<word:string>>,avg_logprob:double,no_speech_prob:double,speaker_id:string>"
RESPONSE = f"struct<text:string,language:string,duration:double,segments:array<{SEGMENT}>,speaker_segments:array<{SEGMENT}>>"


def load_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The ten tables from Parquet folders under path, with their declared schemas."""
    return {name: spark.read.schema(table_schema(name)).parquet(f"{path}/{name}") for name in TABLES}


#: The tables that grow, by the column that a database is asked for in slices.
SLICED = {"recordings": "created_at", "camera_assignments": "started_at", "transcription_jobs": "created_at", "transcript_segments": "start_seconds"}


def _slices(spark: SparkSession, url: str, table: str, column: str, slices: int, options: dict[str, str]) -> dict[str, str]:
    """Reader options that cut a table into ranges of a column, between its least and greatest value as one query finds
    them; none if it has no value. Null stands in the first slice."""
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    ends = spark.read.format("jdbc").options(**options, url=url, query=f"SELECT min({name}) AS least, max({name}) AS most FROM {table}").load()
    if not isinstance(ends.schema[0].dataType, (T.DateType, T.TimestampType)):
        ends = ends.select(F.floor(F.col(ends.columns[0])), F.ceil(F.col(ends.columns[1])))
    least, most = ends.select(*(F.col(f"`{c}`").cast("string") for c in ends.columns)).first()
    return {} if least is None else {"partitionColumn": column, "lowerBound": least, "upperBound": most, "numPartitions": str(slices)}


def load_jdbc(spark: SparkSession, url: str, sliced: dict[str, str] | None = None, slices: int = 32, **options: str) -> dict[str, DataFrame]:
    """The ten tables from a database, with their declared schemas; nested columns stand there as JSON.

    The tables in `sliced` (SLICED unless given; by table, a column of numbers, dates or timestamps) are read in that many
    queries at once, each a range of equal width; the others in one. Filters and columns asked for reach the database,
    as its driver gives every column in the declared type and nothing is cast. Slices are taken when
    this is called: rows that come later are read too, into the first or last."""
    sliced, out = SLICED if sliced is None else sliced, {}
    for name in TABLES:
        cut = _slices(spark, url, name, sliced[name], slices, options) if name in sliced else {}
        fields = table_schema(name).fields
        nested = {f.name for f in fields if isinstance(f.dataType, (T.ArrayType, T.StructType))}
        flat = ", ".join(f"{f.name} {'string' if f.name in nested else f.dataType.simpleString()}" for f in fields)
        rows = spark.read.format("jdbc").options(**options, url=url, dbtable=name, customSchema=flat, **cut).load()
        out[name] = rows.select(*(F.from_json(f.name, f.dataType).alias(f.name) if f.name in nested else F.col(f.name) for f in fields))
    return out


def store_jdbc(tables: dict[str, DataFrame], url: str, mode: str = "append", types: dict[str, str] | None = None, **options: str) -> None:
    """Tables into a database, nested columns as JSON; `types` has column types of tables that are made, by column, where the
    database's own (such as CLOB) cannot be compared. Each partition is a transaction: a task that is tried again after
    its commit writes its rows twice, so a table that matters should have a key."""
    for name, df in tables.items():
        nested = {f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.StructType))}
        flat = df.select(*(F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns))
        made = {"createTableColumnTypes": ", ".join(f"{c} {types[c]}" for c in flat.columns if c in types)} if types and set(types) & set(flat.columns) else {}
        flat.write.format("jdbc").options(**options, **made, url=url, dbtable=name).mode(mode).save()


def land_texts(texts: DataFrame, folder: str) -> None:
    """Each row of texts (key, a number, and text; neither null) as a file of its own, folder/<key's name>=<key>/, its text in UTF-8 and a line end.

    Spark's text sink lays out the same, but where Hadoop has no native library it starts two processes for each file of a
    local or mounted folder, to set permissions. There tasks write the files themselves; a task that runs again puts the same
    ones in place. Folders of any other scheme are left to the sink."""
    key, text = texts.columns
    if urlsplit(folder).scheme not in ("", "file"):
        texts.write.partitionBy(key).text(folder)
        return
    root = unquote(urlsplit(folder).path)
    os.makedirs(root, exist_ok=True)

    def land(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                home, name = f"{root}/{key}={k}", f"part-{part:05d}-{seen[k]}.txt"
                os.makedirs(home, exist_ok=True)
                with open(f"{home}/.{name}", "wb") as f:
                    f.write(data.as_py() + b"\n")
                os.replace(f"{home}/.{name}", f"{home}/{name}")
                seen[k] += 1
        yield pa.RecordBatch.from_arrays([pa.array([seen.total()], pa.int64())], names=["files"])

    texts.select(F.col(key).cast("string"), F.col(text).cast("binary")).mapInArrow(land, "files long").agg(F.sum("files")).collect()


def landing_fault(max_gb: float = MAX_GB) -> Column:
    """What is wrong with a file of length bytes, of which declared_bytes were declared: too large, or not all there; else null."""
    most = F.lit(int(max_gb * (1 << 30)))
    large = (F.col("length") > most) | (F.coalesce("declared_bytes", F.lit(0)) > most)
    return F.when(large, "size").when(F.col("declared_bytes") != F.col("length"), "incomplete")


def landed_files(listing: DataFrame, declared: DataFrame, max_gb: float = MAX_GB) -> DataFrame:
    """Landed files (path, length, modificationTime) with declared_bytes (by path) and reject_reason: too large, or not all there."""
    return listing.join(declared.select("path", "declared_bytes"), "path", "left").withColumn("reject_reason", landing_fault(max_gb))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under path; their content is never read, as its column is pruned. Spark passes over files of no bytes, so an
    empty file is not listed: compare declared files with the listing to find it."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")


def parse_probe(df: DataFrame, column: str = "probe_json") -> DataFrame:
    """A media probe's JSON as columns: duration is the container's, else the longest stream's, else 0; codec, rate and
    channels are those of the first video and audio stream."""
    rows = df.withColumn("_p", F.from_json(column, PROBE)).withColumn("_s", F.coalesce("_p.streams", F.array().cast(f"array<{PROBE.split('streams:array<')[1][:-2]}>")))
    first = lambda kind: F.get(F.filter("_s", lambda s: s["codec_type"] == kind), 0)
    rows = rows.withColumns({"_v": first("video"), "_a": first("audio")})
    own = F.coalesce(F.col("_p.format.duration").try_cast("double"), F.lit(0.0))
    longest = F.coalesce(F.array_max(F.transform("_s", lambda s: F.coalesce(s["duration"], F.lit("0")).try_cast("double"))), F.lit(0.0))
    return rows.withColumns(
        {
            "duration_seconds": F.when(own > 0, own).otherwise(longest), "container_format": F.col("_p.format.format_name"), "video_codec": F.col("_v.codec_name"), "audio_codec": F.col("_a.codec_name"),
            "audio_sample_rate": F.col("_a.sample_rate").try_cast("int"), "audio_channels": F.nullif("_a.channels", F.lit(0)), "has_audio": F.col("_a").isNotNull(),
        }
    ).drop("_p", "_s", "_v", "_a")


def parse_asr_response(df: DataFrame, column: str = "asr_json", diarize: bool = True, language: str = "language") -> DataFrame:
    """A recogniser's JSON as normalised segments: df's columns, language, position, start_seconds, end_seconds, text,
    avg_logprob, no_speech_prob, speaker_label.

    Speaker segments are taken when diarising and there are some, else segments; text is their text or joined words;
    blank ones are left out and, if none is left, the response's own text is one segment. A response with neither has
    one row without a segment (position null)."""
    rows = df.withColumn("_r", F.from_json(column, RESPONSE))
    some = F.size(F.coalesce("_r.speaker_segments", F.array().cast(f"array<{SEGMENT}>"))) > 0
    raw = F.coalesce(F.when(F.lit(diarize) & some, F.col("_r.speaker_segments")).otherwise(F.col("_r.segments")), F.array().cast(f"array<{SEGMENT}>"))
    shape = lambda s: F.struct(
        F.coalesce(s["start"], F.lit(0.0)).alias("start_seconds"), F.coalesce(s["end"], F.lit(0.0)).alias("end_seconds"),
        normalize_text(F.coalesce(F.nullif(s["text"], F.lit("")), words_text(s["words"]), F.lit(""))).alias("text"),
        s["avg_logprob"].alias("avg_logprob"), s["no_speech_prob"].alias("no_speech_prob"), s["speaker_id"].alias("speaker_label"),
    )
    rows = rows.withColumn("_t", normalize_text(F.coalesce("_r.text", F.lit("")))).withColumn("_s", F.filter(F.transform(raw, shape), lambda s: s["text"] != ""))
    kind = rows.schema["_s"].dataType.simpleString()
    whole = F.array(F.struct(F.lit(0.0).alias("start_seconds"), F.coalesce("_r.duration", F.lit(0.0)).alias("end_seconds"), F.col("_t").alias("text"), F.lit(None).cast("double").alias("avg_logprob"), F.lit(None).cast("double").alias("no_speech_prob"), F.lit(None).cast("string").alias("speaker_label")))
    found = F.when(F.size("_s") > 0, F.col("_s")).when(F.col("_t") != "", whole.cast(kind)).otherwise(F.array().cast(kind))
    spoken = F.coalesce(F.nullif("_r.language", F.lit("")), F.col(language) if language in df.columns else F.lit(None))
    keep = [c for c in df.columns if c not in (column, "language")]
    return rows.select(*keep, spoken.alias("language"), F.posexplode_outer(found).alias("position", "s")).select(*keep, "language", "position", "s.*")


def classify_response(df: DataFrame) -> DataFrame:
    """Adds outcome and message to logged responses (status_code, headers map, body).

    The message of a failure is that of the body's error object, else its code, else the object itself; without such an
    object it is the body's message or detail, else the whole body."""
    request = first_header("headers", ("x-request-id", "cf-ray"), "sin-id")
    code, body = F.col("status_code"), F.coalesce("body", F.lit(""))
    get = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    json = F.try_parse_json(body).isNotNull()
    error = F.when(get("$.error").startswith("{"), get("$.error"))
    of_error = F.when(error.isNotNull(), F.coalesce(get("$.error.message"), get("$.error.code"), error))
    detail = F.when(json, F.coalesce(of_error, get("$.message"), get("$.detail"), body)).otherwise(F.coalesce(F.nullif(F.trim(body), F.lit("")), F.concat(F.lit("HTTP "), code)))
    outcome = F.when(code == 503, "capacity").when(code == 429, "rate limit").when(code >= 400, "error").when(~json, "not json").otherwise("ok")
    message = F.when(code == 429, first_header("headers", ("x-ratelimit-reset",), "no indicado")).when((code >= 400) & (code != 503), detail)
    return df.withColumns({"request_id": request, "outcome": outcome, "message": message})


def parse_gpu_csv(lines: DataFrame, column: str = "line") -> DataFrame:
    """GPU telemetry lines as columns; a line with other than five fields, or without numbers where they belong, gives no row."""
    parts = lines.select(F.transform(F.split(column, ",", 5), lambda x: F.trim(x)).alias("p")).where(F.size("p") == 5)
    out = parts.select(
        F.col("p")[0].try_cast("int").alias("index"), F.col("p")[1].alias("name"), F.col("p")[2].try_cast("int").alias("memory_mb"), F.col("p")[3].alias("driver"), F.col("p")[4].try_cast("int").alias("utilization_percent")
    )
    return out.where("index is not null and memory_mb is not null and utilization_percent is not null")


# ---- sinks ----


def export_txt(jobs: DataFrame, path: str, buckets: int | None = None) -> None:
    """One text for each job, its final text, empty if it has none.

    Each job has a folder of its own, with its text as it is. For a whole history that is too many files: with
    `buckets`, jobs go to that many folders by a hash of job_id, a line each: job_id, a tab, and the text with its
    backslashes and line ends escaped (\\\\, \\n, \\r)."""
    text = F.coalesce(final_text(), F.lit("")).alias("text")
    if buckets is None:
        jobs.select("job_id", text).write.mode("overwrite").partitionBy("job_id").text(path)
        return
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    line = F.concat_ws("\t", "job_id", text).alias("text")
    jobs.select(F.pmod(F.xxhash64("job_id"), F.lit(buckets)).alias("bucket"), line).write.mode("overwrite").partitionBy("bucket").text(path)


def export_documents(jobs: DataFrame, segments: DataFrame) -> DataFrame:
    """(job_id, document): job, status, final text, metrics and segments by start, as JSON with nulls shown."""
    one = F.struct(F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), F.col("speaker_label").alias("speaker"), "text")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("start_seconds", "segment_id", one.alias("s")))), lambda x: x["s"])
    lists = segments.groupBy("job_id").agg(ordered.alias("segments"))
    kind = lists.schema["segments"].dataType.simpleString()
    metrics = ["metrics"] if "metrics" in jobs.columns else []
    doc = F.struct("job_id", "status", F.coalesce(final_text(), F.lit("")).alias("text"), *metrics, F.coalesce("segments", F.array().cast(kind)).alias("segments"))
    return jobs.join(lists, "job_id", "left").select("job_id", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def export_json(jobs: DataFrame, segments: DataFrame, path: str) -> None:
    export_documents(jobs, segments).select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def replace_segments(target: DataFrame, new: DataFrame) -> DataFrame:
    """target with all segments of the jobs in new replaced by new's; doing it again changes nothing."""
    return target.join(new.select("job_id").distinct(), "job_id", "left_anti").select(*target.columns).unionByName(new)


def latest_attempts(rows: DataFrame) -> DataFrame:
    """Of (job_id, attempt, segment_id and more) each job's rows of its latest attempt, a segment once.

    A null attempt comes before all others. A row without segment_id says that its attempt has begun, and counts as one,
    so that an attempt without segments replaces others too."""
    return _latest(rows, ["job_id"])


def _latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """latest_attempts within keys, which hold job_id: one shuffle and one sort, and no more than two rows held at a time."""
    order = F.coalesce("attempt", F.lit(-1).cast("long"))
    w = Window.partitionBy(*keys).orderBy(order.desc(), "segment_id")
    again = (F.row_number().over(w) > 1) & F.lag(order).over(w).eqNullSafe(order) & F.lag("segment_id").over(w).eqNullSafe(F.col("segment_id"))
    return rows.where("job_id is not null").withColumns({"_last": F.first(order).over(w), "_again": again}).where((order == F.col("_last")) & ~F.col("_again")).drop("_last", "_again")


def store_segments(new: DataFrame, path: str, buckets: int = 64) -> None:
    """New segments (job_id, attempt, segment_id and more) into the table at path, which has a folder for each bucket of
    jobs, by a hash; latest_attempts says what stays.

    Only the buckets of the jobs at hand are read, and written anew; Spark swaps these folders when the job is done, and
    their old files go. A batch costs what its buckets hold: their rows are shuffled once, by bucket and a further hash of
    the job, so that tasks stay small however much a bucket holds. One writer at a time."""
    spark = new.sparkSession
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = new.withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int"))
    rows.where("false").write.mode("ignore").partitionBy("bucket").parquet(path)
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
    if touched:
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("bucket").isin(touched))
        piece = F.pmod(F.xxhash64("job_id", F.lit("piece")), F.lit(pieces)).cast("int")
        both = rows.unionByName(old).withColumn("piece", piece).repartition("bucket", "piece")
        both = _latest(both, ["bucket", "piece", "job_id"]).drop("piece")
        both.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored_segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments at path, without what only says that an attempt has begun."""
    return spark.read.parquet(path).where("segment_id is not null").drop("bucket")
