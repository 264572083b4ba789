"""Streams over several micro-batches: replacement, job state, cancels, landing files."""

import datetime

from pyspark.sql import functions as F

from lecturelake import sources, streaming
from lecturelake.plans import queries as plans

from conftest import DATA
from test_operators import _in_batches


def test_attempts_replace_over_batches(spark, tmp_path):
    schema = "job_id string, attempt long, segment_id string"
    path = f"{tmp_path}/out"
    first = [("a", 1, "a1"), ("b", 1, "b1")], [("a", 1, "a2"), ("b", 2, "b3")], [("a", 1, "a1"), ("b", 1, "b2"), ("c", None, "c0")]
    streaming.replace_stream(_in_batches(spark, tmp_path / "in", schema, *first), path, 4)
    held = lambda: sorted((r.job_id, r.segment_id) for r in streaming.current_segments(spark, path).collect())
    assert held() == [("a", "a1"), ("a", "a2"), ("b", "b3"), ("c", "c0")]
    sources.store_segments(spark.createDataFrame(first[1], schema), f"{path}/rows", 4)
    assert held() == [("a", "a1"), ("a", "a2"), ("b", "b3"), ("c", "c0")]
    sources.store_segments(spark.createDataFrame([("a", 2, None), ("c", 1, "c1")], schema), f"{path}/rows", 4)
    sources.store_segments(spark.createDataFrame([("a", 1, "a9")], schema), f"{path}/rows", 4)
    assert held() == [("b", "b3"), ("c", "c1")]
    sources.store_segments(spark.createDataFrame([], schema), f"{path}/rows", 4)
    files = [f for d in (tmp_path / "out" / "rows").glob("bucket=*") for f in d.glob("*.parquet")]
    assert len(files) == len({f.parent for f in files})  # no old file stays beside a new one


_CHUNK = "job_id string, chunk_index long, text string, total_chunks long, status string, ts timestamp"


def _at(minute):
    return datetime.datetime(2024, 1, 1, 8) + datetime.timedelta(minutes=minute)


def test_job_state_goes(spark, tmp_path):
    """After the last chunk, a terminal status and a long silence no key is left; what waited in vain is given up."""
    batches = (
        [("done", 1, "c d e f", 2, None, _at(0)), ("stopped", 0, "x", None, None, _at(0)), ("silent", 1, "y", None, None, _at(1)), ("open", 0, "z", None, None, _at(1))],
        [("done", 0, "a b c d e", None, None, _at(2)), ("stopped", None, None, None, "CANCELLED", _at(2)), ("open", 2, "late", None, None, _at(200))],
        [("open", None, None, None, None, _at(201))],
        [("other", 0, "w", 1, None, _at(202))],
    )
    stream = streaming.stream_chunks(_in_batches(spark, tmp_path / "in", _CHUNK, *batches), "1 hour")
    out = []
    streaming.run_batches(stream, lambda b, n: out.extend(b.collect()), f"{tmp_path}/state")
    assert sorted((r.job_id, r.chunk_index, r.clean_text, r.removed_words) for r in out) == [("done", 0, "a b c d e", 0), ("done", 1, "f", 3), ("open", 0, "z", 0), ("other", 0, "w", 0), ("stopped", 0, "x", 0)]
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/state")
    assert {r.k for r in state("place").select("key.job_id").toDF("k").collect()} == {"open"}
    assert {r.k for r in state("early").select("key.job_id").toDF("k").collect()} == {"open"}


def test_late_cancels_are_not_seen(spark, tmp_path):
    row = "job_id long, seq long, ts timestamp"
    chunks = _in_batches(spark, tmp_path / "c", row, [(1, 1, _at(0)), (2, 2, _at(1)), (3, 3, _at(1))], [(1, 4, _at(60)), (3, 5, _at(400))], [(9, 6, _at(900))], [(9, 7, _at(901))])
    cancels = _in_batches(spark, tmp_path / "x", row, [(1, 0, _at(30))], [(8, 0, _at(500))], [(2, 0, _at(0)), (9, 0, _at(899))], [(8, 0, _at(902))])
    path = f"{tmp_path}/state"
    out = []
    streaming.run_batches(streaming.drop_cancelled(chunks, cancels, "2 hours", "1 minute"), lambda b, n: out.extend(b.collect()), path)
    assert sorted(r.seq for r in out) == [1, 2, 3, 5]  # 4 after its cancel; 2 before a cancel that comes too late; 6, 7 wait or go
    left = spark.read.format("statestore").option("joinSide", "left").load(path).count()
    assert left <= 2


def test_landed_files_are_taken_once(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for name, n in (("a", 10), ("b", 50), ("c", 10), ("d", 10)):
        (folder / f"{name}.mp4").write_bytes(b"x" * n)
    declared = spark.createDataFrame([("a", 10, 5.0), ("b", 50, 5.0), ("c", 11, 5.0)], "name string, declared_bytes long, duration double")
    seen = []

    def gate(files):
        named = files.withColumn("name", F.regexp_extract("path", "([a-z])[.]mp4$", 1))
        rows = streaming.gate_landed(files, named.join(declared, "name").select("path", "name", "declared_bytes", "duration"), lambda fit: fit.withColumn("reject_reason", F.lit(None).cast("string")), 20 / (1 << 30))
        seen.extend((r.path[-5], r.reject_reason) for r in rows.collect())
        return rows

    for _ in range(2):
        streaming.stream_ingest(streaming.stream_landing(spark, f"file://{folder}", f"file://{tmp_path}/archive", 2), gate, f"{tmp_path}/out")
    (folder / "a2.mp4").write_bytes(b"x")
    streaming.stream_ingest(streaming.stream_landing(spark, f"file://{folder}", f"file://{tmp_path}/archive", 2), gate, f"{tmp_path}/out")
    assert {(k, v) for k, v in seen if k != "2"} == {("a", None), ("b", "size"), ("c", "incomplete"), ("d", "undeclared")}
    assert spark.read.parquet(f"{tmp_path}/out/accepted").count() == 1
    assert len([p for p in (tmp_path / "archive").rglob("*.mp4")]) >= 2


def test_windows_of_windows(spark, tmp_path):
    """Starts and ends paired over batches, an end before its start's batch, one too late, hours summed into days."""
    start, end = "job_id string, provider_name string, created_at timestamp, ts timestamp", "job_id string, status string, clip_seconds double, ts timestamp"
    far = 60 * 24 * 9
    starts = _in_batches(spark, tmp_path / "s", start, [("a", "p", _at(0), _at(1)), ("b", "p", _at(0), _at(2))], [("c", "q", _at(70), _at(70)), ("late", "p", _at(0), _at(3))], [("n", None, _at(far), _at(far))], [("n", None, _at(far), _at(far + 1))])
    ends = _in_batches(spark, tmp_path / "e", end, [("c", "ERROR", 0.0, _at(80)), ("a", "READY_FOR_REVIEW", 120.0, _at(3))], [("b", "READY_FOR_REVIEW", 60.0, _at(182)), ("x", "ERROR", 1.0, _at(9))], [("n", "ERROR", 1.0, _at(far))], [("n", "ERROR", 1.0, _at(far + 1)), ("late", "ERROR", 1.0, _at(4))])
    hours = streaming.hourly_runs(streaming.paired_runs(starts, ends, "6 hours", "1 hour"))
    days = streaming.run_report(streaming.drained(streaming.longer_windows(hours))).collect()
    got = {(r.window_start.day, r.provider_name): (r.jobs, r.failures, r.mean_wait, r.mean_run, r.mean_rtf) for r in days}
    assert got == {(1, "p"): (2, 0, 90.0, (120 + 10_800) / 2, (1 + 180) / 2), (1, "q"): (1, 1, 0.0, 600.0, None)}


def test_landed_files_are_taken_by_few_tasks(spark, tmp_path):
    """Forty files in folders of their own: a batch is read once and by no more tasks than there are cores; nobody's file is refused."""
    spark.range(40).selectExpr("id as page_id", "repeat('x', cast(id as int)) as text").write.partitionBy("page_id").text(f"file://{tmp_path}/landing")
    declared = spark.range(39).selectExpr("cast(id as string) id", "id + 1 as declared_bytes")
    parts = []

    def gate(files):
        parts.append((files.rdd.getNumPartitions(), files.is_cached))
        named = files.withColumn("id", F.regexp_extract("path", "page_id=([0-9]+)", 1))
        return streaming.gate_landed(files, named.join(declared, "id").select("path", "id", "declared_bytes"), lambda fit: fit.withColumn("reject_reason", F.lit(None).cast("string")))

    streaming.stream_ingest(streaming.stream_landing(spark, f"file://{tmp_path}/landing", None, 1_000), gate, f"{tmp_path}/out")
    assert parts and all(n <= spark.sparkContext.defaultParallelism and cached for n, cached in parts)
    rejected = spark.read.parquet(f"{tmp_path}/out/rejected").collect()
    assert spark.read.parquet(f"{tmp_path}/out/accepted").count() == 39 and [(r.reject_reason, r.length) for r in rejected] == [("undeclared", 40)]


def test_landing_texts_are_files_of_their_own(spark, tmp_path):
    """By tasks themselves or by the text sink, the files are the same; a key that comes twice loses nothing."""
    rows = spark.createDataFrame([(1, "a b"), (-2, ""), (3, "é\nü"), (3, "z")], "page_id long, html string").repartition(1)
    for _ in range(2):  # a task that runs again
        sources.land_texts(rows, f"file://{tmp_path}/a%20b")
    got = sorted((p.parent.name, p.read_bytes().decode()) for p in (tmp_path / "a b").rglob("*") if p.is_file())
    assert got == [("page_id=-2", "\n"), ("page_id=1", "a b\n"), ("page_id=3", "z\n"), ("page_id=3", "é\nü\n")]
    sources.land_texts(rows.where("page_id < 0 and page_id > 0"), str(tmp_path / "none"))
    assert list((tmp_path / "none").iterdir()) == []


def test_arrivals_shuffle_nothing_for_a_batch(spark):
    """What is known of the pages is read where it lies: the pages are dealt over the cores, and that is all."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = shuffled()
    rows = plans.queries()["str_arrivals"](spark, str(DATA / "sf0.001")).count()
    assert shuffled() - before <= 2 * rows + 100


def test_stored_buckets_are_written_by_many_tasks(spark, tmp_path):
    """One bucket of many jobs: no task has it whole, and what is stored is each job's latest attempt, once."""
    rows = spark.range(4000).selectExpr("cast(id % 500 as string) job_id", "id % 2 + 1 as attempt", "concat('s', id) as segment_id")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _ in range(2):
            sources.store_segments(rows, str(tmp_path / "rows"), 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)
    assert len(list((tmp_path / "rows" / "bucket=0").glob("*.parquet"))) > 1
    got = sorted((r.job_id, r.segment_id) for r in sources.stored_segments(spark, str(tmp_path / "rows")).collect())
    assert got == sorted((str(i % 500), f"s{i}") for i in range(4000))  # 500 is even, so a job has one attempt here
    again = spark.createDataFrame([("3", 9, "new"), ("4", 0, "old"), ("5", 9, None)], "job_id string, attempt long, segment_id string")
    sources.store_segments(again, str(tmp_path / "rows"), 1)
    got = sorted((r.job_id, r.segment_id) for r in sources.stored_segments(spark, str(tmp_path / "rows")).collect())
    assert got == sorted([(str(i % 500), f"s{i}") for i in range(4000) if i % 500 not in (3, 5)] + [("3", "new")])


def test_cleaned_compares_words_of_letters_numbers_and_underscores():
    """Words are normalised together, which no word may notice: dots alone, final sigmas and numbers that are not digits."""
    before, now = "uno ... ΟΔΟΣ, ½x_ «Ñandú» ́e", "ΟΔΟΣ ½X_! ñandú É y más"
    one = lambda w: "".join(ch for ch in w.lower() if ch.isalpha() or ch.isnumeric() or ch == "_")
    assert streaming.PLAIN.sub("", " ".join(before.split()).lower()).split(" ") == [one(w) for w in before.split()]
    assert streaming._cleaned(before, now) == ("y más", 4) and streaming._cleaned("... ... ...", "- - - x") == ("x", 3)
    assert streaming._cleaned("", "a b c") == ("a b c", 0) and streaming._cleaned("a b c", "") == ("", 0)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for part in every.split():
        assert streaming.PLAIN.sub("", part) == "".join(ch for ch in part if ch.isalpha() or ch.isnumeric() or ch == "_")
