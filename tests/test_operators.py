"""Literal cases, properties against plain Python, and rerun safety."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lecturelake import functions as fn, sources, streaming
from lecturelake.operators import guards, history, jobs, metrics, planner, providers, rules, schedules, stitch, views
from lecturelake.plans import queries as plans
from lecturelake.schemas import TABLES
from lecturelake.storage import scratch

from conftest import DATA


def plan(spark, rows):
    df = spark.createDataFrame(rows, "job_id int, clip_seconds double, chunk_seconds int, overlap_seconds int")
    out = {}
    for r in planner.plan_chunks(df).orderBy("job_id", "index").collect():
        out.setdefault(r.job_id, []).append((r.start_seconds, r.duration_seconds))
    return out


def test_chunk_plan_literals(spark):
    got = plan(spark, [(1, 1800.0, 300, 3), (2, 50.0, 300, 3), (3, 0.0, 300, 3)])
    assert got[1] == [(0, 300), (297, 300), (594, 300), (891, 300), (1188, 300), (1485, 315)]
    assert got[2] == [(0, 50)] and 3 not in got


def test_chunk_plan_covers_the_clip(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(0.1, 9000), c := rng.randint(60, 1800), rng.randint(0, min(30, c - 1))) for i in range(400)]
    got = plan(spark, rows)
    for i, d, c, o in rows:
        chunks = got[i]
        assert chunks[0][0] == 0 and abs(sum(chunks[-1]) - d) < 1e-6
        assert all(abs(b[0] - (a[0] + c - o)) < 1e-6 and a[1] == c for a, b in zip(chunks, chunks[1:]))
        assert len(chunks) == 1 or chunks[-1][1] > max(30, 2 * o) - (c - o) and d - sum(chunks[-2]) > max(30, 2 * o)


def test_chunk_plan_refuses_what_cannot_be(spark):
    with pytest.raises(Exception, match="do not fit"):
        plan(spark, [(1, 10.0, 30, 30)])


def test_overlap_literal(spark):
    rows = [(1, 0, "La clase de hoy trata de la memoria y vamos a revisar un ejemplo"), (1, 1, "vamos a revisar un ejemplo antes de continuar")]
    got = stitch.dedup_overlap(spark.createDataFrame(rows, "job_id int, chunk_index int, text string")).orderBy("chunk_index").collect()
    assert got[1].clean_text == "antes de continuar" and got[1].removed_words == 5 and got[0].removed_words == 0


def test_stream_stitch_rule_equals_batch_rule(spark):
    rng, words = random.Random(5), ["uno", "Dos,", "tres", "¡Cuatro!", "cinco."]
    rows = [(j, i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for j in range(40) for i in range(4)]
    got = stitch.dedup_overlap(spark.createDataFrame(rows, "job_id int, chunk_index int, text string"))
    texts = {(j, i): t for j, i, t in rows}
    for r in got.collect():
        assert (r.clean_text, r.removed_words) == streaming._cleaned(texts.get((r.job_id, r.chunk_index - 1), ""), texts[r.job_id, r.chunk_index])


def test_stream_stitch_takes_every_document(spark, tmp_path):
    """The query against a plain fold: long texts with chunk after chunk, null texts and counts, a table of several files."""
    rng = random.Random(3)
    data = [(i, " ".join(f"w{rng.randrange(12 if i % 2 else 900)}" for _ in range(n)), n_chars) for i, (n, n_chars) in enumerate([(3, 9), (700, 3000), (4000, None), (1200, 99_999), (51, None)])]
    data += [(5, None, None), (6, "", 0)]
    spark.createDataFrame(data, "doc_id long, text string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, text, _ in data:
        w, before = (text or "").split(), []
        for k in range(max(0, -(-(len(w) - 50) // 45)) + 1):
            now = w[k * 45 : k * 45 + 50]
            cut = next((m for m in range(min(40, len(before), len(now)), 2, -1) if before[-m:] == now[:m]), 0)
            want.append((str(i), k, None if text is None else hashlib.md5(" ".join(now[cut:]).encode()).hexdigest(), cut))
            before = now
    got = [tuple(r) for r in plans.queries()["str_stitch"](spark, str(tmp_path)).select("job_id", "chunk_index", "clean", "removed_words").collect()]
    assert sorted(got, key=lambda r: r[:2]) == want and len(want) > 100


def test_highwater_equals_a_fold(spark):
    rng = random.Random(7)
    rows = [(j, 0, i, round(rng.choice([i * 0.04, rng.uniform(0, 3)]), 3)) for j in range(60) for i in range(25)]
    rows += [(99, 0, i, e) for i, e in enumerate((10.0, 10.04, 10.08))]
    want = set()
    for j in {r[0] for r in rows}:
        last = -1.0
        for _, c, i, e in sorted(r for r in rows if r[0] == j):
            if e > last + 0.05:
                want.add((j, i))
                last = max(last, e)
    got = stitch.highwater(spark.createDataFrame(rows, "job_id int, chunk_index int, position int, end_seconds double"))
    assert sorted((r.job_id, r.position) for r in got.collect()) == sorted(want)


def test_queue_position_equals_a_count(spark):
    rng = random.Random(9)
    names = ["PENDING", "VALIDATING", "TRANSCRIBING", "MERGING", "APPROVED", "ERROR"]
    rows = [(i, rng.choice(names), f"2024-01-{rng.randint(1, 4):02d} 0{rng.randint(0, 9)}:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "job_id int, status string, at string").select("job_id", "status", F.col("at").cast("timestamp").alias("created_at"))
    active = {"PENDING", "VALIDATING", "TRANSCRIBING", "MERGING"}
    for r, (_, status, at) in zip(jobs.queue_position(df).orderBy("job_id").collect(), rows):
        assert r.queue_position == (1 + sum(s in active and a < at for _, s, a in rows) if status in ("PENDING", "VALIDATING") else None)


def test_history_does_not_overlap(spark):
    rows = [(i, i % 3, None if i % 5 == 0 else i, f"2024-01-{i % 9 + 1:02d}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, camera_id int, classroom_id int, d string").withColumn("started_at", F.col("d").cast("timestamp"))
    by = {}
    for r in history.assignment_history(df).collect():
        by.setdefault(r.camera_id, []).append((r.started_at, r.event_id, r.ended_at))
    for spans in by.values():
        spans.sort()
        assert all(a[2] <= b[0] for a, b in zip(spans, spans[1:]))
    arrival = {r.event_id: r for r in history.assignment_history(df, "arrival").collect()}
    assert any(r.ended_at and r.ended_at < r.started_at for r in arrival.values())


def test_functions(spark):
    one = lambda c, **cols: spark.range(1).select(*(F.lit(v).alias(k) for k, v in cols.items())).select(c).first()[0]
    assert one(fn.duration_text("x"), x=359999.5) == "100:00:00" and one(fn.duration_text("x"), x=-3.0) == "00:00:00" and one(fn.duration_text(F.lit(None).cast("double")), x=1) == "—"
    assert [one(fn.bytes_text("x"), x=v) for v in (0, 1023, 2048, 5 << 20, 3 << 50)] == ["0 B", "1023 B", "2 KB", "5.00 MB", "3072.00 TB"]
    assert one(fn.safe_name("x"), x="..clase uno?.mp4") == "clase_uno_.mp4" and one(fn.safe_name("x"), x="???") == "recording.bin"
    assert one(fn.decoded_name("x"), x="a%20b+c.mp4 ") == "a b+c.mp4" and one(fn.decoded_name("x"), x="100%") == "100%"
    assert one(fn.normalize_text("x"), x="  a\u001f\n b ") == "a b" and one(fn.normalize_word(F.col("x")), x="¡Ñandú_2!") == "ñandú_2"
    assert one(fn.terms("x"), x=" a, ,b,") == ["a", "b"] and one(fn.is_email("x"), x="a@b.org") and not one(fn.is_email("x"), x="a b@c")


def test_asr_response_forms(spark):
    rows = [(1, '{"segments":[{"start":1,"end":2,"text":"a"}],"speaker_segments":[{"start":3,"end":4,"text":"b","speaker_id":"S1"}]}'), (2, '{"text":" t  u ","duration":9}'), (3, "{}"), (4, None), (5, "not json")]
    df = spark.createDataFrame(rows, "id int, asr_json string")
    got = {r.id: r for r in sources.parse_asr_response(df).collect()}
    assert (got[1].text, got[1].speaker_label) == ("b", "S1") and (got[2].text, got[2].end_seconds) == ("t u", 9.0)
    assert all(got[k].position is None for k in (3, 4, 5))
    assert {r.id: r.text for r in sources.parse_asr_response(df, diarize=False).collect()}[1] == "a"


def test_calendar_takes_weekday_and_validity(spark):
    rec = spark.sql("select 'r' id, 'c' classroom_id, timestamp'2024-01-01 23:00:00' recording_started_at, 40000D duration_seconds")
    slots = spark.sql("select * from values ('a', 'c', 1, 28800, 32400, date'2024-01-01', null, true), ('b', 'c', 2, 28800, 32400, null, null, true), ('d', 'c', 1, 28800, 32400, date'2024-02-01', null, true) s(id, classroom_id, day_of_week, start_time, end_time, valid_from, valid_until, active)")
    got = schedules.propose_intervals(rec, slots, "UTC", "calendar").collect()
    assert [(r.schedule_id, r.offset_start_seconds, r.offset_end_seconds) for r in got] == [("a", 32400.0, 36000.0)]


def test_intervals_keep_fractions_and_meet_once(spark):
    rec = spark.sql("""select * from values ('r', 'c', timestamp'2024-01-01 08:00:00.4', 3600D), ('long', 'c', timestamp'2024-01-01 00:30:00', 200000D),
        ('open', 'c', timestamp'2024-01-01 09:30:00', null), ('none', 'c', null, 60D) r(id, classroom_id, recording_started_at, duration_seconds)""")
    slots = spark.sql("""select id, 'c' classroom_id, 0 day_of_week, a start_time, b end_time, date(null) valid_from, date(null) valid_until, true active
        from values ('s', 28860, 29000), ('early', 0, 43200), ('night', 82800, 93600), ('back', 7200, 3600) t(id, a, b)""")
    got = {(r.recording_id, r.schedule_id): (r.offset_start_seconds, r.offset_end_seconds) for r in schedules.propose_intervals(rec, slots, "UTC", "same_day").collect()}
    assert got == {
        ("r", "s"): (59.6, 199.6), ("r", "early"): (0.0, 3600.0), ("long", "s"): (27060.0, 27200.0), ("long", "early"): (0.0, 41400.0),
        ("long", "night"): (81000.0, 91800.0), ("open", "early"): (0.0, 9000.0), ("open", "night"): (48600.0, 59400.0),
    }
    assert schedules.propose_intervals(rec, slots, "UTC", "same_day").count() == len(got)


def test_export_txt_keeps_every_job(spark, tmp_path):
    rows = [("a", "", "one\ntwo\\n\tthree"), ("b", "seen", "x"), ("c", None, None)]
    jobs = spark.createDataFrame(rows, "job_id string, reviewed_text string, transcript_text string")
    sources.export_txt(jobs, str(tmp_path / "jobs"))
    assert (tmp_path / "jobs" / "job_id=c").exists()
    sources.export_txt(jobs, str(tmp_path / "all"), buckets=2)
    lines = sorted(r.value for r in spark.read.text(str(tmp_path / "all")).collect())
    assert lines == ["a\tone\\ntwo\\\\n\tthree", "b\tseen", "c\t"]


def test_asof_takes_the_last_interval_begun(spark):
    rec = spark.sql("select * from values (1, 'k', timestamp'2024-01-02'), (2, 'k', timestamp'2024-01-05'), (3, 'k', timestamp'2023-01-01'), (4, null, timestamp'2024-01-02'), (5, 'k', null), (6, 'k', timestamp'2024-01-03') r(id, camera_id, recording_started_at)")
    his = spark.sql("select * from values ('k', 'A', timestamp'2024-01-02', timestamp'2024-01-03'), ('k', 'B', timestamp'2024-01-04', null), ('k', 'Z', timestamp'2024-01-05', timestamp'2024-01-05') h(camera_id, classroom_id, started_at, ended_at)")
    assert {r.id: r.asof_classroom for r in history.asof_classroom(rec, his).collect()} == {1: "A", 2: "B", 3: None, 4: None, 5: None, 6: None}


def test_rules_and_guards(spark):
    df = spark.createDataFrame([("x", "ab", None), ("xy", "abc", "z" * 241), (None, "abc", None)], "code string, name string, address string")
    assert [r.errors for r in rules.validate(df, "site").collect()] == [["code.length"], ["address.length"], ["code.required"]]
    ok, bad = rules.split_valid(df, "site", update=True)
    assert ok.count() == 1 and bad.count() == 2
    job = spark.sql("select timestamp'2024-01-02' class_ended_at, timestamp'2024-01-01' class_started_at, 3 overlap_seconds, 300 chunk_seconds, 'turbo' model_name")
    reason = lambda **k: guards.guard_job(job, **k).first().reject_reason
    assert (reason(), reason(provider="together"), reason(provider="together", remote_ready=False)) == (None, "remote model", "remote key")


def test_sinks_rerun(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "job_id string, n int")
    new = spark.createDataFrame([("a", 3)], "job_id string, n int")
    once = sources.replace_segments(target, new)
    assert sorted(sources.replace_segments(once, new).collect()) == sorted(once.collect())
    path = scratch(spark)
    done = spark.createDataFrame([("j1", "auto", "", "X"), ("j2", None, None, "Y")], "job_id string, transcript_text string, reviewed_text string, status string")
    for _ in range(2):
        sources.export_txt(done, path)
    assert {r.job_id: r.value for r in spark.read.text(path).collect()} == {"j1": "auto", "j2": ""}


def test_unknown_provider_and_limits(spark):
    df = spark.createDataFrame([("j", 0, "what")], "job_id string, chunk_index int, provider_name string")
    with pytest.raises(Exception, match="unknown provider"):
        providers.map_chunks(df, {}).collect()
    with pytest.raises(ValueError):
        views.most_recent(df, 501)
    with pytest.raises(ValueError):
        jobs.require_columns(df, {"nothing"})


def test_patch_null_and_absent(spark):
    base = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "id string, name string, n int")
    patch = spark.sql("select 'a' id, map('name', cast(null as string)) patch")
    assert [tuple(r) for r in jobs.apply_patch(base, patch).orderBy("id").collect()] == [("a", None, 1), ("b", "y", 2)]


def test_word_distance_equals_a_table():
    rng = random.Random(11)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        assert metrics.word_distance(a, b) == table[-1][-1]


def test_word_error_rate_equals_brute_force(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(8)
    data = [(f"s{i % 3}", " ".join(rng.choice("ab") if i % 2 else f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 90)))) for i in range(30)]
    spark.createDataFrame(data, "source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for source, text in data:
        w = text.split()
        e, n = want.get(source, (0, 0))
        want[source] = (e + distance(w, [x for i, x in enumerate(w, 1) if i % 10]), n + len(w))
    got = {r.source: (r.edits, r.reference_words, r.wer) for r in plans.queries()["agg_wer"](spark, str(tmp_path)).collect()}
    assert got == {s: (e, n, e / n) for s, (e, n) in want.items()} and min(e for e, _ in want.values()) > 0


def test_tables_are_read_by_load_tables(spark, monkeypatch):
    loaded, load = [], sources.load_tables
    monkeypatch.setattr(sources, "load_tables", lambda *a: loaded.append(load(*a)) or loaded[-1])
    got = {r.name: r.n for r in plans.queries()["src_tables"](spark, str(DATA / "sf0.001")).collect()}
    assert len(loaded) == 1 and set(got) == set(TABLES) and min(got.values()) > 0


def _in_batches(spark, folder, schema, *batches):
    """A stream with a micro-batch for each list of rows."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def test_stitching_over_batches_out_of_order(spark, tmp_path):
    texts = ["a b c d e", "c d e f g h", None, "x y", "x y z"]
    rows = [("j", i, t) for i, t in enumerate(texts)]
    stream = _in_batches(spark, tmp_path, "job_id string, chunk_index long, text string", [rows[1], rows[4]], [rows[0], rows[3]], [rows[2], rows[1]])
    got = sorted(streaming.drained(streaming.stream_stitch(stream)).collect())
    assert [(r.chunk_index, r.clean_text, r.removed_words) for r in got] == [(0, "a b c d e", 0), (1, "f g h", 3), (2, None, 0), (3, "x y", 0), (4, "x y z", 0)]


def test_state_over_batches_is_kept_where_needed(spark, tmp_path):
    events = _in_batches(spark, tmp_path / "d", "interval string, seq long, kind string", [("i", 1, "request")], [("i", 2, "request"), ("i", 3, "APPROVED")], [("i", 4, "request")])
    assert {r.seq: r.refused for r in streaming.drained(streaming.stream_reject_duplicates(events)).collect()} == {1: False, 2: True, 4: False}


def test_closes_end_an_assignment_once(spark):
    events = spark.createDataFrame([(1, "a", "r", "2024-01-01 08:00:00"), (2, "a", "s", "2024-01-01 10:00:00"), (3, "b", "r", "2024-01-01 08:00:00")], "event_id int, camera_id string, classroom_id string, started_at string")
    past = history.assignment_history(events.withColumn("started_at", F.col("started_at").cast("timestamp")))
    closes = spark.createDataFrame([(1, "2024-01-01 11:00:00"), (2, "2024-01-01 12:00:00"), (2, "2024-01-01 11:30:00"), (9, "2024-01-01 09:00:00"), (None, "2024-01-01 09:00:00")], "event_id int, closed_at string")
    got = history.close_assignments(past, closes.withColumn("closed_at", F.col("closed_at").cast("timestamp")))
    rows = {r.event_id: (r.ended, r.active) for r in got.select("event_id", F.date_format("ended_at", "HH:mm").alias("ended"), "active").collect()}
    assert rows == {1: ("10:00", False), 2: ("11:30", False), 3: (None, True)}
    cameras = spark.createDataFrame([("a", "s", 1), ("b", "r", 2), ("c", None, 3), ("d", "", 4)], "id string, classroom_id string, extra int")
    cleared = history.clear_classrooms(cameras, got.where("event_id in (1, 2)"))
    assert {r.id: (r.classroom_id, r.extra) for r in cleared.collect()} == {"a": (None, 1), "b": ("r", 2), "c": (None, 3), "d": ("", 4)}
    made = cameras.withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert {r.camera_id for r in history.opening_events(made, F.col("extra")).collect()} == {"a", "b"}


def test_ranks_over_ranges(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 7).cast("string").alias("name"))
    want = {r: i + 1 for i, r in enumerate(sorted(range(5000), key=lambda i: (str(i % 7), i)))}
    assert {r.id: r.rank for r in views.ranked(df, F.col("name"), F.col("id")).collect()} == want
    assert views.ranked(df.where("id < 0"), F.col("name"), F.col("id")).count() == 0


def test_bins_and_work_dirs_take_nulls(spark):
    rows = [("p", 10.0, 20.0), ("p", 11.0, 20.0), ("p", 1.0, 0.0), ("p", None, 5.0), (None, 1.0, 4.0)]
    df = spark.createDataFrame(rows, "provider_name string, processing_seconds double, clip_seconds double").withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    assert {(r.provider_name, r.bin): r.jobs for r in metrics.rtf_distribution(df, 0.25).collect()} == {("p", 2): 2, (None, 1): 1}
    now = F.lit("2024-02-01").cast("timestamp")
    held = spark.createDataFrame([(1, "ERROR", "/w", "2024-01-01"), (2, "ERROR", None, "2024-01-01"), (3, "ERROR", "/w", "2024-01-31"), (4, "PENDING", "/w", "2024-01-01"), (5, "APPROVED", "/w", None)], "id int, status string, work_dir string, completed_at string")
    assert [r.id for r in metrics.stale_work_dirs(held.withColumn("completed_at", F.col("completed_at").cast("timestamp")), 7, now).collect()] == [1]


def test_highwater_over_batches_out_of_order(spark, tmp_path):
    a, b, c, d = ("j", 0, ["a", "b"], [5.0, 5.04]), ("j", 1, ["c", "d"], [4.0, 7.0]), ("j", 2, None, None), ("j", 3, ["e", "f"], [None, 8.0])
    stream = _in_batches(spark, tmp_path, "job_id string, chunk_index long, segment_ids array<string>, ends array<double>", [b, d], [a, c], [b, a])
    assert sorted(r.segment_id for r in streaming.drained(streaming.stream_highwater(stream)).collect()) == ["a", "d", "f"]


def test_late_rows_are_left_out_of_windows(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02d}:30:00"
    batches = [(at(1), "x", 1.0), (at(2), "x", 1.0)], [(at(9), "x", 1.0)], [(at(9), "x", 1.0)], [(at(1), "x", 5.0), (at(9), "x", 1.0)]
    stream = _in_batches(spark, tmp_path, "ts string, event_type string, value double", *batches).withColumn("ts", F.col("ts").cast("timestamp"))
    got = streaming.drained(streaming.stream_ops_metrics(stream, "2 hours"), "update", ["window_start", "event_type"])
    assert {r.window_start.hour: r.n for r in got.collect()} == {1: 1, 2: 1, 9: 3}


def test_files_are_listed_and_references_checked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.mp4").write_bytes(b"1234")
    (tmp_path / "b.mp4").write_bytes(b"1")
    (tmp_path / "empty.mp4").write_bytes(b"")
    assert sorted((r.path.rpartition("/")[2], r.length) for r in sources.list_files(spark, f"file://{tmp_path}").collect()) == [("a.mp4", 4), ("b.mp4", 1)]
    child, parent = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, key string"), spark.createDataFrame([("a",), ("a",)], "id string")
    assert [r.n for r in guards.fk_valid(child, parent, "key").collect()] == [1]
    assert [r.n for r in guards.fk_violations(child, parent, "key").collect()] == [2]


def test_offsets_are_elapsed_time(spark):
    """Slots are wall times: clocks go forward in the night to 2024-03-31 in Madrid and back in that to 2024-10-27."""
    rows = [
        (1, "r", "2024-03-30 23:30:00", 50_000.0, "Europe/Madrid"), (2, "r", "2024-10-26 22:30:00", 50_000.0, "Europe/Madrid"), (3, "r", "2024-03-30 23:30:00", 50_000.0, "America/Bogota"),
        (4, "gap", "2024-03-31 00:30:00", 9_000.0, "Europe/Madrid"), (5, "twice", "2024-10-27 00:50:00", 1_500.0, "Europe/Madrid"), (6, "r", "2024-03-30 23:30:00", None, None),
    ]
    recs = spark.createDataFrame(rows, "id int, classroom_id string, at string, duration_seconds double, zone string").withColumn("recording_started_at", F.col("at").cast("timestamp"))
    slots = [(1, "r", 8), (2, "gap", 2.5), (3, "twice", 2.5)]
    data = [(i, c, 6, int(h * 3600), int((h + 1) * 3600), None, None, True) for i, c, h in slots]
    sched = spark.createDataFrame(data, "id int, classroom_id string, day_of_week int, start_time int, end_time int, valid_from date, valid_until date, active boolean")

    def got(mode):
        out = schedules.propose_intervals(recs, sched, "UTC", mode, "zone").collect()
        return {r.recording_id: (r.offset_start_seconds, r.offset_end_seconds) for r in out}

    calendar = got("calendar")
    # 1: from 00:30 to 08:00 an hour is lost. 2: one is gained. 3: no change between 18:30 of the day before and 08:00.
    # 4: 02:30 is skipped and counts as 03:30, at which the slot ends. 5: from 02:50, the first time, to 02:15, the second
    assert calendar == {1: (23_400.0, 27_000.0), 2: (30_600.0, 34_200.0), 3: (48_600.0, 50_000.0), 5: (0.0, 1_500.0)}


def test_change_sets_apply_one_after_the_other(spark):
    base = spark.createDataFrame([(1, "t", None, "ERROR", 5), (2, "", None, "ERROR", 5), (3, "t", "old", "ERROR", 5)], "job_id int, transcript_text string, reviewed_text string, status string, priority int")
    reviews = spark.createDataFrame([(1, "a", True, 1), (1, "b", False, 2), (2, "c", True, 1)], "job_id int, reviewed_text string, approve boolean, seq int")
    assert sorted((r.job_id, r.reviewed_text, r.status, r.outcome) for r in jobs.apply_reviews(base, reviews, ("seq",)).collect()) == [(1, "b", "READY_FOR_REVIEW", "reviewed"), (2, None, "ERROR", "no transcript"), (3, "old", "ERROR", None)]
    patches = spark.createDataFrame([(1, {"status": "X", "priority": "1"}, 1), (1, {"status": None}, 2), (3, {"priority": None, "status": "Y"}, 1), (3, {"priority": "7"}, 0)], "job_id int, patch map<string,string>, seq int")
    assert sorted((r.job_id, r.status, r.priority) for r in jobs.apply_patch(base, patches, "job_id", ("seq",)).collect()) == [(1, None, 1), (2, "ERROR", 5), (3, "Y", None)]
    updates = spark.createDataFrame([(1, 1, "A", 1, None), (1, 2, "B", None, None), (3, 1, "A", 1, None), (3, 2, None, None, ["status"]), (9, 1, "A", 1, None)], "job_id int, seq int, status string, priority int, given array<string>")
    merged = jobs.merge_job_state(base, updates, order=("seq",), given="given")
    assert sorted((r.job_id, r.status, r.priority) for r in merged.collect()) == [(1, "B", 1), (2, "ERROR", 5), (3, None, 1)]


def test_sketches_merge(spark):
    """Days merged agree with one pass where a sketch holds all values, and keep to the rank error where it does not."""
    rng = random.Random(6)
    rows = [(f"2024-01-{i % 9 + 1:02d}", "p" if i % 3 else "q", "m", float(int(rng.expovariate(0.01)))) for i in range(6000)]
    df = spark.createDataFrame(rows, "day string, provider_name string, model_name string, processing_seconds double")
    df = df.withColumns({"created_at": F.col("day").cast("timestamp"), "started_at": F.lit(None).cast("timestamp"), "completed_at": F.lit(None).cast("timestamp"), "clip_seconds": F.lit(1.0)})
    for k, error in ((8000, 0.0), (200, 0.03)):
        merged = metrics.sketched_quantiles(metrics.merged_sketches(metrics.quantile_sketches(df, k), "provider_name", rollup=True), {"p50": 0.5, "p95": 0.95})
        got = {r.provider_name: r for r in merged.collect()}
        for name in ("p", "q", None):
            values = sorted(r[3] for r in rows if name in (None, r[1]))
            assert got[name].rtf_n == got[name].jobs == len(values) and got[name].wait_p50 is None and got[name].wait_n == 0
            for q, value in ((0.5, got[name].rtf_p50), (0.95, got[name].rtf_p95)):
                if not error:
                    assert value == values[-(-int(q * 100) * len(values) // 100) - 1]
                below, upto = sum(v < value for v in values) / len(values), sum(v <= value for v in values) / len(values)
                assert below - error <= q <= upto + error


def test_highwater_of_many_near_ties(spark):
    """A job of 100,000 ends that creep up by less than the tolerance, and one without, equal to the loop."""
    ends = [0.02 * i + (0.03 if i % 5 else 0.0) for i in range(100_000)]
    rows = spark.range(100_000).select(F.lit("j").alias("job_id"), F.col("id").alias("position"), (0.02 * F.col("id") + F.when(F.col("id") % 5 != 0, 0.03).otherwise(0.0)).alias("end_seconds"))
    rows = rows.union(spark.range(9).select(F.lit("k"), F.col("id"), F.col("id").cast("double")))
    last, want = -1.0, []
    for i, e in enumerate(ends):
        if e > last + stitch.EPSILON:
            want.append(i)
            last = e
    got = stitch.highwater(rows.repartition(5), ("position",)).collect()
    assert sorted(r.position for r in got if r.job_id == "j") == want and sum(r.job_id == "k" for r in got) == 9


def test_long_chunks_compare_their_ends(spark):
    """Chunks of more words than are compared, at either side of that number, with a run of 40 and one of 41 repeated words."""
    w = [f"w{i}" for i in range(400)]
    texts = [" ".join(w[:79]), " ".join(w[39:120]), " ".join(w[79:200]), " ".join(w[160:161] + w[161:300]), " ".join(w[259:400])]
    got = stitch.dedup_overlap(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "job_id int, chunk_index int, text string")).orderBy("chunk_index").collect()
    assert [r.removed_words for r in got] == [0, 40, 0, 40, 0]


def test_word_distance_equals_a_table_in_any_band():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for k, y in enumerate(b, 1):
                last, row[k] = row[k], min(row[k] + 1, row[k - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(12)
    for n in (3, 12, 70) * 40:
        a, b = ([rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, n))] for _ in range(2))
        assert {metrics.word_distance(a, b, band) for band in (1, 2, 5, 32)} == {distance(a, b)}


def test_word_distance_without_the_band(monkeypatch):
    """Lists without a common word, and lists that only miss words, are decided without the band; others as by the plain table."""
    band, calls = metrics._within, []
    monkeypatch.setattr(metrics, "_within", lambda *a: calls.append(a) or band(*a))
    rng = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    words = [f"w{rng.randrange(50)}" for _ in range(400)]
    fewer = [w for i, w in enumerate(words) if i % 10 != 9]
    for a, b in [(words, ["a", *words, "b", "c"]), (words, fewer), (words, [f"x{w}" for w in words])]:
        assert metrics.word_distance(a, b) == metrics.word_distance(b, a) == plain(a, b)
    assert not calls
    for _ in range(300):
        a, b = ([f"w{rng.randrange(6)}" for _ in range(rng.randrange(12))] for _ in range(2))
        assert metrics.word_distance(a, b, 1) == plain(a, b)
    assert calls


def test_word_edits_of_nulls_empty_and_equal_texts(spark):
    df = spark.createDataFrame([(1, None, ["a"]), (2, [], []), (3, [], ["a", "b"]), (4, ["a"], ["a"]), (5, ["a", "b"], ["b"])], "id int, a array<string>, b array<string>")
    assert [r.e for r in df.select("id", metrics.word_edits("a", "b").alias("e")).orderBy("id").collect()] == [None, 0, 2, 0, 1]
    texts = spark.createDataFrame([("x", None, "a"), ("x", "", ""), ("x", " a  b ", "a b"), ("y", None, None)], "g string, r string, h string")
    assert {r.g: (r.edits, r.reference_words, r.wer) for r in metrics.wer(texts, "r", "h", ["g"]).collect()} == {"x": (1, 2, 0.5), "y": (0, 0, None)}


def test_models_load_once_in_a_process():
    from concurrent.futures import ThreadPoolExecutor

    loads = []
    load = lambda *key: loads.append(key) or object()
    with ThreadPoolExecutor(8) as pool:
        got = set(pool.map(lambda i: providers.cached_model(load, f"once{i % 2}", "cpu", "int8"), range(64)))
    assert len(got) == len(loads) == 2 and providers.most_loads() == 1

    def fails(*key):
        raise OSError("no file")

    for _ in range(3):
        with pytest.raises(OSError):
            providers.cached_model(fails, "never", "cpu", "int8")
    assert providers.most_loads() == 3
    providers._loads.pop(("never", "cpu", "int8"))


def test_batches_fail_by_chunk(spark, monkeypatch):
    sizes = []

    @providers.batched
    def provider(rows):
        sizes.append(len(rows))
        if any(r["path"] == "bad" for r in rows):
            raise OSError("torn")
        return [{"text": r["path"].upper()} for r in rows]

    rows = [{"path": "a"}, {"path": "bad"}, {"path": "c"}]
    assert providers._answers(provider, rows) == [{"text": "A"}, {"error": "OSError: torn"}, {"text": "C"}] and sizes == [3, 1, 1, 1]
    assert providers._answers(provider, rows[::2]) == [{"text": "A"}, {"text": "C"}] and sizes[4:] == [2]
    few = providers.batched(lambda rows: [{"text": "x"}] if len(rows) == 1 else [])
    assert providers._answers(few, rows) == [{"text": "x"}] * 3

    df = spark.createDataFrame([("j", 2, "bad"), ("j", 1, "a"), ("j", 0, "bad"), ("k", 0, "a")], "job_id string, chunk_index int, path string").withColumn("provider_name", F.lit("p"))
    one = lambda row: {"text": row["path"]} if row["path"] != "bad" else {}["no answer %d" % row["chunk_index"]]
    out = providers.map_chunks(df, {"p": one})
    assert [tuple(r) for r in providers.failed_jobs(out).collect()] == [("j", "ERROR", "KeyError: 'no answer 0'", 2)]
    assert providers.map_chunks(df.limit(0), {"p": one}).count() == 0

    asked, plain = [], type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, f, schema, barrier=False, profile=None: asked.append(profile) or plain(self, f, schema))
    providers.map_chunks(df, {"p": one}, profile="gpu")
    assert asked == ["gpu"]


def test_jdbc_round_trip(spark, tmp_path):
    spark._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    url, t = f"jdbc:derby:{tmp_path}/db;create=true", plans.Inputs(spark, str(DATA / "sf0.001"))
    tables = {}
    for name, (role, key) in plans.TEN.items():
        df = getattr(t, role).withColumnRenamed(key, "id")
        tables[name] = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in sources.table_schema(name)))
    said = F.from_json(F.lit('{"chunks": 3, "provider": "local"}'), sources.table_schema("transcription_jobs")["metrics"].dataType)
    tables["transcription_jobs"] = tables["transcription_jobs"].withColumn("metrics", F.when(F.col("priority") > 2, said))
    tables["camera_assignments"] = tables["camera_assignments"].limit(0)
    sources.store_jdbc(tables, url, types={"status": "VARCHAR(40)"})
    read = sources.load_jdbc(spark, url, slices=5)
    for name, df in tables.items():
        assert read[name].schema.simpleString() == df.schema.simpleString()
        assert sorted(map(repr, read[name].collect())) == sorted(map(repr, df.collect())), name
    jobs_ = read["transcription_jobs"]
    assert jobs_.rdd.getNumPartitions() == 5 and read["transcript_segments"].rdd.getNumPartitions() == 5
    assert read["camera_assignments"].rdd.getNumPartitions() == read["sites"].rdd.getNumPartitions() == 1
    asked = jobs_.where("status = 'ERROR'").select("id")
    seen = asked._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,ERROR)" in seen and "transcript_text" not in seen
    assert asked.count() == tables["transcription_jobs"].where("status = 'ERROR'").count() > 0


def test_intervals_of_one_file_are_made_in_many_tasks(spark):
    """Pairs are far more than recordings or slots: they must not all be made by the task that reads the one file."""
    recs = spark.range(400).coalesce(1).selectExpr("cast(id as string) id", "cast(id % 5 as string) classroom_id", "timestamp'2024-03-30 20:00:00' + make_interval(0, 0, 0, 0, id % 48) recording_started_at", "cast(id * 300 as double) duration_seconds")
    slots = spark.range(120).coalesce(1).selectExpr("cast(id as string) id", "cast(id % 5 as string) classroom_id", "cast(id % 7 as int) day_of_week", "cast(id % 20 * 3600 as int) start_time", "cast(id % 20 * 3600 + id * 120 as int) end_time", "date(null) valid_from", "date(null) valid_until", "true active")
    for mode in ("same_day", "calendar"):
        rows = schedules.propose_intervals(recs, slots, "Europe/Madrid", mode)
        assert rows.select(F.spark_partition_id()).distinct().count() >= 4
        day = F.to_date(F.from_utc_timestamp("recording_started_at", "Europe/Madrid"))
        last = F.to_date(F.from_utc_timestamp(F.timestamp_micros(F.unix_micros("recording_started_at") + (F.col("duration_seconds") * 1_000_000).cast("long")), "Europe/Madrid"))
        pairs = recs.withColumn("day", F.explode(F.sequence(day, last if mode == "calendar" else day))).alias("r").join(slots.alias("s"), F.expr("r.classroom_id = s.classroom_id and end_time > start_time"))
        pairs = pairs.where("day_of_week = weekday(day)") if mode == "calendar" else pairs
        at = lambda c: (F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.unix_date("day").cast("long") * 86_400_000_000 + F.col(c).cast("long") * 1_000_000), "Europe/Madrid")) - F.unix_micros("recording_started_at")) / 1e6
        want = pairs.select("r.id", F.col("s.id").alias("slot"), "day", F.greatest(F.lit(0.0), at("start_time")).alias("a"), F.least("duration_seconds", at("end_time")).alias("b")).where("b > a")
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect())) != []


def _shuffled(spark):
    """Rows that the session's stages have shuffled so far."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_intervals_shuffle_no_rows_by_hour(spark):
    """What is shuffled for a day does not grow with the length of recordings and slots."""
    slots = spark.sql("select id, concat('c', id % 2) classroom_id, cast(id % 7 as int) day_of_week, 0 start_time, 86000 end_time, date(null) valid_from, date(null) valid_until, true active from range(70)")
    moved = []
    for seconds in (60.0, 80_000.0):
        recs = spark.range(50).selectExpr("id", "concat('c', id % 2) classroom_id", "timestamp'2024-01-01 00:30:00' recording_started_at", f"{seconds}D duration_seconds")
        before = _shuffled(spark)
        assert len(schedules.propose_intervals(recs, slots, "UTC", "same_day").collect()) == 50 * 35
        moved.append(_shuffled(spark) - before)
    assert moved[0] == moved[1] < 300, moved


def test_calendar_shuffles_no_rows_by_hour(spark):
    """Recordings of 22 hours that stay within their day shuffle no more than short ones, and those of two days twice as much at most."""
    slots = spark.sql("select id, concat('c', id % 2) classroom_id, cast(id % 7 as int) day_of_week, 0 start_time, 86000 end_time, date(null) valid_from, date(null) valid_until, true active from range(70)")
    moved = []
    for seconds in (60.0, 80_000.0, 160_000.0):
        recs = spark.range(50).selectExpr("id", "concat('c', id % 2) classroom_id", "timestamp'2024-01-01 00:30:00' recording_started_at", f"{seconds}D duration_seconds")
        before = _shuffled(spark)
        assert len(schedules.propose_intervals(recs, slots, "UTC", "calendar").collect()) == 50 * 5 * (1 + (seconds > 86_400))
        moved.append(_shuffled(spark) - before)
    assert moved[0] == moved[1] < moved[2] <= 2 * moved[0], moved


def test_counted_quantiles_are_exact(spark):
    """More values than a sketch holds: ranks as in a sorted list, from days added up."""
    rng = random.Random(8)
    rows = [(f"2024-01-{i % 7 + 1:02d}", "p" if i % 5 else None, "m", float(int(rng.expovariate(0.001))) if i % 9 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "day string, provider_name string, model_name string, processing_seconds double")
    df = df.withColumns({"created_at": F.col("day").cast("timestamp"), "started_at": F.lit(None).cast("timestamp"), "completed_at": F.lit(None).cast("timestamp"), "clip_seconds": F.lit(1.0)})
    got = {r.provider_name: r for r in metrics.counted_quantiles(metrics.quantile_counts(df), "provider_name").collect()}
    for provider in ("p", None):
        values = sorted(v for _, p, _, v in rows if p == provider and v is not None)
        r = got[provider]
        assert (r.jobs, r.rtf_n, r.wait_n, r.wait_p50) == (sum(p == provider for _, p, _, _ in rows), len(values), 0, None)
        assert (r.rtf_p50, r.rtf_p95) == (values[-(-len(values) // 2) - 1], values[-(-len(values) * 95 // 100) - 1])
