import json
import os

import pytest
from pyspark.sql import functions as F

from chapterflow.operators import blocks
from chapterflow.operators import models as A
from chapterflow.operators import ops as O
from chapterflow.plans import fixtures as X
from chapterflow.sources import asr, media, responses
from chapterflow.sources.stages import StageStore, publish
from chapterflow.streaming import jobs, live


@pytest.mark.parametrize(
    "text, stage, rows",
    [
        ('[{"number":1},{"number":2}]', "whole", 2),
        (' {"number":1} ', "whole", 1),
        ('Aqui: {"number":1} fin', "object", 1),
        ('```json\n[{"number":1},{"number":2}]\n```', "array", 2),
        ("x {number:1, title:\"a\",} y", "mended", 1),
        ('Vale: [{"number":1},{"number":2},] fin', "mended", 2),
        ('number: 1, title: "b"\n', "scraped", 1),
        ("nada", "failed", 0),
    ],
)
def test_parse_stages(spark, text, stage, rows):
    df = spark.createDataFrame([(1, text)], "video_id long, text string")
    parsed, bad = responses.parse_chapters(df)
    got = parsed.collect()
    assert len(got) == rows and all(r.parse_stage == stage for r in got)
    assert [r.parse_stage for r in bad.collect()] == ([] if rows else ["failed"])


def test_first_of_embedded_array(spark):
    df = spark.createDataFrame([(1, 'x [{"number":1},{"number":2}] y')], "video_id long, text string")
    assert [r.number for r in responses.parse_chapters(df, array_mode="first")[0].collect()] == [1]


def test_segmented_ingest_without_words(spark):
    body = json.dumps({"text": " " + "a" * 30 + " ", "segments": []})
    df = spark.createDataFrame([(1, body, "p", "x"), (2, json.dumps({"text": " "}), "p", "tiny")], "video_id long, body string, provider string, model string")
    one, two = asr.ingest_asr(df, "segmented").orderBy("video_id").collect()
    assert (one.duration_s, one.confidence, one.error) == (2.0, 0.7, None)
    assert two.error == "Empty transcription result" and two.confidence == 0.6
    known = spark.createDataFrame([(1, 7.0)], "video_id long, duration_s double")
    assert asr.ingest_asr(df, "segmented", media=known).filter("video_id = 1").first().duration_s == 7.0


def test_stage_store(spark, tmp_path):
    store = StageStore(spark, str(tmp_path / "stages"))
    assert not store.exists("segment")
    store.save("segment", spark.range(3))
    assert store.exists("segment") and store.load("segment").count() == 3
    store.clear("segment")
    assert not store.exists("segment")


def test_media_scan_and_publish(spark, tmp_path):
    for name in ("a.MP4", "b.mkv", "c.txt"):
        (tmp_path / name).write_bytes(b"12345")
    found = media.scan_media(spark, str(tmp_path)).collect()
    assert sorted((os.path.basename(r.path), r.size_bytes, r.extension) for r in found) == [("a.MP4", 5, ".mp4"), ("b.mkv", 5, ".mkv")]
    docs = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "video_id long, part long, srt string")
    publish(docs, str(tmp_path / "out"), partitions=4)
    assert sorted(r.srt for r in spark.read.json(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_attempt_scan(spark, tmp_path, sf_dir):
    X.attempts(spark, sf_dir).drop("status").write.parquet(str(tmp_path / "attempts"))
    assert media.scan_attempts(spark, str(tmp_path / "attempts")).count() == X.attempts(spark, sf_dir).count()


def test_model_retries_and_fallback(spark):
    def flaky(prompt):
        raise A.TransientError("429")

    A.register_model("flaky", flaky)
    A.register_model("steady", lambda p: p.upper())
    df = spark.createDataFrame([("r1", "hi")], "request_id string, prompt string")
    log = A.apply_model(df, ["flaky", "steady"]).orderBy("attempt").collect()
    assert [(r.provider, r.success) for r in log] == [("flaky", False)] * 3 + [("steady", True)]
    done = A.resolve_attempts(A.apply_model(df, ["flaky", "steady"])).first()
    assert (done.provider, done.response, done.n_attempts) == ("steady", "HI", 4)
    lost = A.resolve_attempts(A.apply_model(df, ["flaky"], max_retries=1)).first()
    assert (lost.success, lost.error_class, lost.n_attempts) == (False, "transient", 2)


def test_costs(spark):
    rows = [("asr", "groq", 3600.0, 0), ("asr", "openai", 14400.0, 0), ("asr", "new", 60.0, 0), ("model", "openai", 0.0, 50000), ("model", "deepseek", 0.0, 50000)]
    df = spark.createDataFrame(rows, "kind string, provider string, duration_s double, tokens long")
    got = [(round(r.cost_usd, 6), r.defaulted) for r in O.estimate_costs(df).collect()]
    assert got == [(0.024, False), (1.44, False), (0.001, True), (0.125, False), (0.007, False)]


@pytest.mark.parametrize("size", [2, 65536])
def test_budget_equality_passes(spark, size):
    df = spark.createDataFrame([(1, s, 0.25) for s in range(6)], "run_id long, seq long, cost_usd double")
    got = O.budget_gate(df, 1.0, size=size).orderBy("seq").collect()
    assert [r.over_budget for r in got] == [False] * 4 + [True] * 2
    assert O.first_breaches(O.budget_gate(df, 1.0, size=size)).first().seq == 4


def test_resume(spark):
    videos = spark.createDataFrame([(1,), (2,), (3,)], "video_id long")
    status = spark.createDataFrame([(1, "extract", True), (1, "segment", True)] + [(2, s, True) for s in ("extract", "transcribe", "segment", "enrich", "materialize")], "video_id long, stage string, success boolean")
    got = {r.video_id: r.resume_stage for r in O.resume_plan(videos, status).collect()}
    assert got == {1: "transcribe", 2: "done", 3: "extract"}


def sequential_state(events):
    s = dict(current_stage=None, stage_index=0, total_stages=0, stage_progress=0.0, is_running=False, is_complete=False, is_failed=False)
    for e in sorted(events, key=lambda e: e.seq):
        if e.type == "stage_start":
            s.update(current_stage=e.stage, stage_index=e.stage_index, total_stages=e.total_stages, stage_progress=0.0, is_running=True, is_complete=False, is_failed=False)
        elif e.type == "stage_progress":
            s["stage_progress"] = e.progress
        elif e.type == "stage_complete":
            s["stage_progress"] = 1.0
            if s["total_stages"] > 0 and s["stage_index"] >= s["total_stages"] - 1:
                s.update(is_complete=True, is_running=False)
        elif e.type == "stage_error":
            s.update(is_running=False, is_failed=True)
    return s


def test_run_state_is_the_sequential_fold(spark, sf_dir):
    events = X.progress_events(spark, sf_dir)
    runs = {}
    for e in events.collect():
        runs.setdefault(e.run_id, []).append(e)
    for cut in (3, 17, 10**9):
        early = {r: sorted(es, key=lambda e: e.seq)[:cut] for r, es in runs.items()}
        flat = spark.createDataFrame([e for es in early.values() for e in es], events.schema)
        for row in live.run_state(flat).collect():
            want = sequential_state(early[row.run_id])
            assert {k: row[k] for k in want} == want


def test_streams_equal_batch(spark, sf_dir, tmp_path):
    """Many small files, one per trigger, give what one batch gives."""
    events = X.progress_events(spark, sf_dir)
    folder = str(tmp_path / "events")
    events.orderBy("seq").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(folder)
    stream = jobs.read_stream(spark, folder, "*.parquet")
    got = jobs.run_to_table(live.run_state(stream), "update", "t", keys=["run_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, live.run_state(events).collect()))


def test_stream_drops_repeated_words(spark, tmp_path):
    rows = spark.range(40).select(
        F.lit(1).cast("long").alias("video_id"), (F.col("id") % 20).alias("pos"), F.lit("w").alias("word"),
        ((F.col("id") % 20) * 1.0).alias("start_s"), (live.event_time((F.col("id") % 20) * 1.0)).alias("ts"),
    )
    rows.coalesce(1).write.option("maxRecordsPerFile", 15).parquet(str(tmp_path / "w"))
    stream = jobs.read_stream(spark, str(tmp_path / "w"), "*.parquet")
    assert jobs.run_to_table(live.distinct_words_live(stream), "append", "d").count() == 20


def test_streams_of_many_files_equal_one_batch(spark, tmp_path):
    rows = [(1, float(s), f"w{s}", 0.5) for s in (0, 1, 4000, 4010)] + [(2, float(s), f"v{s}", 0.25) for s in (2, 2, 70, 9000)] + [(3, 1.0, "u", 1.0)]
    words = spark.createDataFrame(rows, "video_id long, start_s double, word string, confidence double").withColumn("ts", live.event_time(F.col("start_s")))
    for part in (words.filter("start_s >= 4000"), words.filter("video_id = 2 and start_s < 4000"), words.filter("video_id = 1 and start_s < 4000"), words.filter("video_id = 3")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))  # the late times first
    stream = jobs.read_stream(spark, str(tmp_path / "late"), "*.parquet")
    out = jobs.run_to_table(live.confidence_windows_live(stream), "update", "c", keys=["video_id", "start_ts"])
    want = live.confidence_windows_live(words)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    once = jobs.run_to_table(live.distinct_words_live(stream), "append", "d")
    assert sorted((r.video_id, r.word) for r in once.collect()) == sorted({(v, w) for v, _, w, _ in rows})


def test_rows_without_order_count(spark):
    spend = spark.createDataFrame([("a", None, 5.0), ("a", 1, 0.5), ("a", 70_000, 0.7)], "run_id string, seq long, usd double")
    rows = blocks.spread(spend, ["run_id"], "seq", 10)
    got = blocks.add_running_sum(rows, ["run_id"], "seq", "total", F.col("usd")).collect()
    assert {r.seq: round(r.total, 6) for r in got} == {None: 5.0, 1: 5.5, 70_000: 6.2}


def test_predecessor_across_holes(spark):
    words = spark.createDataFrame([("a", p, p * 1.0) for p in (0, 1, 5, 9, 30)], "video_id string, pos long, end_s double")
    for size in (2, 4, 100):
        got = blocks.with_lag(words, ["video_id"], "pos", size, prev=F.col("end_s")).collect()
        assert {r.pos: r.prev for r in got} == {0: None, 1: 0.0, 5: 1.0, 9: 5.0, 30: 9.0}


def test_stage_written_in_batches(spark, tmp_path):
    store, folder = StageStore(spark, str(tmp_path / "stages")), str(tmp_path / "arrivals")
    seen = []
    for text, ids in (("old", [1, 2, None]), ("new", [2, None])):
        spark.createDataFrame([(i, text) for i in ids], "video_id bigint, text string").write.mode("append").parquet(folder)
        stream = jobs.read_stream(spark, folder, "*.parquet", 100)
        jobs.process_stage(stream, store, "clean", lambda b: seen.append(store.exists("clean")) or b)
        assert store.exists("clean")
    assert seen == [False, False]
    got = {r.video_id: r.text for r in store.load("clean", ["video_id"]).collect()}
    assert got == {1: "old", 2: "new", None: "new"} and store.load("clean").count() == 5
