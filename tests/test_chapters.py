import random

import pytest
from pyspark.sql import functions as F

from chapterflow.operators import chapters as C
from chapterflow.operators import chunks as K

SCHEMA = "video_id long, number long, start_s double, end_s double, duration_s double"


def sequential_repair(chapters):
    out = []
    for i, (_, n, s, e, d) in enumerate(chapters):
        if i:
            s = max(s, out[-1][2] + 0.1)
        if e <= s:
            e = s + 1.0
        out.append([n, s, min(e, d)])
    d = chapters[0][4]
    if out[0][1] > 1.0:
        out[0][1] = 0.0
    if out[-1][2] < d - 1.0:
        out[-1][2] = d
    for i in range(1, len(out)):
        if out[i][1] < out[i - 1][2]:
            out[i][1] = out[i - 1][2] + 0.1
        elif out[i][1] > out[i - 1][2] + 5.0:
            out[i - 1][2] = out[i][1] - 0.1
    return [tuple(round(x, 6) for x in c) for c in out]


@pytest.mark.parametrize("size", [3, 4096])
def test_repair(spark, size):
    rng = random.Random(size)
    rows = []
    for v in range(40):
        d, t = 200.0, 0.0
        for n in range(1, rng.randrange(2, 25)):
            s = t + rng.choice([-9, -1, 0, 0.05, 3, 20])
            e = s + rng.choice([-3, 0, 0.5, 1.0, 1.05, 8, 30])
            rows.append((v, n, s, e, d))
            t = max(t, e) if rng.random() < 0.8 else t
    got = {}
    for r in C.repair_chapters(spark.createDataFrame(rows, SCHEMA), size=size).orderBy("video_id", "number").collect():
        got.setdefault(r.video_id, []).append((r.number, round(r.start_s, 6), round(r.end_s, 6)))
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r)
    assert got == {v: sequential_repair(c) for v, c in want.items()}


def test_index_parts_join_to_the_whole(spark):
    rows = [(1, n, f"T{n}", float(n * 10), n * 10 + 9.0, "texto") for n in range(1, 12)]
    df = spark.createDataFrame(rows, "video_id long, number long, title string, start_s double, end_s double, transcript string")
    whole = C.chapter_index(df, "now").collect()
    parts = C.chapter_index(df, "now", entries_per_part=4, block_s=25.0).orderBy("part").collect()
    assert len(whole) == 1 and len(parts) == 3
    assert "\n".join(p.markdown for p in parts) == whole[0].markdown
    assert whole[0].markdown.startswith("# Chapters\n\nTotal: 11 chapters") and whole[0].markdown.count("---") == 10
    assert "## 01 — T1\n" in whole[0].markdown and "## 11 — T11\n" in whole[0].markdown


def test_validation_rejects_whole_response(spark):
    cols = "video_id long, number long, title string, start_time string, end_time string, start_seconds double, end_seconds double, confidence double, transcript string"
    good = (1, 1, "t", "a", "b", 0.0, 1.0, 1.0, "x")
    rows = [good, (2, 1, "t", "a", "b", 0.0, 1.0, 1.2, "x"), (2, 2, "t", "a", "b", 0.0, 1.0, 0.5, "x"), (3, None) + good[2:]]
    ok, bad = C.validate_chapters(spark.createDataFrame(rows, cols))
    assert [r.video_id for r in ok.collect()] == [1]
    assert sorted(r.video_id for r in bad.collect()) == [2, 2, 3]


def test_review_threshold_is_strict(spark):
    df = spark.createDataFrame([(0.7,), (0.69,)], "confidence double")
    assert sorted(r.needs_review for r in C.flag_for_review(df).collect()) == [False, True]


@pytest.mark.parametrize("minutes, overlap, duration", [(20, 30, 2700.0), (10, 30, 1500.0), (10, 30, 600.0), (1, 10, 61.0), (1, 10, 110.0)])
def test_chunks_match_the_loop(spark, minutes, overlap, duration):
    want, start = [], 0.0
    while True:
        end = min(start + minutes * 60, duration)
        want.append((start, end))
        if end >= duration:
            break
        start = end - overlap
    df = spark.createDataFrame([(1, duration)], "video_id long, duration_s double")
    got = K.plan_chunks(df, minutes, overlap).orderBy("chunk_index").collect()
    assert [(r.start_s, r.end_s) for r in got] == want


def test_overlap_must_be_shorter(spark):
    with pytest.raises(ValueError):
        K.plan_chunks(spark.createDataFrame([(1, 5.0)], "video_id long, duration_s double"), 1, 60)


def test_reassembly_marks_failures(spark):
    chunks = spark.createDataFrame([(1, 0, 0.0, 600.0), (1, 1, 570.0, 1170.0), (2, 0, 0.0, 60.0)], "video_id long, chunk_index long, start_s double, end_s double")
    results = spark.createDataFrame([(1, 1, "hola", 0.8, "groq", "m")], "video_id long, chunk_index long, text string, confidence double, provider string, model string")
    words = spark.createDataFrame([(1, 1, 0, "hola", 1.0, 2.0, 0.8)], "video_id long, chunk_index long, pos long, word string, start_s double, end_s double, confidence double")
    one, two = K.reassemble(chunks, results).orderBy("video_id").collect()
    assert (one.text, one.confidence, one.duration_s, one.provider) == ("[TRANSCRIPTION_FAILED] hola", 0.8, 1170.0, "groq")
    assert (two.text, two.confidence, two.provider, two.failed_chunks) == ("[TRANSCRIPTION_FAILED]", 0.0, "unknown", 1)
    assert [(w.pos, w.start_s, w.end_s) for w in K.reassembled_words(chunks, words).collect()] == [(0, 571.0, 572.0)]
    split = K.reassembled_text(chunks, results, chunks_per_part=1).filter("video_id = 1").orderBy("part").collect()
    assert " ".join(p.text for p in split) == one.text
