"""Timeline operators against sequential brute force, with blocks small
enough for every case to cross a block border."""

import random

import pytest
from pyspark.sql import functions as F

from chapterflow.operators import timeline as L
from chapterflow.sources.asr import explode_words

WORDS = "video_id long, pos long, word string, start_s double, end_s double, confidence double"


def random_words(seed, videos=12, most=140, quiet=False):
    rng = random.Random(seed)
    rows = []
    for v in range(videos):
        t = 0
        for p in range(rng.randrange(1, most)):
            word = rng.choice(["hola", "casa", "la", "eh", "no", "x", "la"])
            if not quiet and rng.random() < 0.08:
                word += rng.choice(".!?:;")
            t += rng.choice([50, 100, 500, 510, 900]) if rng.random() < 0.2 and not quiet else 50
            rows.append((v, p, word, t / 1000, (t + 200) / 1000, rng.randrange(50, 100) / 100))
            t += 200
    return rows


def by_video(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


def sequential_captions(words, gap, most, legacy):
    caps, cur = [], []
    for i, w in enumerate(words):
        cur.append(w)
        close = any(c in w[2] for c in ".!?:;") or len(cur) >= most
        if i + 1 < len(words):
            close = close or words[i + 1][3] - w[4] > gap
        if close:
            caps.append(list(cur))
            if i + 1 < len(words) or not legacy:
                cur = []
    if cur:
        caps.append(cur)
    return [(c[0][3], c[-1][4], " ".join(w[2] for w in c)) for c in caps]


@pytest.mark.parametrize("quiet", [False, True])
@pytest.mark.parametrize("block, legacy", [(7, False), (7, True), (64, False), (65536, True)])
def test_captions(spark, block, legacy, quiet):
    rows = random_words(block + quiet, quiet=quiet)
    got = L.captions(spark.createDataFrame(rows, WORDS), block_words=block, legacy_duplicate_tail=legacy).collect()
    have = {}
    for r in sorted(got, key=lambda r: (r.video_id, r.cue)):
        have.setdefault(r.video_id, []).append((r.start_s, r.end_s, r.text))
    assert have == {v: sequential_captions(ws, 0.5, 25, legacy) for v, ws in by_video(rows).items()}
    for v in have:
        assert [r.cue for r in sorted(got, key=lambda r: r.cue) if r.video_id == v] == list(range(1, len(have[v]) + 1))


def test_srt_text_and_parts(spark):
    rows = [(1, 0, "Hola", 0.0, 0.5, 1.0), (1, 1, "mundo.", 0.6, 1.0, 1.0), (1, 2, "Fin.", 5.0, 5.5, 1.0)]
    caps = L.captions(spark.createDataFrame(rows, WORDS))
    whole = "1\n00:00:00,000 --> 00:00:01,000\nHola mundo.\n\n2\n00:00:05,000 --> 00:00:05,500\nFin.\n"
    assert [r.srt for r in L.srt_documents(caps).collect()] == [whole]
    parts = L.srt_documents(caps, cues_per_part=1).orderBy("part").collect()
    assert len(parts) == 2 and "\n".join(p.srt for p in parts) == whole


@pytest.mark.parametrize("bucket", [0.5, 7.0, 1000.0])
def test_interval_join(spark, bucket):
    rng = random.Random(3)
    span = lambda: (lambda a: (a, a + rng.choice([0, 1, 5, 40])))(rng.randrange(0, 60))
    many = [(rng.randrange(3), i, *map(float, span())) for i in range(60)]
    few = [(rng.randrange(3), i, *map(float, span())) for i in range(15)]
    l = spark.createDataFrame(many, "video_id int, a int, start_s double, end_s double")
    r = spark.createDataFrame(few, "video_id int, b int, start_s double, end_s double")
    got = sorted((x.a, x.b) for x in L.interval_join(l, r, bucket_s=bucket).collect())
    assert got == sorted((m[1], f[1]) for m in many for f in few if m[0] == f[0] and m[3] >= f[2] and m[2] <= f[3])


def test_clean_words(spark):
    rows = random_words(9) + [(99, i, "eh", i * 1.0, i + 0.5, 1.0) for i in range(9)]
    kept = {}
    for v, ws in by_video(rows).items():
        out, prev = [], None
        for w in ws:
            s = w[2].strip().lower()
            if s in L.NOISE_WORDS or (prev and s == prev) or (len(s) <= 2 and s not in L.KEPT_SHORT_WORDS):
                continue
            out.append(w[1])
            prev = s
        kept[v] = out or [w[1] for w in ws]
    got = {}
    for r in L.clean_words(spark.createDataFrame(rows, WORDS), block_words=5).collect():
        got.setdefault(r.video_id, []).append(r.pos)
    assert {v: sorted(p) for v, p in got.items()} == kept


def test_snap(spark):
    rng = random.Random(5)
    segs, probes = [], []
    for v in range(5):
        at = 0.0
        for i in range(30):
            at += rng.choice([1, 3, 9])
            segs.append((v, i, at, at + rng.choice([1, 2, 12]), "s"))
        probes += [(v, i, i / 20 - 0.1, at + 5) for i in range(25)]

    def snap(v, ratio, d):
        if ratio <= 0:
            return 0.0
        if ratio >= 1:
            return d
        t, mine = ratio * d, [s for s in segs if s[0] == v]
        if any(s[2] <= t <= s[3] for s in mine):
            return t
        return min(mine, key=lambda s: abs(s[2] - t))[2]

    s = spark.createDataFrame(segs, "video_id long, pos long, start_s double, end_s double, text string")
    p = spark.createDataFrame(probes, "video_id long, probe_id long, ratio double, duration_s double")
    for block in (10.0, 3600.0):
        got = {(r.video_id, r.probe_id): r.at_s for r in L.snap_to_segments(p, s, block_s=block).collect()}
        assert got == {(v, i): snap(v, ratio, d) for v, i, ratio, d in probes}


def test_confidence_window_borders(spark):
    words = [(1, 0, "a", 0.0, 59.0, 0.4), (1, 1, "b", 60.0, 60.0, 0.8), (1, 2, "c", 100.0, 130.0, 0.2), (1, 3, "d", 121.0, 124.0, 0.6)]
    t = spark.createDataFrame([(1, 125.0), (2, 50.0)], "video_id long, duration_s double")
    got = L.confidence_windows(t, spark.createDataFrame(words, WORDS)).orderBy("window").collect()
    assert [(r.start_s, r.end_s, round(r.confidence, 6)) for r in got] == [(0.0, 60.0, 0.6), (60.0, 120.0, 0.8), (120.0, 125.0, 0.6)]


def test_failed_regions(spark):
    t = spark.createDataFrame(
        [(1, "a [TRANSCRIPTION_FAILED] b", 20.0), (2, "[TRANSCRIPTION_FAILED]", 9.0), (3, "fine", 20.0)],
        "video_id long, text string, duration_s double",
    )
    words = [(v, p, "w", s, s + 1, 1.0) for v in (1, 3) for p, s in enumerate([0.0, 5.9, 12.0])]
    got = L.failed_regions(t, spark.createDataFrame(words, WORDS)).collect()
    assert sorted(map(tuple, got)) == [(1, 6.9, 12.0), (2, 0.0, 9.0)]


def test_words_come_from_arrays(spark):
    t = spark.sql("select 1L video_id, array(named_struct('word','a','start',0D,'end',1D,'confidence',1D)) words")
    assert [tuple(r) for r in explode_words(t).collect()] == [(1, 0, "a", 0.0, 1.0, 1.0)]


def test_no_window_over_a_whole_video(spark):
    """Word rows are windowed by (video, block), never by video alone."""
    df = spark.range(100).select(
        F.lit(1).alias("video_id"), F.col("id").alias("pos"), F.lit("a").alias("word"),
        (F.col("id") * 1.0).alias("start_s"), (F.col("id") + 0.5).alias("end_s"), F.lit(1.0).alias("confidence"),
    )
    plan = L.captions(df)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if " Window [" in line and "pos#" in line:
            assert "__block#" in line
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_captions_shuffle_their_words_once(spark):
    rows = [(v, k, f"uno{'.' if k % 9 == 0 else ''}", k * 1.0, k + 0.8, 0.5) for v in range(3) for k in range(200)]
    words = spark.createDataFrame(rows, "video_id bigint, pos bigint, word string, start_s double, end_s double, confidence double")
    found = L.captions(words, block_words=64)
    assert found.count() == len({(r.video_id, r.cue) for r in found.collect()})
    run = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([x for x in run.splitlines() if "REPARTITION_BY_COL" in x and "ReusedExchange" not in x]) == 1
