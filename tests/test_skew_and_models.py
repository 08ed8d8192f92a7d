"""Crowded cells, concurrent model calls, and the cleaning report."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from chapterflow.operators import cleaning
from chapterflow.operators import models as A
from chapterflow.operators import timeline as L


@pytest.mark.parametrize(("cell_rows", "broadcast"), [(100_000, 10_000), (50, 10_000), (50, 0)])
def test_interval_join_with_one_crowded_cell(spark, monkeypatch, cell_rows, broadcast):
    monkeypatch.setattr(L, "BROADCAST_CELLS", broadcast)
    rng = random.Random(1)
    words = [(1, k, *((5.0, 6.0) if k % 10 else sorted(rng.uniform(0, 900) for _ in range(2)))) for k in range(900)]
    spans = [(1, n, a, a + rng.uniform(0, 200)) for n, a in enumerate(rng.uniform(0, 800) for _ in range(40))] + [(2, 1, 0.0, 9.0)]
    w = spark.createDataFrame(words, "video_id long, pos long, start_s double, end_s double")
    c = spark.createDataFrame(spans, "video_id long, number long, start_s double, end_s double")
    got = sorted((r.pos, r.number) for r in L.interval_join(w, c, cell_rows=cell_rows).collect())
    assert got == sorted((k, n) for _, k, a, b in words for v, n, x, y in spans if v == 1 and b >= x and a <= y)


def test_crowded_cells_get_salts_after_their_count(spark):
    df = spark.createDataFrame([(1,)] * 90 + [(2,)] * 10 + [(3,)] * 21, "cell int")
    assert {r.cell: r["__salts"] for r in L.crowded_cells(df, ["cell"], 20).collect()} == {1: 5, 3: 2}


def test_windows_cut_by_the_end_of_the_video(spark):
    words = [(1, k, "w", s, e, 0.1 * k) for k, (s, e) in enumerate([(1.0, 2.0), (59.0, 61.0), (60.0, 60.0), (61.0, 62.0), (64.0, 66.0), (65.0, 65.0), (70.0, 71.0)])]
    w = spark.createDataFrame(words, "video_id long, pos long, word string, start_s double, end_s double, confidence double")
    t = spark.createDataFrame([(1, 65.0), (2, 30.0)], "video_id long, duration_s double")
    got = sorted(tuple(r) for r in L.confidence_windows(t, w).collect())
    want = []
    for window, (a, b) in enumerate([(0.0, 60.0), (60.0, 65.0)]):
        inside = [c for *_, s, e, c in words if s >= a and e <= b]
        want.append((1, window, a, b, len(inside), pytest.approx(sum(inside) / len(inside))))
    assert got == want


def slow_model():
    """A stub that travels by value."""

    def slow_stub(prompt):
        time.sleep(0.02)
        if prompt.endswith("!"):
            raise A.TransientError("429")
        if prompt.endswith("?"):
            raise A.PermanentError("refused")
        return prompt.upper()

    return slow_stub


@pytest.mark.parametrize("concurrency", [1, 8])
def test_concurrent_calls_keep_the_order_of_the_log(spark, concurrency):
    A.register_model("slow", slow_model())
    A.register_model("sure", lambda prompt: prompt.title())
    rows = [(k, f"p{k}" + "!?."[k % 3]) for k in range(60)]
    df = spark.createDataFrame(rows, "request_id long, prompt string").coalesce(1)
    log = A.apply_model(df, ["slow", "sure"], base_delay_s=0.0, partitions=1, concurrency=concurrency).collect()
    want = []
    for k, prompt in rows:
        tries = {"!": ["transient"] * 3, "?": ["permanent"], ".": []}[prompt[-1]]
        want += [(k, n, "slow", False, kind) for n, kind in enumerate(tries, 1)]
        want.append((k, len(tries) + 1, "sure" if tries else "slow", True, None))
    order = list(dict.fromkeys(r.request_id for r in log))
    assert sorted((r.request_id, r.attempt, r.provider, r.success, r.error_class) for r in log) == sorted(want, key=lambda x: x[:2])
    assert [(r.request_id, r.attempt) for r in log] == [(k, a) for i in order for k, a, *_ in want if k == i]


def test_calls_of_a_task_run_side_by_side(spark):
    A.register_model("slow", slow_model())
    df = spark.createDataFrame([(k, "p.") for k in range(200)], "request_id long, prompt string")
    begun = time.monotonic()
    assert A.apply_model(df, ["slow"], partitions=1, concurrency=50).count() == 200
    assert time.monotonic() - begun < 200 * 0.02


def test_token_bucket():
    now = [0.0]
    waits = []
    bucket = A.TokenBucket(2.0, 3, clock=lambda: now[0], sleep=waits.append)
    for _ in range(6):
        bucket.take()
    assert waits == [0.5, 1.0, 1.5]
    now[0] = 10.0
    bucket.take()
    assert len(waits) == 3
    threads = [threading.Thread(target=bucket.take) for _ in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert sorted(waits[3:]) == [0.5, 1.0]


def test_cleaning_report(spark):
    rng = random.Random(2)
    rows = [(f"g{k % 3}", "x" * rng.randrange(0, 50) + " " * rng.randrange(0, 9)) for k in range(400)] + [("g1", None), (None, " a ")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    got = {r.lang: r for r in cleaning.cleaning_report(df, clean=F.rtrim, shares=(0.5, 0.99)).collect()}
    for lang in ("g0", "g1", "g2", None):
        own = [(len(t), len(t.rstrip(" "))) for g, t in rows if g == lang and t is not None]
        lost = sorted(1 - b / a if a else 0.0 for a, b in own)
        r = got[lang]
        assert (r.n_docs, r.chars_before, r.chars_after) == (len(own), sum(a for a, _ in own), sum(b for _, b in own))
        assert r.p50_reduction == lost[-(-len(lost) // 2) - 1] and r.p99_reduction == lost[min(len(lost), -(-99 * len(lost) // 100)) - 1]
