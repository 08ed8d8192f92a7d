"""Words folded where they are read: few rows are shuffled, and nothing depends on the order in which words come."""

import random

import pytest
from pyspark.sql import functions as F

from chapterflow.operators import chapters as C
from chapterflow.operators import timeline as L
from chapterflow.streaming import live

WORDS = "video_id bigint, pos bigint, word string, start_s double, end_s double, confidence double"


def _shuffled_rows(df):
    """Rows that a finished query wrote to its shuffles."""

    def walk(plan):
        name = plan.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        if name.startswith("ReusedExchange"):
            return 0
        written = plan.metrics().get("shuffleRecordsWritten")
        children = plan.children().iterator()
        n = written.get().value() if written.isDefined() else 0
        while children.hasNext():
            n += walk(children.next())
        return n

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def _words(spark, rng, order):
    """Words of four videos, some early and some behind a pause; places of video 3 have holes, video 4 comes twice."""
    rows = []
    for v in (1, 2, 3, 4, None):
        at = 0.0
        for p in range(120):
            at = round(at + rng.choice([0.1, 0.4, 0.9, 1.5]), 3)
            row = (v, p * (2 if v == 3 else 1), f"w{p % 7}{'.' if p % 11 == 0 else ''}", at, round(at + rng.choice([0.2, 0.3, 0.7]), 3), 0.5)
            rows += [row] * (2 if v == 4 else 1)
    given = list(rows)
    if order == "mixed":
        rng.shuffle(given)
    return rows, spark.createDataFrame(given, WORDS).repartition(1 if order == "whole" else 3)


@pytest.mark.parametrize("order", ["whole", "cut", "mixed"])
def test_word_order(spark, order):
    rows, words = _words(spark, random.Random(1), order)
    expected = []
    for a, b in zip(rows, rows[1:], strict=False):
        if a[0] == b[0] and a[0] is not None and b[3] < a[4]:
            expected.append((b[0], b[1], f"Word '{b[2]}' at {b[3]}s starts before '{a[2]}' ends at {a[4]}s"))
    for size in (7, 65536):
        assert sorted(map(tuple, L.word_order_issues(words, size).collect())) == sorted(expected)


@pytest.mark.parametrize("order", ["whole", "cut", "mixed"])
def test_live_captions(spark, order):
    rows, words = _words(spark, random.Random(2), order)
    expected, reach = [], 0.0
    for k, r in enumerate(rows):
        if not k or rows[k - 1][0] != r[0] or r[3] > reach + 1e-9:
            expected.append([r[0], r[3], r[4], 0, []])
            reach = 0.0
        said = expected[-1]
        reach = max(reach, r[4] + 0.5)
        expected[-1] = [said[0], said[1], max(said[2], r[4]), said[3] + 1, [*said[4], r[2]]]
    got = live.captions_live(words.withColumn("ts", live.event_time(F.col("start_s")))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(((*r[:4], " ".join(r[4])) for r in expected), key=key)


def test_few_rows_are_shuffled(spark):
    rows = [(v, k, "uno", k * 1.0 + (k // 20), k + (k // 20) + (1.2 if k % 500 == 1 else 0.8), 0.5) for v in range(3) for k in range(1000)]
    words = spark.createDataFrame(rows, WORDS).coalesce(1)
    issues = L.word_order_issues(words)
    assert _shuffled_rows(issues) < 50 and issues.count() == 6
    captions = live.captions_live(words.withColumn("ts", live.event_time(F.col("start_s"))))
    assert _shuffled_rows(captions) < 400 and captions.count() == 150


def test_snap_sorts_once(spark):
    probes = spark.createDataFrame([(1, 1, 0.5, 10.0), (1, 2, -1.0, None), (1, 3, 1.0, 10.0)], "video_id long, probe_id long, ratio double, duration_s double")
    segments = spark.createDataFrame([(1, 0, 0.0, 1.0, "a"), (1, 1, 7.0, 8.0, "b")], "video_id long, pos long, start_s double, end_s double, text string")
    found = L.snap_to_segments(probes, segments)
    assert sorted((r.probe_id, r.at_s) for r in found.collect()) == [(1, 7.0), (2, 0.0), (3, 10.0)]
    run = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    sorts = [x for x in run.splitlines() if " Sort [" in x and " t#" in x]
    assert len(sorts) == 1
    assert len([x for x in run.splitlines() if "REPARTITION_BY_COL" in x and "ReusedExchange" not in x]) == 1


def test_block_chapters_are_computed_once(spark):
    plan = spark.createDataFrame([(v, b, 10.0 * b) for v in (1, 2) for b in (1, 2, 3)], "video_id long, block long, start_s double")
    said = spark.createDataFrame(
        [(v, b, n, 1.0 * n, n + 1.0, {"a": "b"}) for v in (1, 2, None) for b in (1, 3) for n in (1, 2)],
        "video_id long, block long, number long, start_s double, end_s double, seen map<string, string>",
    )
    found = C.merge_block_chapters(said, plan, size=2)[0].drop("end_s", "start_time")
    got = sorted((r.video_id, r.block, r.number, r.start_s, r.seen["a"]) for r in found.collect())
    assert got == [(v, b, n, 10.0 * b + (n - 1) % 2 + 1, "b") for v in (1, 2) for b, n in ((1, 1), (1, 2), (3, 3), (3, 4))]
    run = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len([x for x in run.splitlines() if "REPARTITION_BY_COL" in x and "ReusedExchange" not in x]) == 1
