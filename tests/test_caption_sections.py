"""Captions from sections of words, and interval joins of packs: as few rows are shuffled, and nothing depends on the order in which words come."""

import random
import re

import pytest
from pyspark.sql import functions as F
from test_runs import WORDS, _shuffled_rows, _words

from chapterflow.operators import runs
from chapterflow.operators import timeline as L


def _sequential(rows, gap_s, max_words, twice):
    """Captions of words in order, word by word."""
    out = []
    for video in sorted({r[0] for r in rows if r[0] is not None}):
        caps, said = [], []
        for _, _, word, start, end, _ in sorted((r for r in rows if r[0] == video), key=lambda r: r[1]):
            if not word.strip():
                continue
            if said and start is not None and said[-1][2] is not None and start - said[-1][2] > gap_s:
                caps.append(said)
                said = []
            said.append((word, start, end))
            if len(said) == max_words or re.search("[.!?:;]", word):
                caps.append(said)
                said = []
        if said:
            caps.append(said)
        elif twice and caps:
            caps.append(caps[-1])
        out += [(video, k, c[0][1], c[-1][2], len(c), " ".join(w for w, _, _ in c)) for k, c in enumerate(caps, 1)]
    return out


@pytest.fixture(params=[5, 10_000])
def batch_rows(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield request.param
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("order", ["whole", "cut", "mixed"])
def test_captions(spark, order, batch_rows):
    for seed in (1, 2):
        rows, words = _words(spark, random.Random(seed), order)
        got = L.captions(words, gap_s=0.5, max_words=4, legacy_duplicate_tail=seed == 2, block_words=16)
        assert sorted(map(tuple, got.collect())) == sorted(_sequential(rows, 0.5, 4, seed == 2))


def test_words_without_times_or_letters(spark, batch_rows):
    rng, rows = random.Random(4), []
    for v in (1, 2):
        for p in range(90):
            at = rng.choice([None, 0.4 * p])
            rows.append((v, p, rng.choice(["a", "b", "c.", " ", " "]), at, rng.choice([None, 0.4 * p + 0.3]), None))
    got = L.captions(spark.createDataFrame(rows, WORDS).coalesce(1), max_words=3)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, _sequential(rows, 0.5, 3, False)))


def test_few_rows_are_shuffled(spark):
    rows = [(v, p, f"w{p % 7}", 0.4 * p, 0.4 * p + 0.3, 0.5) for v in range(4) for p in range(3000)]
    words = spark.createDataFrame(rows, WORDS).coalesce(1)
    assert _shuffled_rows(L.captions(words)) < 200  # before: one row for each word
    probes = spark.createDataFrame([(v, p, 10.0 * p + 0.1) for v in range(4) for p in range(20)], "video_id bigint, probe_id bigint, at_s double")
    assert _shuffled_rows(L.word_at(words, probes)) < 3000  # before: two rows for each word


@pytest.mark.parametrize("order", ["whole", "mixed"])
def test_packed_intervals(spark, order, batch_rows, monkeypatch):
    monkeypatch.setattr(runs, "PACK", 3)
    rows, words = _words(spark, random.Random(6), order)
    rng = random.Random(7)
    spans = [(v, n, a, a + rng.choice([0.0, 2.0, 30.0])) for v in (1, 3, 4) for n, a in enumerate(rng.uniform(0, 90) for _ in range(8))]
    chapters = spark.createDataFrame(spans, "video_id bigint, number bigint, start_s double, end_s double")
    expected = sorted((w[0], n, w[1], w[2]) for w in rows for v, n, a, b in spans if w[0] == v and w[4] >= a and w[3] <= b)
    for cell_rows in (2, 100_000):
        got = L.interval_join(words, chapters, bucket_s=5.0, cell_rows=cell_rows)
        assert got.columns == [*words.columns, "number", "start_s_r", "end_s_r"]
        assert sorted(map(tuple, got.select("video_id", "number", "pos", "word").collect())) == expected
    probes = spark.createDataFrame([(v, n, a) for v, n, a, _ in spans], "video_id bigint, probe_id bigint, at_s double")
    at = {(v, n): min(((w[1], w[2]) for w in rows if w[0] == v and w[3] <= a <= w[4]), default=(None, None)) for v, n, a, _ in spans}
    got = L.word_at(words, probes).select("video_id", "probe_id", F.struct("pos", "word")).collect()
    assert {(v, n): tuple(x) for v, n, x in map(tuple, got)} == at


def test_sections_are_shuffled_once(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, words = _words(spark, random.Random(1), "whole")
        found = L.captions(words)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "hashpartitioning" in plan and not re.search(r"hashpartitioning\([^)]*(said|own)#", plan)
