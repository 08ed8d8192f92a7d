"""Damaged model answers: what is mended, kept, scraped or given up."""

import json

import pytest

from chapterflow.sources import responses

CHAPTER = {"number": 1, "title": "a {b", "start_time": "0", "end_time": "1", "start_seconds": 0.0, "end_seconds": 1.0, "confidence": 0.5, "transcript": 'x "y" } z'}
ONE, TWO = (json.dumps(CHAPTER | {"number": n}) for n in (1, 2))
CASES = [
    ('Nota [uno]: {number: 1, title: "a",} fin', "mended", [1]),
    ('{number: 1, title: "a",} ver [dos]', "mended", [1]),
    ('[{number: 1, title: "a"}, {number: 2, title: "b",},] {nada}', "mended", [1, 2]),  # at its square brackets
    (f"[{ONE},{TWO},]", "mended", [1, 2]),
    (f"[{ONE},{TWO},{{\"number\":3,\"title\":\"cor{{t", "balanced", [1, 2]),
    (f'{{"chapters": [{ONE}, {TWO}, {{"number": 3', "balanced", [1, 2]),
    (f"uno {ONE} y {TWO} fin", "balanced", [1, 2]),
    ('{"other": {"x": 1}, "y": [', "scraped", [None]),
    ("number: 7, title: b", "scraped", [7]),
    ("nada", "failed", []),
    ("", "failed", []),
    (None, "failed", []),
    ("{" * 3000 + ONE, "balanced", [1]),
    ('{"' + 'a"' * 20000, "failed", []),
]


@pytest.fixture(scope="module")
def read(spark):
    rows = [(k, k % 2, text) for k, (text, _, _) in enumerate(CASES)]
    got = responses.read_chapters(spark.createDataFrame(rows, "video_id long, block int, text string"), ("video_id", "block"))
    return {r.video_id: r for r in got.collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(read, k):
    text, stage, numbers = CASES[k]
    assert (read[k].parse_stage, [c.number for c in read[k].chapters or []], read[k].block) == (stage, numbers, k % 2)
    sound = all(c.transcript is not None for c in read[k].chapters or [])
    assert read[k].verdict == ("unread" if not numbers else "ok" if sound else "incomplete")


def test_strings_keep_their_braces(read):
    assert {c.transcript for c in read[4].chapters} == {'x "y" } z'} and read[4].chapters[0].title == "a {b"


def test_rejected_enrichments_read_each_answer_once(spark):
    rows = spark.createDataFrame([(1, 1, '{"chapter": {}}'), (2, 1, "nada")], "video_id bigint, number bigint, text string")
    _, bad = responses.parse_enrichments(rows)
    assert {r.video_id: r.reason.count(",") for r in bad.collect()} == {1: 4, 2: 5}
    assert bad._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
