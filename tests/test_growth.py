"""Steps whose work, shuffles or memory must grow no faster than the input."""

import time

from pyspark.sql import functions as F

from chapterflow.functions import text as T
from chapterflow.operators import chapters as C
from chapterflow.operators import search
from chapterflow.plans import fixtures as X
from chapterflow.sources import responses


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_scraping_reads_a_word_once(spark):
    rows = spark.createDataFrame([(1, "x" * 60_000 + " end"), (2, "ab: 1, " + "y" * 60_000 + ' "cd": "e"')], "n int, t string")
    began = time.monotonic()
    got = dict(rows.select("n", responses.scrape_pairs(F.col("t"))).collect())
    assert time.monotonic() - began < 8
    assert got == {1: None, 2: '{"ab":1,"cd":"e"}'}


def test_preprocess_names_its_text_once(spark):
    rows = spark.createDataFrame([("hola",)], "t string")
    assert _plan(rows.select(T.preprocess(F.col("t")))).split("== Optimized")[0].split("== Analyzed")[0].count(r"\x00-\x08") == 1


def test_texts_are_searched_without_groups(spark):
    texts = spark.createDataFrame([(1, "abcabd"), (1, "xabd"), (2, None), (None, "abc")], "video_id long, text string")
    pieces = spark.createDataFrame([(1, "abd"), (1, "zz"), (2, ""), (None, "c"), (3, "a")], "video_id long, piece string")
    found = search.locate(texts, pieces)
    assert "FlatMapCoGroups" not in _plan(found)
    assert set(map(tuple, found.collect())) == {(1, "abd", 3), (1, "abd", 1), (2, "", 0), (None, "c", 2)}


def test_repair_streams_blocks(spark):
    rows = [(v, n, 10.0 * n, 10.0 * n + (12.0 if n % 2 else 3.0), 95.0) for v in (1, 2) for n in range(1, 10)]
    chapters = spark.createDataFrame(rows, "video_id long, number long, start_s double, end_s double, duration_s double")
    whole, cut = C.repair_chapters(chapters), C.repair_chapters(chapters, size=2)
    assert "FlatMapGroupsIn" not in _plan(cut)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


def test_segments_travel_whole(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, long), (2, "a\n b"), (2, "c"), (3, None), (4, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = X.segments(spark, str(tmp_path))
    assert "collect_list(struct(" not in _plan(found)
    got = {(r.video_id, r.pos): (r.start_s, r.end_s, r.text) for r in found.collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (2, 0)}
    assert got[2, 0] == (0.0, 0.515, "a c b")
    assert got[1, 2] == (11.0, 13.145, " ".join(f"w{i}" for i in range(24, 30)))
