from pyspark.sql import functions as F

from chapterflow.plans import fixtures as X
from chapterflow.plans import flows
from chapterflow.sources.stages import StageStore


def test_from_media_to_chunks(spark, sf_dir):
    plan = flows.plan_transcription(X.media(spark, sf_dir))
    spans = plan.groupBy("video_id").agg(F.max("end_s").alias("e"), F.min("start_s").alias("s"), F.count("*").alias("n"), F.max("n_chunks").alias("m"))
    checked = spans.join(X.media(spark, sf_dir), "video_id").select(((F.col("e") == F.col("duration_s")) & (F.col("s") == 0) & (F.col("n") == F.col("m"))).alias("ok"))
    assert {r.ok for r in checked.collect()} == {True}


def test_merged_transcription(spark, sf_dir):
    texts, words = flows.merge_transcription(X.chunks(spark, sf_dir), X.chunk_results(spark, sf_dir), X.chunk_words(spark, sf_dir))
    assert texts.count() == X.chunks(spark, sf_dir).select("video_id").distinct().count()
    assert words.count() == X.chunk_words(spark, sf_dir).count()


def test_answers_to_published_chapters(spark, sf_dir, tmp_path):
    chapters, again = flows.segment(X.chapter_responses(spark, sf_dir))
    damaged = X.chapter_arrays(spark, sf_dir).filter("video_id % 8 = 5").count()
    assert again.count() == damaged
    some = X.chapters(spark, sf_dir)
    enriched, rejects = flows.enrich(some, X.enrichment_responses(spark, sf_dir))
    assert enriched.count() + rejects.count() == some.count()
    flows.report_quality(enriched, StageStore(spark, str(tmp_path / "stages")))
    flows.materialize(some, X.words(spark, sf_dir), "now", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/subtitles")).count() == some.count()
    assert spark.read.json(str(tmp_path / "out/index")).count() == some.select("video_id").distinct().count()
