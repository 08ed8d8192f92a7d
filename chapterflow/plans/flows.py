"""The table-to-table jobs from media to published chapters.

Each flow composes operators lazily; ``StageStore`` tables sit between them,
so a lost executor costs a task and a failed run restarts at a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chapterflow.functions import text as T
from chapterflow.operators import chapters as C
from chapterflow.operators import chunks as K
from chapterflow.operators import enrichment as E
from chapterflow.operators import timeline as L
from chapterflow.sources import responses
from chapterflow.sources.stages import StageStore, publish


def plan_transcription(media: DataFrame) -> DataFrame:
    """Chunks of every supported medium: whole files, or the provider's chunk length for long ones."""
    routed = K.route_media(K.supported_media(media))
    whole = routed.filter(F.col("strategy") == "full").select(
        "video_id", F.lit(0).cast("long").alias("chunk_index"), F.lit(0.0).alias("start_s"),
        F.col("duration_s").alias("end_s"), F.lit(1).cast("long").alias("n_chunks"),
    )
    return whole.unionByName(K.plan_chunks(routed.filter(F.col("strategy") == "chunked"), chunk_min=F.col("chunk_min")))


def merge_transcription(chunks: DataFrame, results: DataFrame, words: DataFrame, overlap: str = "concat") -> tuple[DataFrame, DataFrame]:
    """Cleaned transcripts and their words, from the chunk results."""
    merged = K.reassemble(chunks, results).withColumn("text", T.preprocess(F.col("text")))
    return merged, K.reassembled_words(chunks, words, overlap)


def segment(answers: DataFrame, threshold: float = 0.7, plan: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Flagged chapters of sound answers; videos, or blocks of them, to ask again.

    With a ``plan`` of blocks the answers are (video_id, block, text): sound
    blocks are shifted to their place and numbered through, others skipped.
    """
    keys = ("video_id",) if plan is None else ("video_id", "block")
    read = responses.read_chapters(answers, keys)
    rows = responses.chapter_rows(read.filter("verdict = 'ok'"), keys).drop("parse_stage")
    rows = rows.withColumnsRenamed({"start_seconds": "start_s", "end_seconds": "end_s"})
    if plan is not None:
        rows, _ = C.merge_block_chapters(rows, plan)
    return C.flag_for_review(rows, threshold), read.filter("verdict <> 'ok'").select(*keys)


def enrich(chapters: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters with their enrichment; rejected answers with the reason."""
    typed, rejects = responses.parse_enrichments(answers)
    base = chapters.select("video_id", "number", "title", "start_s", "end_s", "transcript")
    return base.join(typed, ["video_id", "number"]), rejects


def materialize(chapters: DataFrame, words: DataFrame, generated_at: str, root: str) -> None:
    """Write subtitles and indexes of all chapters below ``root``."""
    cues = L.chapter_captions(words, chapters)
    publish(L.srt_documents(cues, keys=("video_id", "number")), f"{root}/subtitles")
    publish(C.chapter_index(chapters, generated_at), f"{root}/index")
    publish(C.resolve_slugs(chapters).select("video_id", "number", "slug"), f"{root}/folders")


def report_quality(enriched: DataFrame, store: StageStore) -> None:
    """Save the audits of enriched chapters as stage tables."""
    store.save("audit", E.audit_enrichment(enriched))
    store.save("term_fidelity", E.term_fidelity(enriched))
    store.save("knowledge", E.knowledge_index(enriched))
