"""Prompt tables, enrichment audits and corpus knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chapterflow import schemas as S
from chapterflow.functions import text as T
from chapterflow.functions import timefmt as M
from chapterflow.operators.chapters import chapter_context


def build_segment_prompts(routed: DataFrame, templates: dict[str, str]) -> DataFrame:
    """Fill the template each transcript was routed to.

    Rows carry (title, topic, duration_s, text, template), and ``block`` where
    a text is asked about block by block; a template name without text gives
    no prompt.
    """
    template = S.lookup(templates, F.col("template"))
    values = {
        "VIDEO_TITLE": F.col("title"),
        "VIDEO_TOPIC": F.col("topic"),
        "VIDEO_TOTAL_DURATION": M.clock_time(F.col("duration_s")),
        "FULL_TRANSCRIPT": F.col("text"),
    }
    keys = ["video_id", *(c for c in ("block",) if c in routed.columns)]
    return routed.select(*keys, "template", T.fill_template(template, values).alias("prompt"))


def build_enrich_prompts(chapters: DataFrame, template: str) -> DataFrame:
    """One prompt per chapter with its neighbours; absent neighbours read N/A.

    Rows carry (video_title, topic, duration_s) besides the chapter.
    """
    rows = chapter_context(chapters)
    values = {
        "VIDEO_TITLE": F.col("video_title"),
        "VIDEO_TOPIC": F.col("topic"),
        "VIDEO_TOTAL_DURATION": M.clock_time(F.col("duration_s")),
        "CHAPTER_NUMBER": F.col("number"),
        "TOTAL_CHAPTERS": F.col("total_chapters"),
        "CHAPTER_START": M.clock_time(F.col("start_s")),
        "CHAPTER_END": M.clock_time(F.col("end_s")),
        "PREV_CHAPTER_TITLE": F.coalesce("prev_title", F.lit("N/A")),
        "NEXT_CHAPTER_TITLE": F.coalesce("next_title", F.lit("N/A")),
        "CHAPTER_TRANSCRIPT": F.col("transcript"),
    }
    return rows.select("video_id", "number", T.fill_template(F.lit(template), values).alias("prompt"))


def grade_confidence(scores: DataFrame, keys: tuple[str, ...] = ("video_id", "number")) -> DataFrame:
    """Grade each metric and list the reasons for review. Row-local."""
    grades, reasons = [], []
    for metric, (warn, review) in S.CONFIDENCE_THRESHOLDS.items():
        c = F.col(metric)
        grades.append(
            F.when(c < review, F.lit("review")).when(c < warn, F.lit("warning")).otherwise(F.lit("ok")).alias(f"{metric}_grade")
        )
        reasons.append(
            F.when(c < review, F.format_string(f"Low {metric} (%s < {review} threshold)", c.cast("string")))
        )
    needs = F.lit(False)
    for metric, (_, review) in S.CONFIDENCE_THRESHOLDS.items():
        needs = needs | F.coalesce(F.col(metric) < review, F.lit(False))
    return scores.select(
        *keys, *grades, needs.alias("needs_review"), F.array_compact(F.array(*reasons)).alias("review_reasons")
    )


def audit_enrichment(enriched: DataFrame) -> DataFrame:
    """Budget rules of an enrichment as (video_id, number, issue) rows."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    # 26 words take 51 characters at least.
    wordy = F.exists("highlights", lambda h: (F.length(h["quote"]) > 50) & (F.size(T.tokens(h["quote"])) > 25))
    at = lambda h: T.once(M.parse_clock(h["timestamp"]), lambda s: s.between(F.floor("start_s"), F.col("end_s")))
    stray = F.exists("highlights", lambda h: ~at(h))
    checks = F.array(
        F.when(size("summary_bullets") > 6, F.lit("more than 6 bullets")),
        F.when(size("terms_used") > 15, F.lit("more than 15 terms")),
        F.when(size("key_concepts") > 5, F.lit("more than 5 concepts")),
        F.when(size("highlights") > 6, F.lit("more than 6 highlights")),
        F.when(wordy, F.lit("quote over 25 words")),
        F.when(size("pedagogy.learning_objectives") > 4, F.lit("more than 4 objectives")),
        F.when(stray, F.lit("highlight outside the chapter")),
    )
    return enriched.select("video_id", "number", F.explode_outer(F.array_compact(checks)).alias("issue")).filter(
        "issue is not null"
    )


def term_fidelity(enriched: DataFrame) -> DataFrame:
    """Declared terms with their real, case-insensitive count in the transcript."""
    rows = enriched.select("video_id", "number", F.lower("transcript").alias("said"), F.explode_outer("terms_used").alias("t"))
    rows = rows.filter("t is not null")
    term = F.lower(F.col("t.term"))
    count = F.when(F.length(term) > 0, _occurrences(F.col("said"), term)).otherwise(F.lit(0))
    return rows.select(
        "video_id", "number", F.col("t.term").alias("term"), F.col("t.frequency").cast("long").alias("declared"),
        count.cast("long").alias("found"), (count > 0).alias("faithful"),
    )


def _occurrences(text: Column, piece: Column) -> Column:
    """Non-overlapping occurrences, without compiling a pattern per row."""
    return (F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)


def top_highlights(enriched: DataFrame, k: int = 6) -> DataFrame:
    """The first ``k`` highlights of a chapter by type priority, then list order."""
    rank = lambda h: F.array_position(F.array(*map(F.lit, S.HIGHLIGHT_TYPES)), h["type"])
    ranked = F.transform("highlights", lambda h, i: F.struct(rank(h).alias("rank"), i.alias("i"), h.alias("h")))
    best = F.slice(F.array_sort(ranked), 1, k)
    rows = enriched.select("video_id", "number", F.posexplode_outer(best).alias("place", "x"))
    rows = rows.filter("place is not null")
    return rows.select("video_id", "number", (F.col("place") + 1).cast("long").alias("place"), "x.h.*")


def top_terms(enriched: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` most frequent terms of a chapter, then alphabetical."""
    ranked = F.transform("terms_used", lambda t: F.struct((-t["frequency"]).alias("f"), t["term"].alias("term")))
    rows = enriched.select("video_id", "number", F.posexplode_outer(F.slice(F.array_sort(ranked), 1, k)).alias("place", "x"))
    rows = rows.filter("place is not null")
    return rows.select(
        "video_id", "number", (F.col("place") + 1).cast("long").alias("place"), "x.term", (-F.col("x.f")).cast("long").alias("frequency")
    )


def knowledge_index(enriched: DataFrame) -> DataFrame:
    """Terms, concepts and entities of the corpus with chapter and video counts."""
    terms = enriched.select("video_id", F.lit("term").alias("kind"), F.explode_outer("terms_used.term").alias("name"))
    concepts = enriched.select("video_id", F.lit("concept").alias("kind"), F.explode_outer("key_concepts").alias("name"))
    by_kind = enriched.select("video_id", F.explode_outer("entities_detected").alias("cat", "names"))
    entities = by_kind.select("video_id", F.concat(F.lit("entity:"), F.col("cat")).alias("kind"), F.explode_outer("names").alias("name"))
    # Collapsing to (kind, name, video) first spreads a name said everywhere.
    said = terms.unionByName(concepts).unionByName(entities).filter("name is not null")
    per_video = said.groupBy("kind", "name", "video_id").agg(F.count(F.lit(1)).alias("n"))
    return per_video.groupBy("kind", "name").agg(F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("videos"))
