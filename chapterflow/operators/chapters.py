"""Chapters: planning, repair, audit, and the documents published from them.

Chapters are (video_id, number, title, start_s, end_s, confidence,
transcript, ..), ``number`` increasing inside a video.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chapterflow import schemas as S
from chapterflow.functions import text as T
from chapterflow.functions import timefmt as M
from chapterflow.operators import blocks, recurrence, search
from chapterflow.operators.blocks import BLOCK
from chapterflow.sources.responses import sound_chapter

CHAPTERS_PER_BLOCK = 4096
KEY = ["video_id"]


def chapter_context(chapters: DataFrame, size: int = CHAPTERS_PER_BLOCK) -> DataFrame:
    """Previous and next title and the number of chapters."""
    rows = blocks.with_neighbours(chapters, KEY, "number", size, title=F.col("title"))
    rows = blocks.carry(rows, KEY, total_chapters=(F.count(F.lit(1)), "sum_all"))
    return rows.drop(BLOCK)


def plan_blocks(transcripts: DataFrame, threshold: int = 30000, block_chars: int = 20000) -> DataFrame:
    """Cut texts above ``threshold`` characters into blocks with estimated times.

    Shorter texts stay one block. Row-local.
    """
    size = F.length("text").cast("long")
    count = F.when(size > threshold, F.ceil(size / block_chars)).otherwise(F.lit(1)).cast("long")
    rate = F.when(F.col("duration_s") > 0, size / F.col("duration_s")).otherwise(F.lit(15.0))
    cut = transcripts.select(
        "video_id", "text", size.alias("size"), count.alias("n_blocks"), rate.alias("rate"),
        F.explode(F.sequence(F.lit(1).cast("long"), count)).alias("block"),
    )
    first = (F.col("block") - 1) * block_chars
    last = F.when(F.col("n_blocks") == 1, F.col("size")).otherwise(F.least(F.col("block") * block_chars, F.col("size")))
    piece = F.when(F.col("n_blocks") == 1, F.col("text")).otherwise(
        F.substring(F.col("text"), (first + 1).cast("int"), F.lit(block_chars))
    )
    start, end = first / F.col("rate"), last / F.col("rate")
    return cut.select(
        "video_id", "block", "n_blocks", piece.alias("text"), start.alias("start_s"), end.alias("end_s"),
        M.clock_time(end - start).alias("duration"),
    )


def merge_block_chapters(block_chapters: DataFrame, plan: DataFrame, size: int = 256) -> tuple[DataFrame, DataFrame]:
    """Shift block-local chapters to video time and number them through.

    Blocks without chapters are skipped; videos without any are returned as
    the second table. Chapters are computed once.
    """
    starts = plan.select("video_id", "block", F.col("start_s").alias("offset"))
    rows = block_chapters.join(starts, ["video_id", "block"]).withColumns(
        {"start_s": F.col("start_s") + F.col("offset"), "end_s": F.col("end_s") + F.col("offset")}
    )
    rows = blocks.spread(rows.drop("offset"), KEY, "block", size)
    # The answers behind these rows cost far more than their shuffle.
    rows = blocks.add_index(rows, KEY, ["block", "number"], "__n", once=True)
    rows = rows.withColumn("number", F.col("__n")).drop("__n", BLOCK)
    rows = rows.withColumns({"start_time": M.clock_time(F.col("start_s")), "end_time": M.clock_time(F.col("end_s"))})
    empty = plan.select("video_id").distinct().join(block_chapters.select("video_id"), "video_id", "left_anti")
    return rows, empty


def estimate_ratios(chapters: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Where a chapter's text begins and ends inside the full text, as shares.

    Looked up by its first and last 50 characters, then by 20. The pieces of
    all chapters are found in one walk over each text; chapters and texts do
    not meet otherwise.
    """
    ends_of = {"__head": F.coalesce(F.substring("transcript", 1, 50), F.lit("")), "__tail": F.coalesce(F.expr("right(transcript, 50)"), F.lit(""))}
    kinds = ["head50", "head20", "tail50", "tail20"]
    pair = F.struct(*[c.alias(n) for n, c in ends_of.items()])
    asked = chapters.groupBy("video_id").agg(F.collect_set(pair).alias("pairs"))
    cut = lambda x: F.array(x["__head"], F.substring(x["__head"], 1, 20), x["__tail"], F.right(x["__tail"], F.lit(20)))
    found = search.locate_lists(transcripts, asked.select("video_id", F.transform("pairs", cut).alias("lists")))
    pieces, places = F.col("pieces"), F.col("places")
    places = found.groupBy("video_id", pieces[0].alias("__head"), pieces[2].alias("__tail")).agg(
        *(F.max(places[i]).alias(f"__{k}") for i, k in enumerate(kinds)), F.collect_list(F.struct(F.col("size").alias("__size"))).alias("__sizes")
    )
    # A chapter has a row for each text of its video.
    rows = chapters.withColumns(ends_of).join(places, ["video_id", "__head", "__tail"])
    rows = rows.select("*", F.inline_outer("__sizes"))
    at = {k: F.coalesce(F.col(f"__{k}"), F.lit(-1)) for k in kinds}
    start = F.when(at["head50"] >= 0, at["head50"]).otherwise(at["head20"])
    end = F.when(at["tail50"] >= 0, at["tail50"]).otherwise(at["tail20"])
    size = F.col("__size")
    empty = (F.col("transcript") == "") | (size == 0)
    begins = F.when(empty, F.lit(0.0)).otherwise(F.greatest(start / size, F.lit(0.0)))
    ends = F.when(empty | (end < 0), F.lit(1.0)).otherwise(F.least((end + F.length("__tail")) / size, F.lit(1.0)))
    return rows.withColumns({"start_ratio": begins, "end_ratio": ends}).select(*chapters.columns, "start_ratio", "end_ratio")


def repair_chapters(chapters: DataFrame, size: int = CHAPTERS_PER_BLOCK) -> DataFrame:
    """Make chapter times chronological, contiguous and within the duration.

    Each start is at least 0.1 s after the previous repaired end, an end not
    after its start becomes start + 1 s, and ends stop at the duration, which
    is one number for a video. That recurrence is folded block by block: a
    block's effect on the end before it is a step function (see ``recurrence``),
    the functions are composed along the video, and only one number goes into
    each block, whatever the chapters before it did. Then the first start
    moves to 0, the last end to the duration, and gaps over 5 s close.
    """
    s, d = F.col("start_s"), F.col("duration_s")
    rows = blocks.cut(chapters, KEY, "number", size)
    entered = recurrence.entering_ends(rows.select(*KEY, BLOCK, "number", "start_s", "end_s", "duration_s"), KEY)
    folded = recurrence.folded_ends(rows, entered, KEY, chapters.schema)

    near = blocks.with_neighbours(folded, KEY, "number", size, end=F.col("__end"), start=s)
    start = F.greatest(s, F.coalesce(F.col("prev_end") + 0.1, s))
    next_start = F.greatest(F.col("next_start"), F.col("__end") + 0.1)
    fixed_start = (
        F.when(F.col("prev_end").isNull(), F.when(start > 1.0, F.lit(0.0)).otherwise(start))
        .when(start < F.col("prev_end"), F.col("prev_end") + 0.1)
        .otherwise(start)
    )
    fixed_end = (
        F.when(F.col("next_start").isNull(), F.when(F.col("__end") < d - 1.0, d).otherwise(F.col("__end")))
        .when(next_start > F.col("__end") + 5.0, next_start - 0.1)
        .otherwise(F.col("__end"))
    )
    out = near.withColumns({"start_s": fixed_start, "end_s": fixed_end})
    out = out.withColumns({"start_time": M.clock_time(F.col("start_s")), "end_time": M.clock_time(F.col("end_s"))})
    return out.select(*chapters.columns, "start_time", "end_time")


def flag_for_review(chapters: DataFrame, threshold: float = 0.7) -> DataFrame:
    return chapters.withColumn("needs_review", F.col("confidence") < threshold)


def review_queue(chapters: DataFrame, limit: int, threshold: float = 0.7) -> DataFrame:
    """The ``limit`` least certain chapters (a bounded top-k, not a full sort)."""
    flagged = flag_for_review(chapters, threshold).filter("needs_review")
    return flagged.orderBy("confidence", "video_id", "number").limit(limit)


def validate_chapters(chapters: DataFrame, keys: tuple[str, ...] = ("video_id",)) -> tuple[DataFrame, DataFrame]:
    """Split parsed chapters by response: every row must be complete and in range.

    One bad row rejects its whole response (to be asked again); ``keys`` name
    a response. Where the responses themselves are at hand,
    ``responses.read_chapters`` says the same without a join.
    """
    good = F.coalesce(sound_chapter(F.col), F.lit(False))
    rejects = chapters.filter(~good).select(*keys).distinct()
    return chapters.join(rejects, [*keys], "left_anti"), chapters.join(rejects, [*keys], "left_semi")


def audit_chapters(chapters: DataFrame, size: int = CHAPTERS_PER_BLOCK, tolerance_s: float = 0.001) -> DataFrame:
    """Layout rules as (video_id, number, issue); video-wide issues have number 0."""
    rows = chapters.select(*KEY, "number", "start_s", "end_s", "duration_s")
    near = blocks.with_neighbours(rows, KEY, "number", size, end=F.col("end_s"), number=F.col("number"))
    near = blocks.carry(near, KEY, total=(F.count(F.lit(1)), "sum_all"))
    length = F.col("end_s") - F.col("start_s")
    step = F.col("start_s") - F.col("prev_end")
    first, last = F.col("prev_number").isNull(), F.col("next_number").isNull()
    d, n = F.col("duration_s"), F.col("total")
    in_band = F.lit(None).cast("boolean")
    for below, low, high in reversed(S.CHAPTER_COUNT_BANDS):
        in_band = F.when(d < below, n.between(low, high)).otherwise(in_band)
    checks = F.array(
        F.when(length < 30, F.lit("too short")),
        F.when(length > 480, F.lit("too long")),
        F.when(F.col("number") != F.coalesce(F.col("prev_number"), F.lit(0)) + 1, F.lit("number out of sequence")),
        F.when(step > tolerance_s, F.lit("gap")),
        F.when(step < -tolerance_s, F.lit("overlap")),
        F.when(first & (F.col("start_s") > tolerance_s), F.lit("does not start at zero")),
        F.when(last & (F.abs(F.col("end_s") - d) > tolerance_s), F.lit("does not end at the duration")),
    )
    own = near.select(*KEY, "number", F.explode(F.array_compact(checks)).alias("issue"))
    wide = near.filter(first & ~in_band).select(*KEY, F.lit(0).cast("long").alias("number"), F.lit("chapter count out of band").alias("issue"))
    return own.unionByName(wide)


def route_transcripts(transcripts: DataFrame, has_segments: Column) -> DataFrame:
    """Processor and prompt template per transcript."""
    timed = S.supports(F.col("provider"), F.lit("word_timestamps"))
    processor = F.when(has_segments, F.lit("segment_optimized")).when(timed, F.lit("advanced")).otherwise(F.lit("clean"))
    template = F.when(has_segments | ~timed, F.lit("segmenter")).otherwise(F.lit("segmenter-basic"))
    return transcripts.withColumns({"processor": processor, "template": template})


def assemble_enriched(enriched: DataFrame, chapters: DataFrame) -> DataFrame:
    """Enriched chapters with text from the segment table, and plain chapters of
    videos that were never enriched.

    Enriched rows carry (video_id, number, title, start_time, end_time,
    segmentation_score, needs_review, description).
    """
    said = chapters.select("video_id", "number", "transcript")
    full = enriched.join(said, ["video_id", "number"], "left").select(
        "video_id", "number", "title",
        M.parse_clock(F.col("start_time")).alias("start_s"), M.parse_clock(F.col("end_time")).alias("end_s"),
        F.coalesce("segmentation_score", F.lit(0.8)).alias("confidence"),
        F.coalesce("transcript", F.lit("")).alias("transcript"),
        F.coalesce("needs_review", F.lit(False)).alias("needs_review"),
        "description",
    )
    done = enriched.select("video_id").distinct()
    plain = chapters.join(done, "video_id", "left_anti").select(
        "video_id", "number", "title", "start_s", "end_s", "confidence", "transcript"
    )
    return full.unionByName(plain, allowMissingColumns=True)


def resolve_slugs(chapters: DataFrame, on_collision: str = "suffix", size: int = 65536) -> DataFrame:
    """Folder slug per chapter; equal slugs get ``-2``, ``-3``.. or the last wins."""
    named = chapters.withColumn("slug", T.slugify(F.col("title")))
    if on_collision == "last":
        last = named.groupBy("video_id", "slug").agg(F.max("number").alias("number"))
        return named.join(last, ["video_id", "slug", "number"], "left_semi")
    if on_collision != "suffix":
        raise ValueError(f"unknown collision rule: {on_collision}")
    k = ["video_id", "slug"]
    rows = blocks.add_index(blocks.spread(named, k, "number", size), k, ["number"], "__n")
    suffixed = F.when(F.col("__n") > 1, F.concat_ws("-", "slug", F.col("__n").cast("string"))).otherwise(F.col("slug"))
    return rows.withColumn("slug", suffixed).drop("__n", BLOCK)


def chapter_stats(chapters: DataFrame) -> DataFrame:
    """Whole seconds and words per chapter."""
    return chapters.withColumns(
        {
            "duration_seconds": (F.col("end_s") - F.col("start_s")).cast("long"),
            "word_count": F.size(T.tokens(F.col("transcript"))).cast("long"),
        }
    )


def chapter_rollup(stats: DataFrame) -> DataFrame:
    """Chapters, words and seconds by provider and review flag, with subtotals."""
    return stats.rollup("provider", "needs_review").agg(
        F.count(F.lit(1)).alias("chapters"),
        F.sum("word_count").alias("words"),
        F.sum("duration_seconds").alias("seconds"),
    )


def chapter_metadata(chapters: DataFrame) -> DataFrame:
    """Flat metadata JSON per chapter.

    The summary is the description, else the text; topics are the concepts.
    """
    summary = F.coalesce(F.nullif(F.col("description"), F.lit("")), F.col("transcript"))
    body = F.struct(
        "title", T.slugify(F.col("title")).alias("slug"),
        M.clock_time(F.col("start_s")).alias("start_time"), M.clock_time(F.col("end_s")).alias("end_time"),
        F.col("start_s").alias("start_seconds"), F.col("end_s").alias("end_seconds"),
        summary.alias("summary"), F.col("key_concepts").alias("key_topics"), "confidence", "transcription_confidence",
    )
    return chapters.select("video_id", "number", F.to_json(body).alias("metadata"))


def chapter_manifest(enriched: DataFrame) -> DataFrame:
    """Nested manifest JSON per enriched chapter; its slug only lowers and hyphenates."""
    body = F.struct(
        F.struct("number", "title", F.replace(F.lower("title"), F.lit(" "), F.lit("-")).alias("slug")).alias("chapter"),
        F.struct(
            M.clock_time(F.col("start_s")).alias("start_time"), M.clock_time(F.col("end_s")).alias("end_time"),
            (F.col("end_s") - F.col("start_s")).cast("int").alias("duration_seconds"),
            F.size(T.tokens(F.col("transcript"))).alias("word_count"),
        ).alias("timing"),
        F.struct("description", "context", "summary_bullets").alias("content"),
        F.struct("terms_used", "key_concepts", "entities_detected").alias("knowledge"),
        "highlights", "pedagogy", "confidence",
    )
    return enriched.select("video_id", "number", F.to_json(body).alias("manifest"))


def clip_manifest(chapters: DataFrame, media: DataFrame, root: str = "chapters") -> DataFrame:
    """Cut list: which span of which source becomes which clip."""
    clips = resolve_slugs(chapters).select("video_id", "number", "slug", "start_s", "end_s")
    target = F.concat_ws("/", F.lit(root), F.col("video_id").cast("string"), F.col("slug"), F.concat("slug", F.lit(".mp4")))
    return clips.join(media.select("video_id", F.col("path").alias("source")), "video_id").select(
        "video_id", "number", "source", "start_s", "end_s", target.alias("target")
    )


def chapter_index(chapters: DataFrame, generated_at: str, entries_per_part: int = 5000, block_s: float = 3600.0) -> DataFrame:
    """Markdown index per video, chapters by start time.

    Takes (video_id, number, title, start_s, end_s, transcript) and optional
    ``description`` and ``key_concepts``. One part per video up to
    ``entries_per_part`` chapters; parts join by a newline.
    """
    have = set(chapters.columns)
    rows = blocks.spread(chapters, KEY, "start_s", block_s)
    rows = blocks.carry(rows, KEY, total=(F.count(F.lit(1)), "sum_all"), until=(F.max("end_s"), "max_all"))
    rows = blocks.add_index(rows, KEY, ["start_s", "number"], "idx")
    snippet = T.snippet(F.col("transcript"))
    if "description" in have:
        fallback = F.coalesce(F.nullif("description", F.lit("")), F.col("transcript"))
        snippet = F.when(F.col("description").isNotNull(), fallback).otherwise(snippet)
    summary = T.strip(F.coalesce(snippet, F.lit("")))
    pad = F.greatest(F.lit(2), F.length(F.col("total").cast("string")))
    ordinal = F.col("idx").cast("string")
    slug = T.slugify(F.col("title"))
    stamp = lambda c: F.concat(M.hms(c), F.lit(" ("), c.cast("long").cast("string"), F.lit("s)"))
    lines = [
        F.array(
            F.concat(F.lit("## "), F.lpad(ordinal, F.greatest(pad, F.length(ordinal)), F.lit("0")), F.lit(" — "), F.col("title")),
            F.lit(""),
            F.concat(F.lit("- **Start**: "), stamp(F.col("start_s"))),
            F.concat(F.lit("- **End**: "), stamp(F.col("end_s"))),
            F.concat(F.lit("- **Duration**: "), M.human_duration(F.col("end_s") - F.col("start_s"))),
            F.concat(F.lit("- **Slug**: `"), slug, F.lit("`")),
            F.concat(F.lit("- **Folder**: `"), slug, F.lit("/`")),
            F.lit(""),
        ),
        F.when(summary != "", F.array(summary, F.lit(""))),
        F.when(F.col("idx") < F.col("total"), F.array(F.lit("---"), F.lit(""))),
    ]
    if "key_concepts" in have:
        topics = F.concat(F.lit("**Key topics**: "), F.array_join("key_concepts", ", "))
        lines.insert(2, F.when(F.size("key_concepts") > 0, F.array(topics, F.lit(""))))
    none = F.array().cast("array<string>")
    entry = F.array_join(F.concat(*[F.coalesce(x, none) for x in lines]), "\n")
    part = F.expr(f"(idx - 1) div {entries_per_part}")
    docs = rows.groupBy(*KEY, part.alias("part")).agg(
        blocks.ordered_join(F.col("idx"), entry, "\n").alias("body"),
        F.max("total").alias("total"), F.max("until").alias("until"), F.max("idx").alias("last"),
    )
    head = F.concat(
        F.lit("# Chapters\n\nTotal: "), F.col("total").cast("string"), F.lit(" chapters  •  Source duration: "),
        M.hms(F.col("until")), F.lit(f"  •  Generated: {generated_at}\n\n"),
    )
    body = F.when(F.col("part") == 0, F.concat(head, F.col("body"))).otherwise(F.col("body"))
    ended = F.concat(F.regexp_replace(body, r"(?U)\s+\z", ""), F.lit("\n"))
    return docs.select(*KEY, "part", F.when(F.col("last") == F.col("total"), ended).otherwise(body).alias("markdown"))
