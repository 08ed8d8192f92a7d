"""Every operator as a query over the given tables.

Each function takes (spark, sf_dir) and returns a DataFrame; ``QUERIES`` maps
names to them. Floating-point results are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chapterflow.functions import text as T
from chapterflow.functions import timefmt as M
from chapterflow.operators import chapters as C
from chapterflow.operators import chunks as K
from chapterflow.operators import cleaning
from chapterflow.operators import enrichment as E
from chapterflow.operators import models as A
from chapterflow.operators import ops as O
from chapterflow.operators import timeline as L
from chapterflow.plans import fixtures as X
from chapterflow.plans import flows
from chapterflow.sources import asr, responses
from chapterflow.sources.stages import StageStore
from chapterflow.streaming import jobs, live, stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEGMENT_TEMPLATES = {
    "segmenter": "Video: {{VIDEO_TITLE}} ({{VIDEO_TOTAL_DURATION}})\nTema: {{VIDEO_TOPIC}}\n{{FULL_TRANSCRIPT}}\n{{UNKNOWN}}",
    "segmenter-basic": "{{VIDEO_TITLE}}|{{VIDEO_TOTAL_DURATION}}|{{FULL_TRANSCRIPT}}",
}
ENRICH_TEMPLATE = (
    "{{VIDEO_TITLE}} {{CHAPTER_NUMBER}}/{{TOTAL_CHAPTERS}} {{CHAPTER_START}}-{{CHAPTER_END}}\n"
    "< {{PREV_CHAPTER_TITLE}} > {{NEXT_CHAPTER_TITLE}}\n{{CHAPTER_TRANSCRIPT}}"
)
#: What the query reads back of a manifest, in one go.
MANIFEST_FIELDS = (
    "chapter struct<slug:string>, timing struct<duration_seconds:bigint,word_count:bigint>, content struct<description:string>, "
    "highlights array<struct<type:string>>, confidence struct<content_coherence:double>"
)
#: Part files of a given table in one micro-batch.
PARTS_A_BATCH = 16
SECTION_TEMPLATE = "{{#LANG}}Idioma: {{LANG}}.{{/LANG}}{{^TOPIC}}Sin tema.{{/TOPIC}} {{DOC}}"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    return df.select([six_digits(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def six_digits(c: Column) -> Column:
    """Half-up at six digits; the nudge keeps ties from hanging on summation order."""
    return F.floor(c * 1e6 + 0.500001) / 1e6


def _on_dirty(name: str, clean) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.dirty_text(spark, sf_dir).select("doc_id", clean(F.col("text")).alias("text"))

    QUERIES[name] = run


for _name, _clean in {
    "decode_escapes": T.decode_escapes,
    "clean_unicode": T.clean_unicode,
    "remove_markers": T.remove_markers,
    "remove_repetitions": T.remove_repetitions,
    "normalize_punctuation": T.normalize_punctuation,
    "remove_fillers": T.remove_fillers,
    "preprocess": T.preprocess,
    "preprocess_keep_fillers": lambda c: T.preprocess(c, fillers_removed=False),
    "drop_duplicate_words": T.drop_duplicate_words,
    "apply_corrections": T.apply_rules,
    "tidy_punctuation": T.tidy_punctuation,
    "correct_transcript": T.correct_transcript,
    "snippets": lambda c: T.snippet(c),
}.items():
    _on_dirty(_name, _clean)


@query
def cleaning_report(spark, sf_dir):
    """Characters before and after cleaning, per language, with percentiles."""
    return rounded(cleaning.cleaning_report(X.dirty_text(spark, sf_dir, keep=("lang",))))


@query
def expand_terms(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    topic = F.when(F.col("lang") == "es", F.lit("psicología")).otherwise(F.col("lang"))
    text = F.concat(F.lit("Terapia, consejería. El apoyo muy emocional: terapias "), F.col("text"))
    return docs.select("doc_id", T.expand_terms(text, topic).alias("text"))


@query
def slugs(spark, sf_dir):
    return X.chapters(spark, sf_dir).select("video_id", "number", T.slugify(F.col("title")).alias("slug"))


@query
def time_formats(spark, sf_dir):
    s, e = F.col("start_s"), F.col("end_s")
    clock = M.clock_time(s)
    return X.chapters(spark, sf_dir).select(
        "video_id", "number", M.srt_time(s).alias("srt"), clock.alias("clock"), M.hms(e).alias("hms"),
        M.human_duration(e * 7).alias("human"),
        M.eta(F.when(F.col("number") % 5 != 0, (e * 3))).alias("eta"),
        M.usd(F.floor(e) / 100).alias("usd"),
        six_digits(M.parse_clock(clock)).alias("parsed"),
        M.parse_clock(F.col("title")).alias("malformed"),
    )


# --- timeline ---------------------------------------------------------------


@query
def captions(spark, sf_dir):
    return rounded(L.captions(X.words(spark, sf_dir)))


@query
def captions_legacy_tail(spark, sf_dir):
    return rounded(L.captions(X.words(spark, sf_dir), gap_s=0.2, max_words=7, legacy_duplicate_tail=True, block_words=64))


@query
def srt_documents(spark, sf_dir):
    return L.srt_documents(L.captions(X.words(spark, sf_dir)))


@query
def captions_from_text(spark, sf_dir):
    return rounded(L.captions_from_text(X.chapters(spark, sf_dir)))


@query
def chapter_words(spark, sf_dir):
    return L.chapter_words(X.words(spark, sf_dir), X.chapters(spark, sf_dir)).select("video_id", "number", "pos", "word")


@query
def chapter_captions(spark, sf_dir):
    """Text-only recognisers give no words, so their chapters fall back to text."""
    timed = X.transcripts(spark, sf_dir).filter(F.col("provider") != "openai").select("video_id")
    words = X.words(spark, sf_dir).join(timed, "video_id", "left_semi")
    return rounded(L.chapter_captions(words, X.chapters(spark, sf_dir)))


@query
def chapter_srt(spark, sf_dir):
    cues = L.chapter_captions(X.words(spark, sf_dir), X.chapters(spark, sf_dir))
    return L.srt_documents(cues, keys=("video_id", "number"))


@query
def word_order_issues(spark, sf_dir):
    return L.word_order_issues(X.words_disordered(spark, sf_dir))


@query
def failed_regions(spark, sf_dir):
    return rounded(L.failed_regions(X.transcripts(spark, sf_dir), X.words(spark, sf_dir)))


@query
def confidence_windows(spark, sf_dir):
    return rounded(L.confidence_windows(X.transcripts(spark, sf_dir), X.words(spark, sf_dir)))


@query
def transcript_issues(spark, sf_dir):
    return L.transcript_issues(_unsound(spark, sf_dir), X.words_disordered(spark, sf_dir))


def _unsound(spark, sf_dir):
    """Transcripts with some blank texts, zero durations and confidences over 1."""
    n = F.col("video_id")
    return X.transcripts(spark, sf_dir).withColumns(
        {
            "text": F.when(n % 13 == 3, F.lit("  ")).otherwise(F.col("text")),
            "duration_s": F.when(n % 17 == 4, F.lit(0.0)).otherwise(F.col("duration_s")),
            "confidence": F.when(n % 19 == 5, F.lit(1.5)).otherwise(F.col("confidence")),
        }
    )


@query
def validate_transcripts(spark, sf_dir):
    return rounded(L.validate_transcripts(_unsound(spark, sf_dir), X.words_disordered(spark, sf_dir)))


def _probes(spark, sf_dir):
    return X.chapters(spark, sf_dir).select(
        "video_id", F.col("number").alias("probe_id"), F.round(F.col("start_s") + 0.1, 3).alias("at_s")
    )


@query
def word_at(spark, sf_dir):
    return rounded(L.word_at(X.words(spark, sf_dir), _probes(spark, sf_dir)))


@query
def segment_at(spark, sf_dir):
    return rounded(L.segment_at(X.segments(spark, sf_dir), _probes(spark, sf_dir)))


@query
def snap_to_segments(spark, sf_dir):
    ratio = F.col("number") / 8.0 - 0.125
    probes = X.chapters(spark, sf_dir).select("video_id", F.col("number").alias("probe_id"), ratio.alias("ratio"), "duration_s")
    return rounded(L.snap_to_segments(probes, X.segments(spark, sf_dir)))


@query
def clean_words(spark, sf_dir):
    return L.clean_words(X.words(spark, sf_dir)).select("video_id", "pos", "word")


@query
def speaker_turns(spark, sf_dir):
    return rounded(L.speaker_turns(X.speaker_words(spark, sf_dir)))


@query
def transcript_stats(spark, sf_dir):
    return L.transcript_stats(X.transcripts(spark, sf_dir), X.words(spark, sf_dir))


# --- chunks and media -------------------------------------------------------


@query
def supported_media(spark, sf_dir):
    return K.supported_media(X.media(spark, sf_dir)).select("video_id", "extension", "size_bytes")


@query
def plan_chunks(spark, sf_dir):
    return rounded(K.plan_chunks(X.media(spark, sf_dir)))


@query
def plan_chunks_merged_tail(spark, sf_dir):
    return rounded(K.plan_chunks(X.media(spark, sf_dir), chunk_min=10, merge_tail=True))


@query
def routed_chunk_plan(spark, sf_dir):
    """Long media only, each with the chunk length of its provider."""
    routed = K.route_media(X.media(spark, sf_dir)).filter(F.col("strategy") == "chunked")
    return rounded(K.plan_chunks(routed, chunk_min=F.col("chunk_min")))


@query
def route_media(spark, sf_dir):
    return K.route_media(X.media(spark, sf_dir)).select("video_id", "strategy", "chunk_min")


@query
def eligible_providers(spark, sf_dir):
    return K.eligible_providers(X.media(spark, sf_dir))


@query
def media_strategy(spark, sf_dir):
    return K.media_strategy(X.media(spark, sf_dir)).select("video_id", "advice")


@query
def reassemble(spark, sf_dir):
    return rounded(K.reassemble(X.chunks(spark, sf_dir), X.chunk_results(spark, sf_dir)))


@query
def reassembled_words(spark, sf_dir):
    words = K.reassembled_words(X.chunks(spark, sf_dir), X.chunk_words(spark, sf_dir))
    return rounded(words.select("video_id", "pos", "chunk_index", "word", "start_s", "end_s"))


@query
def reassembled_words_best(spark, sf_dir):
    words = K.reassembled_words(X.short_chunks(spark, sf_dir), X.chunk_words(spark, sf_dir), overlap="best")
    return rounded(words.select("video_id", "pos", "chunk_index", "word", "start_s"))


# --- chapters ---------------------------------------------------------------


@query
def chapter_context(spark, sf_dir):
    rows = C.chapter_context(X.chapters(spark, sf_dir))
    return rows.select("video_id", "number", "prev_title", "next_title", "total_chapters")


def _block_plan(spark, sf_dir):
    return C.plan_blocks(X.transcripts(spark, sf_dir), threshold=3000, block_chars=2000)


@query
def plan_blocks(spark, sf_dir):
    return rounded(_block_plan(spark, sf_dir))


@query
def plan_blocks_default(spark, sf_dir):
    return rounded(C.plan_blocks(X.transcripts(spark, sf_dir)).drop("text"))


@query
def merge_block_chapters(spark, sf_dir):
    plan = _block_plan(spark, sf_dir).select("video_id", "block", "start_s", "end_s")
    rows, _ = C.merge_block_chapters(X.block_chapters(spark, sf_dir, plan), plan)
    return rounded(rows.select("video_id", "number", "block", "start_s", "end_s"))


@query
def unsegmented_videos(spark, sf_dir):
    plan = _block_plan(spark, sf_dir).select("video_id", "block", "start_s", "end_s")
    return C.merge_block_chapters(X.block_chapters(spark, sf_dir, plan), plan)[1]


@query
def estimate_ratios(spark, sf_dir):
    rows = C.estimate_ratios(X.chapters(spark, sf_dir), X.transcripts(spark, sf_dir).select("video_id", "text"))
    return rounded(rows.select("video_id", "number", "start_ratio", "end_ratio"))


@query
def repair_chapters(spark, sf_dir):
    rows = C.repair_chapters(X.chapters_rough(spark, sf_dir))
    return rounded(rows.select("video_id", "number", "start_s", "end_s"))


@query
def flag_for_review(spark, sf_dir):
    return C.flag_for_review(X.chapters(spark, sf_dir)).select("video_id", "number", "confidence", "needs_review")


@query
def review_queue(spark, sf_dir):
    return C.review_queue(X.chapters(spark, sf_dir), 100).select("video_id", "number", "confidence")


@query
def audit_chapters(spark, sf_dir):
    return C.audit_chapters(X.chapters_rough(spark, sf_dir))


@query
def route_transcripts(spark, sf_dir):
    rows = C.route_transcripts(X.transcripts(spark, sf_dir), F.col("video_id") % 3 == 0)
    return rows.select("video_id", "provider", "processor", "template")


@query
def assemble_enriched(spark, sf_dir):
    """Videos of the first three recognisers were enriched, the others only segmented."""
    done = X.transcripts(spark, sf_dir).filter(F.col("provider") != "mlx-whisper").select("video_id")
    e = X.enriched(spark, sf_dir).join(done, "video_id", "left_semi")
    enriched = e.select(
        "video_id", "number", "title", M.clock_time(F.col("start_s")).alias("start_time"),
        M.clock_time(F.col("end_s")).alias("end_time"),
        F.when(F.col("number") % 4 != 0, F.col("confidence.segmentation_score")).alias("segmentation_score"),
        F.col("confidence.needs_review").alias("needs_review"), "description",
    )
    segmented = X.chapters(spark, sf_dir).filter(F.col("number") != 2)
    return rounded(C.assemble_enriched(enriched, segmented))


def _shared_titles(spark, sf_dir):
    """Every third chapter of a video is called alike; others keep their whole titles."""
    return X.chapters(spark, sf_dir).withColumn("title", F.when(F.col("number") % 3 == 0, F.lit("Capítulo final")).otherwise(F.col("title")))


@query
def resolve_slugs(spark, sf_dir):
    return C.resolve_slugs(_shared_titles(spark, sf_dir)).select("video_id", "number", "slug")


@query
def resolve_slugs_last_wins(spark, sf_dir):
    return C.resolve_slugs(_shared_titles(spark, sf_dir), on_collision="last").select("video_id", "number", "slug")


@query
def chapter_stats(spark, sf_dir):
    return C.chapter_stats(X.chapters(spark, sf_dir)).select("video_id", "number", "duration_seconds", "word_count")


@query
def chapter_rollup(spark, sf_dir):
    provider = X.transcripts(spark, sf_dir).select("video_id", "provider")
    rows = C.flag_for_review(C.chapter_stats(X.chapters(spark, sf_dir))).join(provider, "video_id")
    return C.chapter_rollup(rows)


def _published(spark, sf_dir):
    e = X.enriched(spark, sf_dir).withColumn("description", F.when(F.col("number") % 2 == 0, F.col("description")).otherwise(F.lit("")))
    return e.withColumn("confidence", F.col("confidence.segmentation_score")).withColumn("transcription_confidence", F.lit(0.9))


@query
def chapter_metadata(spark, sf_dir):
    """The metadata documents, read back field by field."""
    j = F.col("metadata")
    at = lambda p: F.get_json_object(j, f"$.{p}")
    return C.chapter_metadata(_published(spark, sf_dir)).select(
        "video_id", "number", at("title").alias("title"), at("slug").alias("slug"),
        at("start_time").alias("start_time"), six_digits(at("end_seconds").cast("double")).alias("end_seconds"),
        at("summary").alias("summary"), F.coalesce(F.json_array_length(at("key_topics")), F.lit(0)).cast("long").alias("n_topics"),
        six_digits(at("confidence").cast("double")).alias("confidence"),
    )


@query
def chapter_manifest(spark, sf_dir):
    read = C.chapter_manifest(X.enriched(spark, sf_dir)).withColumn("m", F.from_json("manifest", MANIFEST_FIELDS))
    return read.select(
        "video_id", "number", F.col("m.chapter.slug").alias("slug"), F.col("m.timing.duration_seconds").alias("duration_seconds"),
        F.col("m.timing.word_count").alias("word_count"), F.col("m.content.description").alias("description"),
        F.get("m.highlights", F.lit(0))["type"].alias("first_highlight"),
        six_digits(F.col("m.confidence.content_coherence")).alias("coherence"),
    )


@query
def clip_manifest(spark, sf_dir):
    return rounded(C.clip_manifest(X.chapters(spark, sf_dir), X.media(spark, sf_dir)))


@query
def chapter_index(spark, sf_dir):
    return C.chapter_index(X.chapters(spark, sf_dir), "2024-01-01 00:00:00")


@query
def enriched_index(spark, sf_dir):
    return C.chapter_index(_published(spark, sf_dir), "2024-01-01 00:00:00")


# --- model answers ----------------------------------------------------------


def _block_prompts(spark, sf_dir):
    plan = _block_plan(spark, sf_dir)
    asked = plan.withColumns({"title": F.lit("t"), "topic": F.lit("p"), "duration_s": F.col("end_s") - F.col("start_s"), "template": F.lit("block")})
    return plan.select("video_id", "block", "start_s", "end_s"), E.build_segment_prompts(asked, {"block": "{{FULL_TRANSCRIPT}}"})


@query
def segmented_blocks(spark, sf_dir):
    """Blocks from prompt to merged chapters, through damaged answers."""
    plan, prompts = _block_prompts(spark, sf_dir)
    chapters, _ = flows.segment(X.block_answers(prompts), plan=plan)
    return rounded(chapters.select("video_id", "number", "block", "title", "start_s", "end_s", "start_time", "end_time", "confidence", "transcript", "needs_review"))


@query
def blocks_to_ask_again(spark, sf_dir):
    plan, prompts = _block_prompts(spark, sf_dir)
    return flows.segment(X.block_answers(prompts), plan=plan)[1]


@query
def read_block_answers(spark, sf_dir):
    """How every answer about a block was read."""
    read = responses.read_chapters(X.block_answers(_block_prompts(spark, sf_dir)[1]), ("video_id", "block"))
    return read.select("video_id", "block", "parse_stage", "verdict", F.coalesce(F.size("chapters"), F.lit(0)).cast("long").alias("n_chapters"))


@query
def parse_chapters(spark, sf_dir):
    parsed, _ = responses.parse_chapters(X.chapter_responses(spark, sf_dir))
    return parsed.groupBy("video_id", "parse_stage").agg(
        F.count(F.lit(1)).alias("n_chapters"), F.sum("number").alias("sum_number")
    )


@query
def validate_chapters(spark, sf_dir):
    parsed, _ = responses.parse_chapters(X.chapter_responses(spark, sf_dir))
    ok, _ = C.validate_chapters(parsed)
    return ok.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_chapters"))


@query
def quarantined_responses(spark, sf_dir):
    """Plain document texts are no answers; what cannot be read is set aside."""
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "text")
    _, bad = responses.parse_chapters(docs.withColumn("text", F.regexp_replace("text", "[:{}\\[\\]]", "")))
    return bad


@query
def parse_enrichments(spark, sf_dir):
    ok, _ = responses.parse_enrichments(X.enrichment_responses(spark, sf_dir))
    return ok.select(
        "video_id", "number", "description", F.size("key_concepts").cast("long").alias("n_concepts"),
        F.size("highlights").cast("long").alias("n_highlights"),
        six_digits(F.col("confidence.segmentation_score")).alias("segmentation_score"),
    )


@query
def rejected_enrichments(spark, sf_dir):
    return responses.parse_enrichments(X.enrichment_responses(spark, sf_dir))[1]


@query
def segment_prompts(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("video_id"), "source", "lang")
    rows = C.route_transcripts(X.transcripts(spark, sf_dir), F.col("video_id") % 3 == 0).join(docs, "video_id")
    return E.build_segment_prompts(
        rows.withColumnsRenamed({"source": "title", "lang": "topic"}), SEGMENT_TEMPLATES
    )


@query
def enrich_prompts(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.col("source").alias("video_title"), F.col("lang").alias("topic")
    )
    return E.build_enrich_prompts(X.chapters(spark, sf_dir).join(docs, "video_id"), ENRICH_TEMPLATE)


@query
def template_sections(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents").select("doc_id", "lang")
    topic = F.when(F.col("doc_id") % 2 == 0, F.lit("t")).otherwise(F.lit(""))
    kept = T.fill_sections(F.lit(SECTION_TEMPLATE), {"LANG": F.when(F.col("lang") != "en", F.col("lang")), "TOPIC": topic})
    return docs.select("doc_id", T.fill_template(kept, {"LANG": F.col("lang"), "DOC": F.col("doc_id")}).alias("prompt"))


@query
def grade_confidence(spark, sf_dir):
    scores = X.enriched(spark, sf_dir).select("video_id", "number", "confidence.*").drop("needs_review", "review_reasons")
    graded = E.grade_confidence(scores)
    return graded.withColumn("review_reasons", F.array_join("review_reasons", "; "))


@query
def audit_enrichment(spark, sf_dir):
    return E.audit_enrichment(X.enriched(spark, sf_dir))


@query
def term_fidelity(spark, sf_dir):
    return E.term_fidelity(X.enriched(spark, sf_dir))


@query
def top_highlights(spark, sf_dir):
    e = X.enriched(spark, sf_dir).withColumn(
        "highlights", F.filter("highlights", lambda h: (h["type"] != "unheard-of") & (h["importance"] != "unknown"))
    )
    return E.top_highlights(e).drop("timestamp", "quote")


@query
def top_terms(spark, sf_dir):
    return E.top_terms(X.enriched(spark, sf_dir), k=3)


@query
def knowledge_index(spark, sf_dir):
    return E.knowledge_index(X.enriched(spark, sf_dir))


def _stub_primary(prompt: str) -> str:
    if len(prompt) % 5 == 0:
        raise A.PermanentError("401 bad key")
    if len(prompt) % 5 == 1:
        raise A.TransientError("429 rate limit")
    return "primary:" + prompt


def _stub_backup(prompt: str) -> str:
    if len(prompt) % 35 == 0:
        raise A.PermanentError("refused")
    return "backup:" + prompt


def _attempt_log(spark, sf_dir):
    A.register_model("primary", _stub_primary)
    A.register_model("backup", _stub_backup)
    docs = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("prompt"))
    return A.apply_model(docs, ["primary", "backup"], base_delay_s=0.0)


@query
def model_attempts(spark, sf_dir):
    return _attempt_log(spark, sf_dir).select("request_id", "attempt", "provider", "success", "error_class")


@query
def resolve_attempts(spark, sf_dir):
    return A.resolve_attempts(_attempt_log(spark, sf_dir)).drop("error_message")


# --- recogniser answers -----------------------------------------------------


def _ingest(dialect: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = asr.ingest_asr(X.asr_responses(spark, sf_dir, dialect), dialect)
        last = F.try_element_at("words", F.lit(-1))
        return rounded(
            t.select(
                "video_id", F.length("text").cast("long").alias("n_chars"), "confidence", "duration_s", "model", "error",
                F.size("words").cast("long").alias("n_words"), last["word"].alias("last_word"),
                last["start"].alias("last_start"), last["confidence"].alias("last_confidence"),
            )
        )

    return run


for _dialect in ("seconds", "millis", "text", "segmented"):
    QUERIES[f"ingest_asr_{_dialect}"] = _ingest(_dialect)


@query
def ingested_words(spark, sf_dir):
    t = asr.ingest_asr(X.asr_responses(spark, sf_dir, "millis"), "millis")
    return rounded(asr.explode_words(t))


# --- operations -------------------------------------------------------------


@query
def classify_errors(spark, sf_dir):
    a = X.attempts(spark, sf_dir).filter(~F.col("success"))
    return a.select(
        "run_id", "attempt_number", O.classify_error(F.col("status"), F.col("error_message")).alias("error_class")
    )


@query
def estimate_costs(spark, sf_dir):
    return rounded(O.estimate_costs(X.usage(spark, sf_dir)).select("video_id", "kind", "provider", "cost_usd", "defaulted"))


def _spend(spark, sf_dir):
    return X.attempts(spark, sf_dir).select("run_id", F.col("attempt_number").alias("seq"), "cost_usd")


@query
def budget_gate(spark, sf_dir):
    return rounded(O.budget_gate(_spend(spark, sf_dir), 1.0))


@query
def first_breaches(spark, sf_dir):
    return rounded(O.first_breaches(O.budget_gate(_spend(spark, sf_dir), 1.0)))


@query
def transcription_summary(spark, sf_dir):
    return rounded(O.transcription_summary(X.attempts(spark, sf_dir)))


@query
def provider_scorecard(spark, sf_dir):
    return rounded(O.provider_scorecard(X.attempts(spark, sf_dir)))


@query
def cheapest_combination(spark, sf_dir):
    docs = X.table(spark, sf_dir, "documents")
    work = docs.select("doc_id", F.col("n_chars").cast("double").alias("duration_s"), (F.col("n_chars") * 100).alias("tokens"))
    return rounded(O.cheapest_combination(work))


@query
def capability_gaps(spark, sf_dir):
    needs = [["word_timestamps"], ["word_timestamps", "speaker_diarization"], ["utterances"], []]
    arrays = F.array(*[F.array(*map(F.lit, n)).cast("array<string>") for n in needs])
    asked = X.transcripts(spark, sf_dir).select(
        "video_id", "provider", F.element_at(arrays, (F.floor(F.col("video_id") / 4) % 4 + 1).cast("int")).alias("required")
    )
    gaps = O.capability_gaps(asked)
    return gaps.select(
        "video_id", "provider", F.array_join("missing", ",").alias("missing"), F.array_join("suggested", ",").alias("suggested")
    )


@query
def resume_plan(spark, sf_dir):
    videos = X.transcripts(spark, sf_dir).select("video_id")
    return O.resume_plan(videos, X.stage_status(spark, sf_dir))


def _report(spark, sf_dir):
    t = X.transcripts(spark, sf_dir)
    timeline = t.select(
        "video_id", "duration_s", (F.col("duration_s") * (1 + F.col("video_id") % 4)).alias("run_seconds"),
        (F.col("video_id") % 5).alias("fallbacks"), (F.col("video_id") % 8).alias("retries"),
    )
    return O.processing_report(X.chapters(spark, sf_dir), O.estimate_costs(X.usage(spark, sf_dir)), timeline)


@query
def processing_report(spark, sf_dir):
    return rounded(_report(spark, sf_dir))


@query
def report_warnings(spark, sf_dir):
    return O.report_warnings(X.chapters(spark, sf_dir))


@query
def alerts(spark, sf_dir):
    return O.alerts(_report(spark, sf_dir), 0.5)


@query
def stage_round_trip(spark, sf_dir):
    """The cleaned transcripts saved as a stage table and loaded again."""
    store = StageStore(spark, jobs.new_folder(spark, "stage"))
    store.save("transcribe", X.dirty_text(spark, sf_dir).select("doc_id", T.preprocess(F.col("text")).alias("text")))
    if not store.exists("transcribe"):
        raise RuntimeError("stage table is missing")
    return store.load("transcribe")


# --- streams ----------------------------------------------------------------


@query
def run_state(spark, sf_dir):
    return rounded(live.run_state(X.progress_events(spark, sf_dir)))


@query
def run_messages(spark, sf_dir):
    return live.run_messages(X.progress_events(spark, sf_dir))


@query
def run_state_stream(spark, sf_dir):
    events = X.progress_from(jobs.read_stream(spark, sf_dir, "events.parquet", PARTS_A_BATCH))
    return rounded(jobs.run_to_table(live.run_state(events), "update", "run_state", keys=["run_id"]))


@query
def spend_alerts_stream(spark, sf_dir):
    events = X.progress_from(jobs.read_stream(spark, sf_dir, "events.parquet", PARTS_A_BATCH))
    return rounded(jobs.run_to_table(live.spend_alerts(events), "update", "spend", keys=["run_id"]))


def _word_stream(spark, sf_dir):
    docs = jobs.read_stream(spark, sf_dir, "documents.parquet", PARTS_A_BATCH)
    words = X.words_from(docs)
    return words.withColumn("ts", live.event_time(F.col("start_s")))


@query
def confidence_windows_stream(spark, sf_dir):
    out = live.confidence_windows_live(_word_stream(spark, sf_dir))
    return rounded(jobs.run_to_table(out, "update", "confidence", keys=["video_id", "start_ts"]).drop("end_ts"))


@query
def captions_live(spark, sf_dir):
    words = X.words(spark, sf_dir).withColumn("ts", live.event_time(F.col("start_s")))
    return rounded(live.captions_live(words))


@query
def distinct_words_stream(spark, sf_dir):
    """Every word arrives twice, as from two overlapping chunks."""
    twice = _word_stream(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = jobs.run_to_table(live.distinct_words_live(twice.drop("copy")), "append", "distinct")
    return out.select("video_id", "pos", "word")


def _deliveries(spark, rows, n):
    """A folder to which the rows are appended delivery by delivery, and a stream of it, one delivery a batch."""
    staged, arrived = jobs.new_folder(spark, "staged"), jobs.new_folder(spark, "arrivals")
    files = max(4, spark.sparkContext.defaultParallelism)
    rows.write.partitionBy("delivery").parquet(staged)
    for k in range(n):
        spark.read.schema(rows.schema).parquet(staged).filter(F.col("delivery") == k).repartition(files, "pos").write.mode("append").parquet(arrived)
    return jobs.read_stream(spark, arrived, "*.parquet", files)


def _feed(spark, sf_dir, copies=1):
    rows = X.word_feed(spark, sf_dir).filter(F.col("copy") < copies).drop("copy")
    return _deliveries(spark, rows, X.PARTS + 3).drop("delivery")


def _drained(stream, mode, name, keys=None):
    """The stream's table; fails if any state is left behind."""
    told = []
    out = jobs.run_to_table(stream, mode, name, keys, told)
    if (left := stateful.rows_of_state(told)) != 0:
        raise RuntimeError(f"{name}: {left} rows of state are left")
    return out


@query
def captions_closed_stream(spark, sf_dir):
    """Captions of words that arrive in eight deliveries, long videos first, some words late."""
    return rounded(_drained(stateful.captions_stream(_feed(spark, sf_dir)), "append", "captions"))


@query
def confidence_windows_closed_stream(spark, sf_dir):
    return rounded(_drained(stateful.confidence_windows_stream(_feed(spark, sf_dir)), "append", "windows"))


@query
def distinct_words_closed_stream(spark, sf_dir):
    """Every word arrives twice, in one delivery or in two."""
    out = _drained(stateful.distinct_words_stream(_feed(spark, sf_dir, copies=2)), "append", "distinct_closed")
    return out.select("video_id", "pos", "word")


@query
def spend_alerts_closed_stream(spark, sf_dir):
    """Events in three deliveries, then the end of every run."""
    events = X.progress_events(spark, sf_dir).select("run_id", F.col("seq").alias("pos"), "type", "cost_usd", "budget_usd", F.pmod("seq", F.lit(3)).cast("int").alias("delivery"))
    ends = events.select("run_id").distinct().select(
        "run_id", F.lit(None).cast("long").alias("pos"), F.lit("run_end").alias("type"), F.lit(None).cast("double").alias("cost_usd"),
        F.lit(None).cast("double").alias("budget_usd"), F.lit(3).alias("delivery"),
    )
    stream = _deliveries(spark, events.unionByName(ends), 4)
    return rounded(_drained(stateful.spend_alerts_stream(stream), "update", "spend_closed", keys=["run_id"]))


@query
def process_stage_stream(spark, sf_dir):
    """Cleaning as an incremental stage over arriving documents."""
    store = StageStore(spark, jobs.new_folder(spark, "stage"))
    docs = X.dirty_from(jobs.read_stream(spark, sf_dir, "documents.parquet", PARTS_A_BATCH))
    jobs.process_stage(docs, store, "clean", lambda b: b.select("doc_id", T.preprocess(F.col("text")).alias("text")))
    return store.load("clean").select("doc_id", "text")


@query
def process_stage_repeated(spark, sf_dir):
    """The same stage, resumed after all documents have arrived a second time."""
    arrived = jobs.new_folder(spark, "arrivals")
    store = StageStore(spark, jobs.new_folder(spark, "stage"))
    for _ in range(2):
        spark.read.parquet(f"{sf_dir}/documents.parquet").write.mode("append").parquet(arrived)
        docs = X.dirty_from(jobs.read_stream(spark, arrived, "*.parquet", 1000))
        jobs.process_stage(docs, store, "clean", lambda b: b.select("doc_id", T.preprocess(F.col("text")).alias("text")))
    return store.load("clean", ["doc_id"]).select("doc_id", "text")
