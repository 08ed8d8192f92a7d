"""Speech-recogniser responses (JSON text) to transcripts.

Four dialects are read. Each response row (video_id, body, provider, model)
becomes one transcript row with word and segment arrays; ``explode_words``
turns transcripts into the word table. All row-local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chapterflow import schemas as S
from chapterflow.functions.text import strip

_RAW_WORD = "struct<word:string,text:string,start:double,end:double,confidence:double>"
_BODY = (
    f"struct<text:string,duration:double,audio_duration:double,confidence:double,words:array<{_RAW_WORD}>,"
    f"segments:array<struct<start:double,end:double,text:string,words:array<{_RAW_WORD}>>>>"
)
CHARS_PER_SECOND = 15.0


def _or_one(c: Column) -> Column:
    """Missing and zero confidences count as 1."""
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(c)


def _word(word: Column, start: Column, end: Column, confidence: Column) -> Column:
    return F.struct(word.alias("word"), start.alias("start"), end.alias("end"), confidence.alias("confidence"))


def _mean(words: Column) -> Column:
    total = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + w["confidence"])
    return F.when(F.size(words) > 0, F.round(total / F.size(words), 4)).otherwise(F.lit(1.0))


def ingest_asr(responses: DataFrame, dialect: str, media: DataFrame | None = None) -> DataFrame:
    """Transcripts of one dialect: ``seconds``, ``millis``, ``text`` or ``segmented``.

    ``segmented`` rows with empty text come out with ``error`` set; without
    words their duration is the medium's (``media``: video_id, duration_s) or
    is estimated from the text length.
    """
    rows = responses.withColumn("b", F.from_json("body", _BODY))
    no_words = F.array().cast(f"array<{S.WORD}>")
    no_segments = F.array().cast(f"array<{S.SEGMENT}>")
    segments = F.coalesce(
        F.transform("b.segments", lambda s: F.struct(s["start"], s["end"], s["text"])), no_segments
    )
    raw = F.col("b.words")
    if dialect == "seconds":
        words = F.transform(raw, lambda w: _word(w["word"], w["start"], w["end"], _or_one(w["confidence"])))
        rows = rows.withColumn("words", F.coalesce(words, no_words))
        duration = F.coalesce("b.duration", F.try_element_at("words", F.lit(-1))["end"], F.lit(0.0))
        text, confidence = F.col("b.text"), _mean(F.col("words"))
    elif dialect == "millis":
        words = F.transform(
            raw, lambda w: _word(w["text"], w["start"] / 1000.0, w["end"] / 1000.0, _or_one(w["confidence"]))
        )
        rows = rows.withColumn("words", F.coalesce(words, no_words))
        duration = F.coalesce(F.col("b.audio_duration") / 1000.0, F.lit(0.0))
        text, confidence = F.coalesce("b.text", F.lit("")), _or_one(F.col("b.confidence"))
    elif dialect == "text":
        rows = rows.withColumn("words", no_words)
        duration, confidence = F.lit(0.0), F.lit(1.0)
        text = strip(F.coalesce(F.col("b.text"), F.col("body")))
    elif dialect == "segmented":
        confidence = S.lookup(S.MODEL_SIZE_CONFIDENCE, F.col("model"), S.DEFAULT_SIZE_CONFIDENCE)
        words = F.flatten(
            F.transform(
                "b.segments",
                lambda s: F.transform(
                    F.coalesce(s["words"], F.array().cast(f"array<{_RAW_WORD}>")),
                    lambda w: _word(strip(w["word"]), w["start"], w["end"], confidence),
                ),
            )
        )
        rows = rows.withColumn("words", F.coalesce(words, no_words))
        text = strip(F.coalesce("b.text", F.lit("")))
        known = F.lit(None).cast("double")
        if media is not None:
            rows = rows.join(media.select("video_id", F.col("duration_s").alias("__media_s")), "video_id", "left")
            known = F.col("__media_s")
        duration = F.coalesce(F.try_element_at("words", F.lit(-1))["end"], known, F.length(text) / CHARS_PER_SECOND)
        segments = no_segments
    else:
        raise ValueError(f"unknown dialect: {dialect}")
    error = F.when(text == "", F.lit("Empty transcription result")) if dialect == "segmented" else F.lit(None).cast("string")
    return rows.select(
        "video_id", text.alias("text"), confidence.alias("confidence"), "words", segments.alias("segments"),
        duration.alias("duration_s"), "provider", "model", error.alias("error"),
    )


def explode_words(transcripts: DataFrame) -> DataFrame:
    rows = transcripts.select("video_id", F.posexplode_outer("words").alias("pos", "w")).filter("pos is not null")
    return rows.select(
        "video_id", F.col("pos").cast("long").alias("pos"), "w.word",
        F.col("w.start").alias("start_s"), F.col("w.end").alias("end_s"), "w.confidence",
    )


def explode_segments(transcripts: DataFrame) -> DataFrame:
    rows = transcripts.select("video_id", F.posexplode_outer("segments").alias("pos", "s")).filter("pos is not null")
    return rows.select(
        "video_id", F.col("pos").cast("long").alias("pos"),
        F.col("s.start").alias("start_s"), F.col("s.end").alias("end_s"), "s.text",
    )
