"""Table types and small fixed dimensions.

Dimensions are a handful of rows, so they enter expressions as literal maps
or arrays: no join, nothing to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "struct<word:string,start:double,end:double,confidence:double>"
SEGMENT = "struct<start:double,end:double,text:string>"
CHAPTERS_JSON = (
    "array<struct<number:bigint,title:string,start_time:string,end_time:string,"
    "start_seconds:double,end_seconds:double,confidence:double,transcript:string>>"
)
HIGHLIGHT = "struct<timestamp:string,type:string,label:string,quote:string,importance:string>"
ENRICHMENT_JSON = (
    "struct<chapter:struct<title:string,title_seo:string,slug:string>,"
    "content:struct<description:string,context:string,summary_bullets:array<string>>,"
    "knowledge:struct<terms_used:array<struct<term:string,type:string,frequency:int,definition:string>>,"
    "key_concepts:array<string>,entities_detected:map<string,array<string>>>,"
    f"highlights:array<{HIGHLIGHT}>,"
    "pedagogy:struct<difficulty_level:string,prerequisites:array<string>,"
    "learning_objectives:array<string>,teaching_methods:array<string>>,"
    "confidence:struct<segmentation_score:double,transcription_quality:double,content_coherence:double,"
    "needs_review:boolean,review_reasons:array<string>>>"
)

# --- fixed values -----------------------------------------------------------
ASR_PRICE_PER_MINUTE = {"groq": 0.0004, "assemblyai": 0.0004, "openai": 0.006}
ASR_DEFAULT_PRICE = 0.001
MODEL_PRICE_PER_M_TOKENS = {"deepseek": 0.14, "groq": 0.0007, "openai": 2.50}
MODEL_DEFAULT_PRICE = 0.01
FEATURES = ["word_timestamps", "speaker_diarization", "utterances"]
CAPABILITIES = {
    "groq": {"features": [], "max_duration_s": 0.0, "max_bytes": 25 * 1024 * 1024},
    "assemblyai": {"features": ["word_timestamps", "speaker_diarization"], "max_duration_s": 0.0, "max_bytes": 0},
    "openai": {"features": [], "max_duration_s": 0.0, "max_bytes": 25 * 1024 * 1024},
    "mlx-whisper": {"features": ["word_timestamps"], "max_duration_s": 3600.0, "max_bytes": 0},
}
CHUNK_MINUTES = {"groq": 8, "assemblyai": 30, "openai": 25, "mlx": 20}
DEFAULT_CHUNK_MINUTES = 20
STAGES = ["extract", "transcribe", "segment", "enrich", "materialize"]
MODEL_SIZE_CONFIDENCE = {
    "tiny": 0.6, "base": 0.7, "small": 0.8, "medium": 0.85, "large": 0.9, "large-v2": 0.92, "large-v3": 0.94,
}
DEFAULT_SIZE_CONFIDENCE = 0.7
HIGHLIGHT_TYPES = ["insight", "warning", "example", "takeaway", "demo", "hook", "controversial", "definition"]
IMPORTANCES = ["alta", "media", "baja"]
# metric -> (warning below, review below)
CONFIDENCE_THRESHOLDS = {
    "segmentation_score": (0.7, 0.5),
    "transcription_quality": (0.8, 0.6),
    "content_coherence": (0.8, 0.7),
}
# duration below (seconds) -> (fewest, most) chapters
CHAPTER_COUNT_BANDS = [(300, 1, 2), (900, 2, 4), (1800, 3, 6), (3600, 6, 10), (7200, 10, 15), (float("inf"), 15, 20)]
MEDIA_EXTENSIONS = [".mp4", ".mov", ".avi", ".mkv"]
# ----------------------------------------------------------------------------


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """Value of ``key`` in a small mapping, as an expression."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def supports(provider: Column, feature: Column) -> Column:
    """Whether a provider has a feature; unknown providers and features have none."""
    known = {name: F.array(*map(F.lit, c["features"])).cast("array<string>") for name, c in CAPABILITIES.items()}
    pairs = F.create_map(*[x for n, a in known.items() for x in (F.lit(n), a)])
    return F.coalesce(F.array_contains(F.try_element_at(pairs, provider), feature), F.lit(False))
