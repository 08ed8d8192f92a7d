"""Costs, budgets, attempts, capabilities, resume and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chapterflow import schemas as S
from chapterflow.operators import blocks
from chapterflow.operators.blocks import BLOCK

# --- fixed values -----------------------------------------------------------
DURATION_REJECTIONS = [
    "duration exceeded", "duration exceeds", "file too large", "audio duration", "maximum duration",
    "max duration", "too long", "request_too_large", "request entity too large", "entity too large",
    "exceeds limit", "exceeds maximum",
]
# ----------------------------------------------------------------------------


def classify_error(status: Column, message: Column) -> Column:
    """transient (429, 5xx), duration (the file was refused for its length) or permanent."""
    refused = F.lower(message).rlike("|".join(DURATION_REJECTIONS))
    transient = (status == 429) | status.between(500, 599)
    return (
        F.when(F.coalesce(refused, F.lit(False)), F.lit("duration"))
        .when(F.coalesce(transient, F.lit(False)), F.lit("transient"))
        .otherwise(F.lit("permanent"))
    )


def asr_cost(duration_s: Column, provider: Column) -> Column:
    return S.lookup(S.ASR_PRICE_PER_MINUTE, provider, S.ASR_DEFAULT_PRICE) * duration_s / 60.0


def model_cost(tokens: Column, provider: Column) -> Column:
    return S.lookup(S.MODEL_PRICE_PER_M_TOKENS, provider, S.MODEL_DEFAULT_PRICE) * tokens / 1000000.0


def estimate_costs(usage: DataFrame) -> DataFrame:
    """Price rows of (kind ``asr``|``model``, provider, duration_s, tokens).

    ``defaulted`` marks providers without a listed price.
    """
    asr = F.col("kind") == "asr"
    listed = F.when(asr, F.col("provider").isin(list(S.ASR_PRICE_PER_MINUTE))).otherwise(
        F.col("provider").isin(list(S.MODEL_PRICE_PER_M_TOKENS))
    )
    cost = F.when(asr, asr_cost(F.col("duration_s"), F.col("provider"))).otherwise(
        model_cost(F.col("tokens"), F.col("provider"))
    )
    return usage.withColumns({"cost_usd": cost, "defaulted": ~listed})


def budget_gate(spend: DataFrame, budget_usd: float, size: int = 65536) -> DataFrame:
    """Running spend per run in ``seq`` order and whether the budget is broken.

    Spending exactly the budget passes.
    """
    rows = blocks.spread(spend, ["run_id"], "seq", size)
    rows = blocks.add_running_sum(rows, ["run_id"], "seq", "total_usd", F.col("cost_usd"))
    return rows.withColumn("over_budget", F.col("total_usd") > budget_usd).drop(BLOCK)


def first_breaches(gated: DataFrame) -> DataFrame:
    """Where each run first exceeded its budget."""
    return gated.filter("over_budget").groupBy("run_id").agg(
        F.min("seq").alias("seq"), F.min_by("total_usd", "seq").alias("total_usd")
    )


def transcription_summary(attempts: DataFrame) -> DataFrame:
    """Cost and chunk use per run. The attempts themselves stay a table."""
    chunk = F.col("strategy") == "chunk"
    return attempts.groupBy("run_id").agg(
        F.sum("cost_usd").alias("total_cost_usd"),
        F.max(chunk).alias("used_chunking"),
        F.count_distinct(F.when(chunk, F.col("chunk_index"))).alias("chunk_count"),
        F.count_if(chunk & ~F.col("success")).alias("failed_chunks"),
        F.count(F.lit(1)).alias("n_attempts"),
    )


def provider_scorecard(attempts: DataFrame, size: int = 65536) -> DataFrame:
    """Calls, retries, fallbacks, error mix and cost per provider.

    A retry follows a failure of the same provider in the same run; a
    fallback follows a failure of another one and counts for the provider
    moved to.
    """
    rows = attempts.select(
        "run_id", "attempt_number", "provider", "success", "cost_usd",
        F.when(~F.col("success"), classify_error(F.col("status"), F.col("error_message"))).alias("error_class"),
    )
    rows = blocks.with_lag(
        rows, ["run_id"], "attempt_number", size, prev_provider=F.col("provider"), prev_success=F.col("success")
    )
    again = ~F.col("prev_success")
    return rows.groupBy("provider").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("success")).alias("successes"),
        F.count_if(again & (F.col("prev_provider") == F.col("provider"))).alias("retries"),
        F.count_if(again & (F.col("prev_provider") != F.col("provider"))).alias("fallbacks"),
        F.count_if(F.col("error_class") == "transient").alias("transient_errors"),
        F.count_if(F.col("error_class") == "permanent").alias("permanent_errors"),
        F.count_if(F.col("error_class") == "duration").alias("duration_errors"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def cheapest_combination(workload: DataFrame) -> DataFrame:
    """Cheapest recogniser and model per row of (duration_s, tokens).

    The two prices add up, so the cheapest pair is the cheapest of each.
    """

    def best(prices: dict[str, float], amount: Column, name: str) -> Column:
        options = [
            F.struct((F.lit(p) * amount).alias("cost"), F.lit(provider).alias("provider"))
            for provider, p in prices.items()
        ]
        return F.array_min(F.array(*options)).alias(name)

    rows = workload.select(
        "*",
        best(S.ASR_PRICE_PER_MINUTE, F.col("duration_s") / 60.0, "asr"),
        best(S.MODEL_PRICE_PER_M_TOKENS, F.col("tokens") / 1000000.0, "model"),
    )
    return rows.select(
        *workload.columns, F.col("asr.provider").alias("asr_provider"), F.col("model.provider").alias("model_provider"),
        (F.col("asr.cost") + F.col("model.cost")).alias("cost_usd"),
    )


def capability_gaps(requests: DataFrame) -> DataFrame:
    """Features a chosen provider lacks, and other providers having all of them.

    Requests are (video_id, provider, required array). Row-local: providers
    and features are a fixed handful.
    """
    lacking = F.filter("required", lambda f: ~S.supports(F.col("provider"), f))
    rows = requests.withColumn("missing", lacking)
    names = F.array(*map(F.lit, S.CAPABILITIES))
    others = F.filter(
        names, lambda p: (p != F.col("provider")) & F.forall("missing", lambda f: S.supports(p, f))
    )
    return rows.filter(F.size("missing") > 0).withColumn("suggested", others)


def resume_plan(videos: DataFrame, status: DataFrame, stages: list[str] | None = None) -> DataFrame:
    """First stage without a committed result per video, or done.

    A video's finished stages fit a bit mask, so one aggregation and one join
    replace the videos-by-stages product.
    """
    stages = S.STAGES if stages is None else stages
    order = S.lookup({s: i for i, s in enumerate(stages)}, F.col("stage"))
    done = (
        status.filter("success").filter(F.col("stage").isin(stages))
        .groupBy("video_id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1), order)).alias("mask"))
    )
    rows = videos.select("video_id").join(done, "video_id", "left")
    mask = F.coalesce("mask", F.lit(0))
    stage, index = F.lit("done"), F.lit(len(stages))
    for i in reversed(range(len(stages))):
        absent = mask.bitwiseAND(F.lit(1 << i)) == 0
        stage, index = F.when(absent, F.lit(stages[i])).otherwise(stage), F.when(absent, F.lit(i)).otherwise(index)
    return rows.select("video_id", stage.alias("resume_stage"), index.cast("long").alias("stage_index"))


def processing_report(chapters: DataFrame, costs: DataFrame, timeline: DataFrame, review_below: float = 0.7) -> DataFrame:
    """One report row per video: chapters, costs, run time, warning counts.

    ``report_warnings`` lists the warnings themselves. Every input is reduced
    to one row per video before the joins.
    """
    low = F.col("confidence") < review_below
    per_chapter = chapters.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("chapters_generated"),
        F.count_if(low).alias("warnings_count"),
        F.count_if(F.col("confidence") < 0.5).alias("needs_review_count"),
    )
    asr = F.col("kind") == "asr"
    spent = costs.groupBy("video_id").agg(
        F.coalesce(F.sum(F.when(asr, F.col("cost_usd"))), F.lit(0.0)).alias("asr_cost_usd"),
        F.coalesce(F.sum(F.when(~asr, F.col("cost_usd"))), F.lit(0.0)).alias("model_cost_usd"),
        F.max(F.when(asr, F.col("provider"))).alias("asr_provider"),
        F.max(F.when(~asr, F.col("provider"))).alias("model_provider"),
    )
    zero = F.lit(0).cast("long")
    joined = timeline.join(per_chapter, "video_id", "left").join(spent, "video_id", "left")
    return joined.select(
        *timeline.columns,
        *[F.coalesce(c, zero).alias(c) for c in ("chapters_generated", "warnings_count", "needs_review_count")],
        "asr_provider", "model_provider",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("asr_cost_usd", "model_cost_usd")],
        (F.coalesce("asr_cost_usd", F.lit(0.0)) + F.coalesce("model_cost_usd", F.lit(0.0))).alias("total_cost_usd"),
    )


def report_warnings(chapters: DataFrame, review_below: float = 0.7) -> DataFrame:
    return chapters.filter(F.col("confidence") < review_below).select(
        "video_id", "number", F.lit("low_confidence").alias("warning_type"), F.col("confidence").alias("confidence_score"),
        F.lit("Low segmentation confidence - manual review recommended").alias("message"),
    )


def alerts(report: DataFrame, budget_usd: float) -> DataFrame:
    """Alert rows of a report that also carries fallbacks, retries,
    run_seconds and duration_s."""
    over = F.col("total_cost_usd") / budget_usd
    rules = [
        (over > 1, "error", "cost above budget"),
        ((over > 0.8) & (over <= 1), "warning", "cost above 80% of budget"),
        (F.col("chapters_generated") == 0, "error", "no chapters"),
        (F.col("warnings_count") > 3, "warning", "more than 3 warnings"),
        (F.col("needs_review_count") > 1, "warning", "more than 1 chapter to review"),
        (F.col("fallbacks") > 2, "warning", "more than 2 fallbacks"),
        (F.col("retries") > 5, "warning", "more than 5 retries"),
        (F.col("run_seconds") > 2 * F.col("duration_s"), "warning", "slower than twice the media duration"),
    ]
    fired = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(level).alias("level"), F.lit(text).alias("alert"))) for c, level, text in rules])
    )
    return report.select("video_id", F.inline(fired))
