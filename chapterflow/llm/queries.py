"""Queries of the corpus operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chapterflow.llm import alignment, bpe, context_tree, decontaminate, discriminant, filter_audit, fuzzy_lines, jaccard, outliers, sequences, suffix_dedup, token_counts, word_repeats
from chapterflow.llm.common import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, through a cache that starts empty."""
    counts = token_counts.token_counts(documents(spark, sf_dir), WORD_BPE, Scratch(spark, "op1").root)
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of what they decode to."""
    coded = bpe.decode(bpe.encode(documents(spark, sf_dir), BYTE_BPE), BYTE_BPE)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    found = outliers.outliers(documents(spark, sf_dir), Scratch(spark, "op4"), keep=["doc_id"])
    return found.select("row.doc_id", *outliers.STATS, "base_failed", "kept", "distance")


@query
def op6_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all texts written as Arrow sequences, and digests of what the files hold."""
    folder = Scratch(spark, "op6").root
    sequences.write_sequences(documents(spark, sf_dir), WORD_BPE, folder)
    return sequences.read_documents(spark, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base score and context-tree score of every document."""
    return context_tree.scores(documents(spark, sf_dir), Scratch(spark, "op3"), folds=7, fold=2)


@query
def op10_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out third."""
    scratch = Scratch(spark, "op10")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = scratch.store("features", discriminant.features(documents(spark, sf_dir))).withColumn("held_out", held_out)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = discriminant.fit(rows.where(~F.col("held_out")).join(labels, "doc_id"), "quality")
    scored = discriminant.scored(rows, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak: document, benchmark item, places and edits. Clean documents have no row."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contaminated(documents(spark, sf_dir), benchmark)


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by links of three-word shingle sets at 0.9."""
    return jaccard.groups(documents(spark, sf_dir), Scratch(spark, "op5"), 3, 9, 10).drop("node")


@query
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, size and lines of every text after fuzzy line dedup."""
    left = fuzzy_lines.deduplicated(documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark, "op7"))
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n")))
    return left.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), n_lines.cast("bigint").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every text, and the digest of what is kept."""
    left = suffix_dedup.deduplicated(documents(spark, sf_dir), Scratch(spark, "op9"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removals of five filters in all 120 orders, for every language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counts = Scratch(spark, "op11").store("masks", filter_audit.masks(documents(spark, sf_dir), labels))
    return filter_audit.audit(counts, "ABCDE")


ORACLES["op11_filter_audit"] = r"""
with texts as (
  select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents
), failed as (
  select part, [
      len(words) < 200,
      100 * len(list_distinct(words)) < 50 * len(words),
      100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t),
      regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > min(doc_id) over (partition by t), false)] as fails,
    coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as bad
  from texts left join labels using (doc_id)
), masks as (
  select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (bad) as bad from failed group by all
), five as (
  select unnest(range(1, 6)) as f
), orders as (
  select [a.f, b.f, c.f, d.f, e.f] as o from five a, five b, five c, five d, five e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps as (
  select array_to_string(list_transform(o, lambda x: chr((64 + x)::int)), '') as filter_order, s.f::int as step, o[s.f] as own, o[1:s.f - 1] as earlier from orders, five s
), told as (
  select *, fails[own] as hit, len(list_filter(earlier, lambda x: fails[x])) > 0 as gone, len(list_filter(fails, lambda x: x)) as n_failed from masks, steps
), rows as (
  select part, filter_order, step, own,
    coalesce(sum(n) filter (not hit and not gone), 0)::bigint as kept,
    coalesce(sum(n) filter (hit and not gone), 0)::bigint as removed,
    coalesce(sum(n) filter (hit and gone), 0)::bigint as redundant,
    coalesce(sum(n) filter (hit and n_failed = 1), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (hit and not gone), 0)::bigint as good_lost,
    coalesce(sum(bad) filter (hit and not gone), 0)::bigint as toxic_lost
  from told group by all
)
select * exclude (own), (sum(removed) over (partition by part, own))::bigint as shapley from rows
"""


@query
def op12_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every text where 35 words stand again, and the digest of what is kept."""
    left = word_repeats.deduplicated(documents(spark, sf_dir), Scratch(spark, "op12"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return left.select("doc_id", "n_words", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the byte-level and the piece tokens of every text line up."""
    return alignment.alignments(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE, Scratch(spark, "op13"))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, sf_dir)
