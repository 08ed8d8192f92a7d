"""Fixtures of awkward documents, for all operators."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block bigint, ids string, digest string, keep string"


def frame(spark, rows):
    """Documents from (doc_id, text); with extra columns whose names operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), 7, "x", "y", "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one two three"), (5, "one two three"), (5, "one two three"), (None, "null id here"),
    (6, "Ünïcode çödé 中文 😀 <|endoftext|>x <|ENDOFTEXT|> it's we'll\x1c \xa0y　  z"), (7, "a" * 5000), (8, "ab cd ef " * 4000), (9, "́x İ Σ"),
]


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()]
