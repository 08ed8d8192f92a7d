"""Token counts through a digest cache.

Contents are keyed by the digest of their normalised form, counts are stored
under the digest of the tokenizer's version; only distinct contents that the
cache lacks are encoded, and their counts are appended to it.

Defined cases: a null text is empty (0 tokens); equal and repeated rows each
get their row; a null id stays null; an empty table gives no row; columns
other than id and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chapterflow.llm.common import texts
from chapterflow.llm.fragments import Memo

#: Settings that the counts depend on besides the tokenizer's file.
SETTINGS = "tokens-1;special=default;added=no;truncation=no;padding=no;spaces=ascii-runs"


def version(path: str) -> str:
    """Digest of the tokenizer's file and of the settings of the count."""
    return hashlib.sha256(Path(path).read_bytes() + SETTINGS.encode()).hexdigest()


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space, none at the ends.

    Only for tokenizers that drop white space: there equal forms have equal
    counts. Letter case stays, for special strings depend on it.
    """
    return F.btrim(F.regexp_replace(text, r"[\t\n\x0B\f\r ]+", " "), F.lit(" "))


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(path, len)
        for b in batches:
            n = [sum(memo.lookup(t.as_buffer().to_pybytes().split())) for t in b.column("content")]
            yield pa.record_batch({"digest": b.column("digest"), "n_tokens": pa.array(n, pa.int64())})

    return run


def stored_counts(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """(digest, n_tokens) of one tokenizer version; None where nothing is stored yet.

    Runs that append at the same time may store a digest twice, with the same
    count; one row of it is returned.
    """
    try:
        found = spark.read.schema("digest binary, n_tokens bigint").parquet(f"{cache}/tokenizer={tokenizer}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row.

    path: file of a white-space-dropping tokenizer, readable on all machines.
    cache: folder of the stored counts, shared by all machines.
    """
    spark, known = docs.sparkSession, version(path)
    keyed = (
        texts(docs, id_col, text_col)
        .select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), normalised(F.col("text")).alias("content"))
        .withColumn("digest", F.unhex(F.sha2("content", 256)))
    )
    distinct = keyed.groupBy("digest").agg(F.first("content").alias("content"))
    stored = stored_counts(spark, cache, known)
    misses = distinct if stored is None else distinct.join(stored.select("digest"), "digest", "left_anti")
    counted = misses.mapInArrow(_counted(path), "digest binary, n_tokens bigint")
    counted.write.mode("append").parquet(f"{cache}/tokenizer={known}")
    return keyed.select("doc_id", "n_bytes", "digest").join(stored_counts(spark, cache, known), "digest").drop("digest")
