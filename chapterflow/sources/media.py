"""Media manifest and attempt-log scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chapterflow import schemas as S

ATTEMPTS = (
    "run_id bigint, attempt_number bigint, provider string, strategy string, chunk_index bigint, "
    "cost_usd double, success boolean, error_message string"
)


def scan_media(spark: SparkSession, path: str) -> DataFrame:
    """Path, size, time and extension of supported media. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    rows = files.select("path", F.col("length").alias("size_bytes"), "modificationTime", ext.alias("extension"))
    return rows.filter(F.col("extension").isin(S.MEDIA_EXTENSIONS))


def scan_attempts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ATTEMPTS).parquet(path)
