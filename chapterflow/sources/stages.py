"""Stage tables in the shared folder, and published documents."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    A local session without one, as in tests, gets a temporary folder of its
    own; on a cluster a machine-local folder would be lost to the others.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all machines share")
        found = tempfile.mkdtemp(prefix="chapterflow-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class StageStore:
    """Save, load, test and clear one Parquet table per stage."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or shared_folder(spark) + "/stages").rstrip("/")

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, stage: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self.path(stage))

    def load(self, stage: str, keys: list[str] | None = None) -> DataFrame:
        """The stage table. With ``keys``, of a table written batch by batch:
        each key's rows of the latest batch that had the key, null keys included.
        """
        found = self.spark.read.parquet(self.path(stage))
        if not keys:
            return found
        last = found.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.max("batch").alias("__batch"))
        same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.col("batch") == F.col("__batch"))
        return found.join(last, same, "left_semi").drop("batch")

    def exists(self, stage: str) -> bool:
        """True once the whole table is committed, not while it is written."""
        fs, p = self._fs(self.path(stage) + "/_SUCCESS")
        return fs.exists(p)

    def commit(self, stage: str) -> None:
        """Mark a table that was written batch by batch as whole."""
        fs, p = self._fs(self.path(stage) + "/_SUCCESS")
        fs.create(p, True).close()

    def reopen(self, stage: str) -> None:
        """Take the mark away before more batches are written."""
        fs, p = self._fs(self.path(stage) + "/_SUCCESS")
        fs.delete(p, False)

    def clear(self, stage: str) -> None:
        fs, p = self._fs(self.path(stage))
        fs.delete(p, True)


def publish(df: DataFrame, path: str, partitions: int = 64, key: str = "video_id") -> None:
    """Write documents as JSON lines in hash folders of the key.

    The folder count is fixed, whatever the number of videos. Rows are spread
    by all their key columns, so a video with many documents is written by
    many tasks.
    """
    ids = [c for c in ("video_id", "number", "part") if c in df.columns]
    out = df.withColumn("folder", F.pmod(F.xxhash64(key), F.lit(partitions)))
    out.repartition(*ids).write.mode("overwrite").partitionBy("folder").json(path)
