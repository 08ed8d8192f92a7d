"""Running streams to the end of their input, resumably."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chapterflow.sources.stages import StageStore, shared_folder

#: State lies on disk, with a bounded cache, so it may outgrow the memory of the executors.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def read_stream(spark: SparkSession, folder: str, pattern: str, files_per_trigger: int = 1) -> DataFrame:
    """Stream the Parquet files of a folder that match ``pattern``, typed by the files themselves.

    ``pattern`` may also name a table that is a folder of part files.
    """
    table = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    fs = table.getFileSystem(spark._jsc.hadoopConfiguration())
    if not any(c in pattern for c in "*?[{") and fs.exists(table) and fs.getFileStatus(table).isDirectory():
        folder, pattern = f"{folder}/{pattern}", "*"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream under the shared folder."""
    return f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None, told: list | None = None) -> DataFrame:
    """Drain a stream into a table of the shared folder and return the table.

    ``append`` output is written as it comes. ``update`` output is written per
    micro-batch and the latest batch wins for each of ``keys``; a batch
    replayed after a failure overwrites its own folder, so nothing doubles.
    ``told`` receives the progress reports of the query.
    """
    spark = stream.sparkSession
    root = new_folder(spark, name)
    table, progress = f"{root}/table", f"{root}/progress"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:  # a query keeps the settings with which it starts
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", progress).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    if told is not None:
        told.extend(query.recentProgress)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    written = spark.read.schema(schema).parquet(table)
    if mode == "append" or keys is None:
        return written.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    latest = written.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x"))
    return latest.select(*keys, "x.*").select(*stream.columns)


def process_stage(
    incoming: DataFrame, store: StageStore, stage: str, work: Callable[[DataFrame], DataFrame]
) -> None:
    """Run ``work`` on each arriving batch of videos and add it to the stage table.

    Each micro-batch owns one folder named by its id, so a replay replaces
    rather than repeats, and the stream's checkpoint is the resume point. The
    stage exists once all that has arrived is written; ``load`` with the
    video's key gives each video as the latest batch has it.
    """
    store.reopen(stage)

    def step(batch: DataFrame, batch_id: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{store.path(stage)}/batch={batch_id}")

    query = (
        incoming.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{store.root}/_progress/{stage}").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    store.commit(stage)
