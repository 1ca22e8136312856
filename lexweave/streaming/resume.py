"""Incremental runs: new rows of the memory as a stream, worked off in micro-batches until none are left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import store


def follow(spark: SparkSession, folder: str, work: Callable[[DataFrame, DataFrame], DataFrame], out: str, checkpoint: str) -> int:
    """Rows that arrived in folder since the last call and have no target go through work(rows, memory), whose memory is
    all rows of the folder, so that a batch sees the context and the translations stored before it; its rows are appended to out.
    Each batch has a folder of its own, written over on a retry, so a lost executor or a restart repeats nothing.
    Returns how many batches ran."""
    batches: list[int] = []

    def run(df: DataFrame, batch: int) -> None:
        todo = df.filter(~store.is_filled(df["target"]))
        work(todo, spark.read.schema(store.SCHEMA).parquet(folder)).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        batches.append(batch)

    stream = spark.readStream.schema(store.SCHEMA).parquet(folder)
    query = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)
