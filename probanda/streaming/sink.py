"""Idempotent per-batch folders and the state store setting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from ..session import ship_package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state on local disk with changes in the checkpoint, not on the heap;
    called before any stateful stream is planned."""
    ship_package(spark).conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def batch_sink(
    stream: DataFrame,
    checkpoint: str,
    branches: Callable[[DataFrame], dict[str, DataFrame]],
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Start a query that sends each micro-batch through ``branches`` (output path to
    rows) and writes every branch to the batch's own folder.

    A run that ends when nothing new is there makes no batch without data: streams with
    timers would ask for one after another.  Their timers fire in the next run.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            for path, rows in branches(kept).items():
                rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = trigger or {"availableNow": True}
    conf, setting = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(setting)
    if trigger.get("availableNow") or trigger.get("once"):
        conf.set(setting, "false")
    try:
        return writer.trigger(**trigger).start()  # the query keeps the settings it starts with
    finally:
        conf.set(setting, before)


def read_batches(spark: SparkSession, path: str, keep_batch: bool = False) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if keep_batch else rows.drop("batch")
