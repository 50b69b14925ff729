"""Streams: deltas of cells as they arrive, upkeep of an index, incremental export, ledgers and their replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.operators import ivfpq
from cellweave.schema import CELL


def deltas(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Cells of new files in a folder; arrival order does not matter, as the newest timestamp wins."""
    return spark.readStream.schema(CELL).option("maxFilesPerTrigger", files).parquet(path)


def _started(writer, checkpoint: str, every: str | None):
    """What has arrived by now, or, with an interval, all that will arrive."""
    return writer.option("checkpointLocation", checkpoint).trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def export_new(stream: DataFrame, target: str, checkpoint: str, every: str | None = None):
    """Ship what has not been shipped; the checkpoint is the watermark."""
    return _started(stream.writeStream.format("parquet").option("path", target), checkpoint, every)


def keep_index(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Arriving rows (id, vector[, label, timestamp, tombstone]) become generations of an index; a batch's number is its watermark.

    A batch that is run again after a failure finds its watermark indexed and changes nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        if ivfpq.active(batch.sparkSession, path)["indexed"] < number + 1 and not batch.isEmpty():
            ivfpq.update(batch, path, number + 1)

    return _started(stream.writeStream.foreachBatch(write), checkpoint, every)


def on_each(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run ``work`` on each batch, such as consolidation of new events."""
    return _started(stream.writeStream.foreachBatch(work), checkpoint, every)


def ledger_next(ledger: DataFrame, steps: DataFrame) -> DataFrame:
    """Steps (corr, ts_ms, action) with the sequence numbers that follow their chain's last one."""
    last = ledger.groupBy("corr").agg(F.max("seq").alias("last"))
    order = F.row_number().over(Window.partitionBy("corr").orderBy("ts_ms", "action"))
    return steps.join(last, "corr", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + order).drop("last")


def replay(ledger: DataFrame, corr: str, until_ms: int | None = None) -> DataFrame:
    out = ledger.filter(F.col("corr") == corr)
    return (out if until_ms is None else out.filter(F.col("ts_ms") <= until_ms)).orderBy("seq")
