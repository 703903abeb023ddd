"""Structured Streaming entry: monitors each micro-batch and appends its signals.

The monitored batch is the micro-batch. Its signals go to a folder named after the
micro-batch number and overwrite it, so a micro-batch that is run again after a failure
leaves the same result once. Incidents stay a batch query over the signal table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loanweave.operators import alerts
from loanweave.plans.monitoring import Monitor


def without_repeats(stream: DataFrame, ident: str, event_time: str, delay: str) -> DataFrame:
    """Drops repeated ids that arrive within the watermark; state is bounded by `delay`."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([ident])


def start(stream: DataFrame, monitor: Monitor, run: str, output: str, checkpoint: str,
          available_now: bool = True) -> StreamingQuery:
    """Starts the monitor on a stream of raw rows (without batch_sequence)."""

    def handle(batch: DataFrame, number: int) -> None:
        # A dozen jobs read the micro-batch; the source is read once.
        batch.persist()
        try:
            if batch.isEmpty():
                return
            numbered = batch.withColumn("batch_sequence", F.lit(int(number) + 1))
            monitor.signals(numbered, run).write.mode("overwrite").parquet(
                f"{output.rstrip('/')}/micro_batch={int(number)}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_signals(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output).drop("micro_batch")


def incidents(spark: SparkSession, output: str, window: int = 2) -> DataFrame:
    """Incidents over everything the stream has written so far."""
    return alerts.incidents(alerts.alert_groups(read_signals(spark, output)), window)
