"""Structured Streaming over an event table: closed windows, deduplication and the latest row of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.relational import latest
from ledgerloom.session import shared_path

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of that name in a folder."""
    return spark.readStream.schema(SCHEMA).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(events: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Counts and sums of tumbling windows; rows later than the watermark are dropped, in append mode only closed
    windows come out, so an incomplete last window never does."""
    bins = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "event_type")
    return bins.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, keys: list[str], lateness: str = "1 hour") -> DataFrame:
    """The first of repeated events within the watermark; state is dropped beyond it."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(keys)


def ledger_upserts(events: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Append each batch's latest rows of its keys to a ledger, in a folder of the batch's own: a repeated batch writes
    the same folder again, and what was written is never read or written again by a later one."""

    def append(batch: DataFrame, batch_id: int) -> None:
        latest(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return events.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).start()


def ledger_view(spark: SparkSession, path: str, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key of such a ledger; ties in ``order`` go to the later batch."""
    rows = spark.read.parquet(path)
    return latest(rows, keys, [*order, "batch"]).drop("batch")


def ledger_compacted(spark: SparkSession, path: str, keys: list[str], order: list[str], to: str) -> None:
    """Write the view as a ledger of one batch (number 0) to another folder, which then takes the old one's place."""
    ledger_view(spark, path, keys, order).write.mode("error").parquet(f"{to}/batch=0")


def watched(query, say) -> None:
    """Run a stream over what is there and ``say`` each step as ``done/known`` batches with the rows read."""
    while query.isActive:
        known = query.status["isDataAvailable"] or query.status["isTriggerActive"]
        done = [p for p in query.recentProgress if p["numInputRows"]]
        say(f"{len(done)}/{len(done) + bool(known)}", sum(p["numInputRows"] for p in done))
        if not known:
            return
        query.awaitTermination(1)


def run_to_parquet(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is there, append mode, into the shared folder, and read the result."""
    spark = stream.sparkSession
    base = shared_path(spark, f"stream-{label}")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
