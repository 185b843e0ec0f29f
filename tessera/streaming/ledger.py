"""Candidates over a stream of files, and over events in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import review, sweep
from ..plans.rules import Rule


def follow(files: DataFrame, rules: list[Rule], folder: str, checkpoint: str):
    """Starts a query that sweeps each new batch of files (path, content) and replaces their source's block in a ledger table.

    A row carries a whole file, so a batch needs nothing from earlier ones; a batch that is run again gives the same ids.
    """

    def settle(batch: DataFrame, number: int) -> None:
        hits = sweep.pattern_hits(batch, rules).select(*sweep.LEDGER)
        hits.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    return files.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window; on a stream, windows close once the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def gate_of(folder: DataFrame) -> DataFrame:
    return review.gate(folder)
