"""Streaming twins of the mergeable aggregates, and event-time windows (an extension).

Each function turns a stream (or a table, with the same result) into the aggregate; Spark keeps its state. State is
bounded by the groups: regions, thresholds, types, or windows that the watermark has not closed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accessgeo.operators.metrics import counts


def confusion_counts(rows: DataFrame, threshold: float, by: Sequence[str]) -> DataFrame:
    """tp, fp, fn, tn per group of the labelled rows so far."""
    return rows.where(F.col("label").isNotNull()).groupBy(*by).agg(*counts(F.col("label"), F.col("prob") >= threshold))


def snapshot_counts(elements: DataFrame, snapshot: str) -> DataFrame:
    """Per type: elements so far, those without a time, and those newer than the snapshot."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return elements.groupBy("type").agg(F.count(F.lit(1)).alias("elements"), n(F.col("ts").isNull()).alias("missing"), n(F.col("ts") > F.lit(snapshot).cast("timestamp")).alias("newer"))


def window_counts(events: DataFrame, size: str, late: str, by: Sequence[str]) -> DataFrame:
    """Events and their integer sum per tumbling window; rows later than `late` behind the newest are dropped from closed windows."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
    return out.select(F.col("window.start").alias("begin"), *by, "n", "amount")


def first_seen(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key once within the watermark, so the state forgets old keys."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> None:
    """Process what is there and stop. In complete mode each batch replaces the table, so a batch that is run again changes nothing."""
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "complete":
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    else:
        query = writer.format("parquet").option("path", path).start()
    query.awaitTermination()
