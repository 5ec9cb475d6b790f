"""Progress events: rollups, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rollup(events: DataFrame) -> DataFrame:
    """event_type, n, users, total and last event of each type."""
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum(F.col("value").cast("decimal(18,6)")), 6).cast("double").alias("total"), F.max("event_id").alias("last_event"))


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events per hour and type; works on a stream (late data is dropped behind the watermark) and on a table."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def batch_metrics(elements: DataFrame, batch: Column) -> DataFrame:
    """Counts of each batch, of rows (page, cls, text, valid): pages, bubbles, raw boxes, kept and filtered texts, level.

    Texts that nothing was read of drop out silently; read but invalid ones are counted as filtered.
    """
    box = F.col("cls") != "bubble"
    read = box & (F.coalesce(F.length("text"), F.lit(0)) > 0)
    valid = F.coalesce("valid", F.lit(False))
    counts = elements.groupBy(batch.alias("batch")).agg(
        F.countDistinct("page").alias("pages"), F.count_if(~box).alias("bubbles"), F.count_if(box).alias("raw_boxes"), F.count_if(read & valid).alias("kept"), F.count_if(read & ~valid).alias("filtered")
    )
    return counts.withColumn("level", F.when((F.col("filtered") > 0) & (F.col("kept") == 0), "warning").otherwise("info"))
