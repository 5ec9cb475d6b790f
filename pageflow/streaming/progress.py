"""Progress events as a stream: log lines, counts by hour, and page batches as micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.events import hourly
from ..schema import PROGRESS

# What the phases and levels are called in log lines.
LABELS = {"loading_models": "loading", "detection": "detection", "ocr": "reading", "font_analysis": "fonts", "translation": "translation", "pass1_batch": "pass 1", "saving_json": "saving", "pass2_page": "pass 2", "complete": "complete"}
MARKS = {"info": "", "warning": "⚠️ ", "error": "❌ "}


def lines(events: DataFrame) -> DataFrame:
    """events with `line`: mark, [label], progress (with per cent for single pages), message."""
    named = lambda table, c: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col(c)), F.lit(""))
    count = F.concat(F.lit(" "), "current", F.lit("/"), "total")
    percent = F.floor(F.col("current") / F.greatest(F.col("total"), F.lit(1)) * 100)
    done = F.when((F.col("phase") == "pass2_page") & (F.col("total") > 0), F.concat(count, F.lit(" ("), percent, F.lit("%)"))).when(F.col("phase") == "pass1_batch", count).otherwise("")
    return events.withColumn("line", F.rtrim(F.concat(named(MARKS, "level"), F.lit("["), named(LABELS, "phase"), F.lit("]"), done, F.lit(" "), F.coalesce("message", F.lit("")))))


def read(spark: SparkSession, folder: str, *, files: int = 50) -> DataFrame:
    """The events that jobs append to a folder, as a stream."""
    return spark.readStream.schema(PROGRESS).option("maxFilesPerTrigger", files).parquet(folder)


def counts(events: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends events per closed hour and type to `out`; restarts go on from the checkpoint."""
    return hourly(events.withColumnRenamed("phase", "event_type")).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out, format="parquet")


def page_batches(spark: SparkSession, folder: str, each: Callable[[DataFrame, int], None], checkpoint: str, *, pages: int = 50) -> StreamingQuery:
    """Calls each(page images, batch number) for the pages of a folder that no earlier run took, `pages` at a time."""
    schema = spark.read.format("image").load(folder).schema
    stream = spark.readStream.format("image").schema(schema).option("maxFilesPerTrigger", pages).load(folder)
    rows = stream.select(F.element_at(F.split("image.origin", "/"), -1).alias("page"), "image")
    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
