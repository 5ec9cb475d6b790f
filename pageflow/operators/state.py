"""Resume: what is left, merged results, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def remaining(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return pages.join(done, key, "left_anti")


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of repeated keys, the row that is last by `order`."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_place = 1").drop("_place")


def status(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: n_pages, n_done (of the pages), complete."""
    marked = pages.select(key).distinct().join(done.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
    out = marked.agg(F.count("*").alias("n_pages"), F.count("_done").alias("n_done"))
    return out.withColumn("complete", (F.col("n_pages") > 0) & (F.col("n_pages") == F.col("n_done")))


def remaining_with_counts(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: pages left, and pages skipped as done."""
    counts = status(pages, done, key)
    return counts.select((F.col("n_pages") - F.col("n_done")).alias("left"), F.col("n_done").alias("skipped"))


def plan(pages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The pages with `reuse`: whether their stored result counts or they have to be computed (again)."""
    marked = done.select(key).distinct().withColumn("_done", F.lit(True))
    return pages.join(marked, key, "left").withColumn("reuse", F.coalesce("_done", F.lit(False))).drop("_done")


def in_input_order(results: DataFrame, pages: DataFrame, key: str, place: str) -> DataFrame:
    """Results of the pages of this run, with their place in the input; results of other pages drop out."""
    return results.join(pages.select(key, place), key)


def replaced(results: DataFrame, done_second: DataFrame, key: str) -> DataFrame:
    """One row after the results were replaced: n_pages, n_done (second-pass pages that are still there), complete."""
    return status(results, done_second, key)


def with_default(rows: DataFrame, table: DataFrame, key: str, default: dict) -> DataFrame:
    """rows joined with a small table by key (a style's font, say), with defaults where the key is unknown."""
    found = rows.join(F.broadcast(table), key, "left")  # a table of settings, a row for each style
    return found.withColumns({name: F.coalesce(name, F.lit(value)) for name, value in default.items()})


def translated_pages(pages: DataFrame, verdicts: DataFrame, key: str, named: int = 5) -> tuple[DataFrame, DataFrame]:
    """Pages whose verdict (key, translated) is true, and one warning row for the others, or none if there are none.

    The warning has n_left and the first `named` keys in order; a page without a verdict counts as not translated.
    """
    kept = pages.join(verdicts.filter("translated").select(key).distinct(), key, "left_semi")
    left = pages.select(key).distinct().join(kept.select(key).distinct(), key, "left_anti")
    names = left.orderBy(key).limit(named).agg(F.sort_array(F.collect_list(key)).alias("first"))
    one = F.lit(1).alias("_one")
    event = left.agg(F.count("*").alias("n_left"), one).filter("n_left > 0").join(names.withColumn("_one", one), "_one")  # one row each
    return kept, event.select(F.lit("warning").alias("level"), "n_left", "first")
