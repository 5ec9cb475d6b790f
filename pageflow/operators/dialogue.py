"""Numbered requests, their responses, bounded history and translated pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t


def numbered(conversations: DataFrame) -> DataFrame:
    """page_num, text_num, key and text of each turn; keys are page.text."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    d = conversations.select((F.col("conv_id") + 1).alias("page_num"), F.row_number().over(order).cast("long").alias("text_num"), F.regexp_replace("text", "\n", " ").alias("text"))
    return d.withColumn("key", F.concat_ws(".", "page_num", "text_num"))


def requests(dialogue: DataFrame) -> DataFrame:
    """page_num and its request: one line `key.(text)` for each text."""
    lines = F.array_sort(F.collect_list(F.struct("text_num", F.concat("key", F.lit(".("), "text", F.lit(")")).alias("line"))))
    return dialogue.groupBy("page_num").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("request"))


def parsed(response: DataFrame) -> DataFrame:
    """line_no, key and text of the lines that have a key."""
    return response.select("line_no", t.response_key(F.col("line")).alias("key"), t.response_text(F.col("line")).alias("answer")).filter("key is not null")


def answers(response: DataFrame) -> DataFrame:
    """key and answer; of repeated keys the last line counts."""
    return parsed(response).groupBy("key").agg(F.max_by("answer", "line_no").alias("answer"))


def apply_response(dialogue: DataFrame, response: DataFrame) -> DataFrame:
    return dialogue.join(answers(response), "key", "left")


def missing(dialogue: DataFrame, response: DataFrame) -> DataFrame:
    return dialogue.join(answers(response), "key", "left_anti")


def unknown(dialogue: DataFrame, response: DataFrame) -> DataFrame:
    return answers(response).join(dialogue, "key", "left_anti")


def translated_pages(applied: DataFrame) -> DataFrame:
    """page_num, whether all its texts have an answer that isn't blank, and how many do."""
    ok = F.coalesce(F.trim("answer") != "", F.lit(False))
    return applied.groupBy("page_num").agg(F.bool_and(ok).alias("translated"), F.count_if(ok).alias("n_translated"), F.count("*").alias("n_texts"))


def history(conversations: DataFrame, exchanges: int = 6) -> DataFrame:
    """conv_id, turn, and number and signs of the turns remembered before it."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2 * exchanges, -1)
    return conversations.select("conv_id", "turn", F.count("*").over(before).alias("remembered"), F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).alias("signs"))


def count_audit(applied: DataFrame) -> DataFrame:
    """page_num, asked, answered and short: how many texts of a page have no line in the response."""
    return applied.groupBy("page_num").agg(F.count("*").alias("asked"), F.count("answer").alias("answered"), (F.count("*") - F.count("answer")).alias("short"))


def number_elements(elements: DataFrame) -> DataFrame:
    """page, kind, ord, text and key `page.number` of the texts that aren't empty: bubbles (kind 0) first, then free ones (1)."""
    some = elements.filter(F.coalesce(F.col("text") != "", F.lit(False)))
    number = F.row_number().over(Window.partitionBy("page").orderBy("kind", "ord"))
    return some.select("page", "kind", "ord", "text", F.concat_ws(".", "page", number).alias("key"))


def pages_translated(pages: DataFrame, applied: DataFrame) -> DataFrame:
    """page_num and whether all its texts have an answer that isn't blank; a page without texts counts as translated."""
    return pages.select("page_num").distinct().join(translated_pages(applied), "page_num", "left").select("page_num", F.coalesce("translated", F.lit(True)).alias("translated"))


def second_request(dialogue: DataFrame, response: DataFrame) -> DataFrame:
    """The request for the texts that a response left out, for the one retry; empty where nothing is missing."""
    return requests(missing(dialogue, response))


def with_retry(dialogue: DataFrame, response: DataFrame, retried: DataFrame) -> DataFrame:
    """Each text with its answer: the response's, else the retry's, else empty."""
    second = answers(retried).select("key", F.col("answer").alias("_second"))
    return apply_response(dialogue, response).join(second, "key", "left").withColumn("answer", F.coalesce("answer", "_second", F.lit(""))).drop("_second")
