"""One query for each corpus operator, over its whole table, with production parameters.

None of the ten can be written as one SQL statement (trained models, vocabularies, hashing or iteration), so there is no
oracle SQL; tests/llm holds each against a brute-force version, a round trip or held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import brown_lm as m

    return m.score(table(spark, sf_dir, "documents"))


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import fm_quality as m

    docs = table(spark, sf_dir, "documents")
    return _judged(m.score_texts(docs, m.train(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import dart_minhash as m

    return m.classes(table(spark, sf_dir, "documents")).drop("digest")


def op4_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mcd_rules as m

    return m.judge(table(spark, sf_dir, "documents"))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import cf_toxicity as m

    docs = table(spark, sf_dir, "documents")
    return _judged(m.score_texts(docs, *m.train(docs, table(spark, sf_dir, "labels"))), 4, 2)


def _judged(scores: DataFrame, parts: int, held: int, threshold: float = 0.3) -> DataFrame:
    return scores.select("doc_id", (fold("doc_id", parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_seekable_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import seekable_ids as m

    return m.encode_documents(table(spark, sf_dir, "documents"))[1]


def op7_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import certified_packing as m

    return m.pack_documents(table(spark, sf_dir, "documents")).drop("row")


def op8_heap_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe_count as m

    return m.count_tokens(table(spark, sf_dir, "documents"))


def op9_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import adaptive_scan as m

    return m.search(table(spark, sf_dir, "embeddings"))


def op10_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import entropy_mix as m

    return m.mix_documents(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_brown_classes, op2_factorisation_machine, op3_dart_minhash, op4_mcd_outliers, op5_counterfactual_toxicity, op6_seekable_frames, op7_certified_packing, op8_heap_merge_counts, op9_adaptive_scan, op10_entropy_balancing)}
ORACLE_SQL: dict[str, str] = {}
