"""The corpus pipeline: toxicity, quality, near-duplicates, mixing and packing, each over all that the stage before kept.

Stages keep the columns of documents, whatever other columns there are and however they are named; only the last returns
pieces. Null and empty texts score as such, are copies of each other and have size 0; null ids, languages and sources are
values of their own. Of rows that repeat an id and a text one stays; other ties are settled as the operators say. Texts are
taken whole. An empty table passes through all stages as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageflow.llm import cf_toxicity, certified_packing, dart_minhash, entropy_mix, fm_quality
from pageflow.llm.common import Scratch, small_batches, word_count

#: Documents scored at or above are toxic; documents scored below are of low quality.
TOXIC, QUALITY = 0.3, 0.3


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops toxic documents. The model learns from the labelled documents outside its held-out fold."""
    source, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return cf_toxicity.keep(docs, *cf_toxicity.train(source, labels), threshold=TOXIC)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of low quality."""
    source, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return fm_quality.keep(docs, fm_quality.train(source, labels), threshold=QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    with small_batches(spark):
        return dart_minhash.keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.struct("*").alias("row"))
    return entropy_mix.repeated(entropy_mix.mix(sized)).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    with small_batches(spark):
        return certified_packing.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Trained models, hashing and iteration: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before = len(Scratch.made)
        done = scratch.save(stage(spark, docs, sf_dir), f"stage{k}-{name}")
        Scratch.clear_from(before)  # what the stage wrote for itself
        if k:
            scratch.drop(f"stage{k - 1}-{STAGES[k - 1][0]}")
        docs = done
    return docs
