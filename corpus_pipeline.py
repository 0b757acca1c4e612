"""Corpus cleaning: toxicity, quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; what it
returns is written as Parquet and read again. All but the last return the columns of documents.
"""
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import packing, quality, simhash, suffixes, toxicity
from tessera.llm.common import keep, shared_folder, tune, whole_text

TOXIC, GOOD = 0.7, 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below TOXIC."""
    model = toxicity.fit(docs, tune(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(toxicity.score(whole_text(), model) < TOXIC)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality reaches GOOD."""
    model = quality.fit(docs, tune(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(quality.score(whole_text(), model) >= GOOD)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    tune(spark)
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier text, or an earlier place in them, holds as well."""
    tune(spark)
    rows = suffixes.deduplicate(docs, first_stays=True, as_text=True)
    changed = F.col("_cut.n_removed") > 0
    new = {"text": F.when(changed, F.col("_cut.kept")).otherwise(F.col("text")),
           "n_chars": F.when(changed, F.length("_cut.kept").cast("bigint")).otherwise(F.col("n_chars"))}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their ids and their places in sequences."""
    tune(spark)
    return packing.pack(keep(packing.pieces(docs)))


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_copies", one_of_near_copies), ("repeats", cut_repeats), ("packing", pack)]
ORACLE_SQL = None        # trained models and tokenization are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each to the whole table that the one before it wrote."""
    docs = tune(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = os.path.join(shared_folder(spark), f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
