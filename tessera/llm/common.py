"""Helpers shared by the operators: shared tables, text columns, folds, bounded samples, components."""
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per Arrow batch: texts may be long, and a worker holds one batch at a time.
BATCH_ROWS = 128


def tune(spark: SparkSession) -> SparkSession:
    """Runtime options of the operators; sizing stays with the cluster."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local master may go without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-shared"


def keep(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"llm-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(name: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text modulo ``parts``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def first_by_hash(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, the same ones at every run: those whose hashed key comes first."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), key).limit(n)


def texts_of(docs: DataFrame, picked: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key was picked; ``picked`` is bounded by its limit, so it is broadcast."""
    rows = docs.select(F.col(key).alias("_k"), whole_text().alias("text"))
    return rows.join(F.broadcast(picked.withColumnRenamed(key, "_k")), "_k").withColumnRenamed("_k", key)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of ``edges(u, v)``.

    Alternating large-star and small-star rounds: every node hooks its larger, then its smaller
    neighbours to the smallest one it sees. Rounds grow with the logarithm of the path length; each
    is written to the shared folder. Roots themselves are not listed.
    """
    def with_min(e: DataFrame) -> DataFrame:
        # Written first, so that the planner can split a hub when it joins.
        low = keep(e.groupBy("u").agg(F.min("v").alias("m")))
        return e.join(low.select("u", F.least("u", "m").alias("m")), "u")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = keep(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = keep(with_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = with_min(large)
        small = low.select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        e = keep(small.filter("u <> v").distinct())
        now = state(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
