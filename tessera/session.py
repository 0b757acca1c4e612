"""Session helpers shared by all operators: runtime settings, co-partitioning, lineage cuts."""
import uuid

from pyspark.sql import DataFrame, SparkSession


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime options the plans rely on; cluster sizing stays with the caller."""
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # Per-document pipelines are hashed once on doc_id; joins and groupings on doc_id plus
    # further columns then reuse that layout instead of shuffling again.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # A Python worker holds a batch of texts and what it makes of them; several workers share an executor's memory.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
    return spark


def by_document(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hash raw document rows on their key before they are exploded.

    Everything explode produces stays in place, so later windows, groupings and joins of one
    document need no further exchange. A document is one row, so its rows are bounded by the
    size of one string cell. The number of partitions is left to the session and its adaptive plans.
    """
    return df.repartition(key)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder of the session; a local run without one uses its warehouse."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-shared")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/tessera-shared"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write a wide table to the shared folder and read it again.

    Unlike a checkpoint it is compressed, and every reader takes only the columns it needs.
    """
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss and freezes row placement."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
