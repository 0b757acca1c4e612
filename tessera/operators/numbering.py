"""Positions inside a group and in a total order, without pulling a group into one task."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage

CHUNK = 1 << 16


def number_in_group(df: DataFrame, keys: list[str], order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """0-based position by an integer ``order`` inside ``keys``.

    A group is cut into ranges of the order column, so one hot key is spread over many tasks;
    only the range sizes are scanned per key. The offset table is empty unless a group spans
    several ranges, and the adaptive planner then drops the join.
    """
    spread = df.withColumn("_range", F.floor(F.col(order) / chunk))
    position = F.row_number().over(W.partitionBy(*keys, "_range").orderBy(order)) - 1
    sizes = spread.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", before).filter("_before > 0").drop("_n")
    return (spread.withColumn("_position", position)
            .join(offsets, [*keys, "_range"], "left")
            .withColumn(name, (F.col("_position") + F.coalesce("_before", F.lit(0))).cast("bigint"))
            .drop("_range", "_position", "_before"))


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """1-based position in a total order.

    Rows are range-partitioned and sorted; the placement is frozen by a checkpoint, then each
    partition adds the row count of the partitions before it (one row per partition).
    """
    placed = cut_lineage(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))
    local = F.col("_place").bitwiseAND((1 << 33) - 1)
    return (placed.withColumn("_part", part).join(offsets, "_part")
            .withColumn(name, (F.col("_before") + local + 1).cast("bigint"))
            .drop("_place", "_part", "_before"))


def running_total(df: DataFrame, order: list[Column], weight: str, name: str) -> DataFrame:
    """Sum of ``weight`` up to and with each row in a total order.

    Rows are range-partitioned and sorted as in ``number_rows``; each range adds the total of the ranges
    before it (one row per partition).
    """
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    sums = placed.groupBy("_part").agg(F.sum(weight).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sums.select("_part", before.alias("_before")))
    local = F.sum(weight).over(W.partitionBy("_part").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn("_local", local).join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_local")).drop("_place", "_part", "_before", "_local")
