"""Progress of operations: monotonic percent, as a stream and as its batch twin."""
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def progress_fold(events: DataFrame) -> DataFrame:
    """Percent per operation of ``events(operation, pct, success, ts)``.

    Reports never go back and stop at 99 until the operation succeeds. Works on a batch and, with
    ``progress_stream``, on a stream: a partial aggregate, so a busy operation is no hot spot.
    """
    return events.groupBy("operation").agg(F.expr(
        "CASE WHEN bool_or(success) THEN 100 ELSE max(greatest(0, least(pct, 99))) END").alias("percent"))


class Fold(StatefulProcessor):
    """Best percent of one operation, kept until it has been silent for ``idle_ms`` of event time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle):
        self.handle = handle
        self.best = handle.getValueState("best", "percent int")

    def handleInputRows(self, key, rows, timers):
        best = self.best.get()[0] if self.best.exists() else 0
        last = timers.getCurrentWatermarkInMs() + 1
        for frame in rows:
            best = max(best, int(frame["percent"].max()))
            last = max(last, int(frame["last_ms"].max()))
        self.best.update((best,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame({"operation": [key[0]], "percent": pd.Series([best], dtype="int32")})

    def handleExpiredTimer(self, key, timers, expired):
        self.best.clear()
        return iter(())

    def close(self):
        pass


def progress_stream(events: DataFrame, lateness: str = "10 minutes", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """Streaming fold in update mode: one state and one timer per operation.

    An operation keeps its percent however long it runs; a restarted query goes on from its checkpoint.
    """
    seen = events.withWatermark("ts", lateness).withColumn(
        "percent", F.expr("CASE WHEN success THEN 100 ELSE greatest(0, least(pct, 99)) END").cast("int")).withColumn("last_ms", F.unix_millis("ts"))
    kind = events.schema["operation"].dataType.simpleString()
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)     # the only store with timers
    return seen.groupBy("operation").transformWithStateInPandas(Fold(idle_ms), f"operation {kind}, percent int", "Update", "EventTime")


def progress_history(events: DataFrame) -> DataFrame:
    """Reports that change the percent of an operation, in time order.

    The running maximum is taken inside a minute and over the maxima of earlier minutes, so the
    events of one busy operation are spread over its minutes.
    """
    rows = events.withColumn("minute", F.date_trunc("minute", "ts")).withColumn("pct", F.expr("greatest(0, least(pct, 99))"))
    peaks = rows.groupBy("operation", "minute").agg(F.max("pct").alias("peak"))
    earlier = W.partitionBy("operation").orderBy("minute").rowsBetween(W.unboundedPreceding, -1)
    peaks = peaks.select("operation", "minute", F.max("peak").over(earlier).alias("before"))
    inside = W.partitionBy("operation", "minute").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.max("pct").over(inside)).join(peaks, ["operation", "minute"])
    top = F.greatest(F.coalesce("before", F.lit(-1)), F.coalesce("inside", F.lit(-1)))
    return rows.filter(F.col("pct") > top).select("operation", "event_id", F.col("pct").alias("percent"))
