"""Requests in, one response row per request: text conversion as a stream."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import unix_newlines

REQUEST = "id string, text string, sourceFormat string, _corrupt string"


def convert_requests(lines: DataFrame) -> DataFrame:
    """Responses to JSON request lines ``lines(value)``; a malformed line answers invalid_request."""
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json("value", REQUEST, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("r.*")
    bad = F.col("_corrupt").isNotNull() | F.col("id").isNull()
    code = (F.when(bad, "invalid_request").when(F.lower("sourceFormat") != "txt", "unsupported_format")
            .when(F.col("text").isNull(), "read_error"))
    rows = parsed.withColumn("error_code", code)
    return rows.select(F.when(bad, "unknown").otherwise(F.col("id")).alias("id"), F.col("error_code").isNull().alias("success"),
                       "error_code", F.when(F.col("error_code").isNull(), unix_newlines(F.col("text"))).alias("markdown"))


def convert_stream(spark: SparkSession, inbox: str, outbox: str, checkpoint: str):
    """Convert request files as they arrive: one answer for every line, whatever batch it comes in.

    A batch overwrites its own folder, so one that is repeated after a failure leaves no copies.
    """
    def answer(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{outbox}/batch={number}")

    requests = spark.readStream.text(inbox)
    return convert_requests(requests).writeStream.foreachBatch(answer).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
