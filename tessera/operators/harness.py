"""Evaluation harness: run results, determinism, expectations, provenance, baselines, lab logs."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import strip_tags


def lab_summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("files_attempted"), F.expr("count_if(exit_code <> 0)").alias("command_failures"),
                       F.expr("count_if(coalesce(output_sha256, '') <> '')").alias("outputs_produced"))


def arm_pivot(runs: DataFrame, arms: list[str]) -> DataFrame:
    """Seconds and success per fixture, arms side by side; the arms are given, so no scan for them."""
    return runs.groupBy("fixture").pivot("arm", arms).agg(
        F.round(F.min("duration_seconds"), 4).alias("seconds"), F.every("success").alias("ok"))


def determinism_check(first: DataFrame, second: DataFrame) -> DataFrame:
    """Hash equality of two runs of ``(id, markdown)``."""
    side = lambda df, n: df.select("id", F.sha2(F.encode("markdown", "UTF-8"), 256).alias(f"{n}_sha256"),
                                   F.octet_length("markdown").cast("bigint").alias(f"{n}_bytes"))
    rows = side(first, "run1").join(side(second, "run2"), "id")
    return rows.select("id", (F.col("run1_sha256") == F.col("run2_sha256")).alias("is_identical"),
                       F.col("run1_bytes").alias("bytes"), "run1_sha256", "run2_sha256")


def expectation_gate(runs: DataFrame, expectations: DataFrame) -> DataFrame:
    """Unmet expectations of ``runs(fixture, arm, success, error, char_count)``."""
    rows = runs.join(expectations, "fixture", "left")
    reason = F.expr("""CASE WHEN coalesce(must_fail, false) THEN CASE WHEN success THEN 'Expected to fail, but succeeded' END
        WHEN NOT success THEN coalesce(error, 'failed') WHEN char_count = 0 AND NOT coalesce(may_be_empty, false) THEN 'Zero characters extracted' END""")
    return rows.withColumn("reason", reason).filter("reason is not null").select("fixture", "arm", "reason")


def provenance_check(documents: DataFrame) -> DataFrame:
    """Texts with a page number and a full bounding box, from ``(id, texts ARRAY<STRUCT<prov>>)``."""
    rows = documents.select("id", F.explode_outer("texts").alias("t")).select("id", F.explode_outer("t.prov").alias("p"))
    full = "p.page_no IS NOT NULL AND p.bbox.l IS NOT NULL AND p.bbox.t IS NOT NULL AND p.bbox.r IS NOT NULL AND p.bbox.b IS NOT NULL"
    return rows.groupBy("id").agg(F.expr(f"count_if({full})").alias("valid_count")).withColumn("has_boxes", F.col("valid_count") > 0)


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))).cast("bigint")


def direct_extract(pages: DataFrame) -> DataFrame:
    """Plain-text arm of ``pages(id, html)`` with character and line counts."""
    rows = pages.select("id", strip_tags(F.col("html")).alias("text"))
    return rows.select("id", "text", F.length("text").cast("bigint").alias("char_count"), line_count(F.col("text")).alias("line_count"))


def sheet_text(cells: DataFrame) -> DataFrame:
    """Rows joined by `` | `` under a heading per sheet, from ``cells(workbook, sheet, row, col, value)``."""
    ordered = lambda key, value, sep: F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(key, value))), lambda s: s[value]), sep)
    rows = cells.withColumn("value", F.coalesce("value", F.lit(""))).groupBy("workbook", "sheet", "row").agg(
        ordered("col", "value", " | ").alias("line")).filter(F.trim("line") != "")
    sheets = rows.groupBy("workbook", "sheet").agg(ordered("row", "line", "\n").alias("body")).withColumn(
        "block", F.concat(F.lit("### Sheet: "), "sheet", F.lit("\n"), "body"))
    return sheets.groupBy("workbook").agg(ordered("sheet", "block", "\n\n").alias("text"))


def sheet_inventory(sheets: DataFrame, cells: DataFrame) -> DataFrame:
    """Sheets with visibility and emptiness; a sheet is empty when no cell holds a value."""
    filled = cells.groupBy("workbook", "sheet").agg(F.expr("count_if(coalesce(value, '') <> '')").alias("n"))
    visibility = F.when(F.col("visible") == -1, "visible").when(F.col("visible") == 2, "veryHidden").otherwise("hidden")
    return sheets.join(filled, ["workbook", "sheet"], "left").select(
        "workbook", "sheet", visibility.alias("visibility"), (F.coalesce("n", F.lit(0)) == 0).alias("is_empty"))
