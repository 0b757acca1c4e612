"""Batch results: items, counters, verdicts, previews, evidence and acceptance."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from ..plans.dims import STATUS_RANK, dim
from .inventory import detect_format, extension_of, with_capability
from .numbering import number_rows

UNAVAILABLE = ["EngineUnavailable", "Unsupported"]


def count(condition: str, name: str) -> Column:
    return F.expr(f"count_if({condition})").alias(name)


def status_counts(prefix: str, names: dict[str, str]) -> list[Column]:
    return [count(f"{prefix}status = '{s}'", n) for s, n in names.items()]


def supports_markdown(files: DataFrame) -> DataFrame:
    return with_capability(files).withColumn("markdown", F.array_contains("allowed", "Markdown"))


def results_to_items(files: DataFrame, results: DataFrame) -> DataFrame:
    """Report items: files joined to their result by path without case, in order of precedence.

    ``files`` carry ``sha256_before`` and ``sha256_after``; ``results(relative_path, status, error_code, target_path)``.
    """
    r = results.select(F.lower("relative_path").alias("_key"), F.col("status").alias("r_status"), "error_code", "target_path")
    rows = supports_markdown(detect_format(files)).join(r, F.lower("relative_path") == F.col("_key"), "left")
    blocked = [("sha256_before IS NULL", "NotProcessed", "source_hash_failed"),
               ("NOT markdown AND format = 'Html'", "Unsupported", "html_markdown_unsupported"),
               ("NOT markdown", "Unsupported", "markdown_mapping_unsupported"),
               ("r_status IS NULL", "NotProcessed", "missing_conversion_result")]
    case = lambda i, last: "CASE " + " ".join(f"WHEN {b[0]} THEN '{b[i]}'" for b in blocked) + f" ELSE {last} END"
    return rows.select(
        "relative_path", "format", F.expr(case(1, "r_status")).alias("status"), F.expr(case(2, "error_code")).alias("diagnostic_code"),
        F.expr("CASE WHEN sha256_before IS NOT NULL AND markdown THEN target_path END").alias("result_path"),
        "size_bytes", "sha256_before", "sha256_after")


def integrity_verdict(items: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Source PASS/FAIL/UNKNOWN by hashes, artifacts PASS/FAIL/NOT_APPLICABLE."""
    a = artifacts.groupBy("relative_path").agg(F.count("*").alias("n"), F.expr("count_if(sha256 IS NULL)").alias("unhashed"))
    rows = items.join(a, "relative_path", "left").na.fill(0, ["n", "unhashed"])
    return rows.select(
        *items.columns,
        F.expr("""CASE WHEN sha256_before IS NULL OR sha256_after IS NULL THEN 'UNKNOWN'
                       WHEN sha256_before = sha256_after THEN 'PASS' ELSE 'FAIL' END""").alias("source_integrity"),
        F.expr("""CASE WHEN status = 'Succeeded' THEN CASE WHEN n > 0 AND unhashed = 0 THEN 'PASS' ELSE 'FAIL' END
                       WHEN unhashed > 0 THEN 'FAIL' ELSE 'NOT_APPLICABLE' END""").alias("artifact_integrity"))


def batch_counts(items: DataFrame) -> DataFrame:
    names = {"Succeeded": "succeeded", "Unsupported": "unsupported", "EngineUnavailable": "engine_unavailable", "Failed": "failed",
             "Conflict": "conflict", "Skipped": "skipped", "Cancelled": "cancelled", "NotProcessed": "not_processed"}
    return items.agg(F.count("*").alias("total"), *status_counts("", names))


def batch_verdict(items: DataFrame, errors: DataFrame) -> DataFrame:
    """COMPLETED only when something was scanned, without errors, issues or broken integrity."""
    n_errors = errors.agg(F.count("*").alias("n_errors"))
    issues = items.agg(F.count("*").alias("n_items"), count(
        "status IN ('Unsupported', 'EngineUnavailable', 'Failed', 'Conflict', 'NotProcessed')"
        " OR source_integrity <> 'PASS' OR artifact_integrity = 'FAIL'", "n_issues"))
    both = issues.select("*", F.lit(1).alias("k")).join(n_errors.select("*", F.lit(1).alias("k")), "k")
    return both.select("n_items", "n_issues", "n_errors", F.expr(
        "CASE WHEN n_items = 0 OR n_issues > 0 OR n_errors > 0 THEN 'COMPLETED_WITH_ISSUES' ELSE 'COMPLETED' END").alias("final_state"))


def summary_counts(results: DataFrame) -> DataFrame:
    return results.agg(*status_counts("", {"Succeeded": "succeeded", "Conflict": "conflicts", "Failed": "failed", "Skipped": "skipped",
                                           "EngineUnavailable": "engine_unavailable", "Unsupported": "unsupported"}))


def preview_summary(ops: DataFrame) -> DataFrame:
    return ops.agg(F.countDistinct(F.lower("source_path")).alias("found"),
                   count("status IN ('Ready', 'Converting', 'Cancelled', 'NotProcessed')", "ready"),
                   count("status = 'Skipped'", "skipped"), count("status IN ('EngineUnavailable', 'Unsupported')", "unavailable"),
                   count("status = 'Conflict'", "conflict"), count("status = 'Failed'", "error"))


def final_counters(results: DataFrame, ops: DataFrame) -> DataFrame:
    """Counters over processed results and the operations that were never run."""
    key = F.lower("relative_path").alias("key")
    done = results.select(key, "status", "target", F.lit(True).alias("processed"))
    idle = ops.select(key, "status", "target", F.lit(False).alias("processed")).join(done.select("key"), "key", "left_anti")
    return done.unionByName(idle).agg(
        count("processed AND status = 'Succeeded' AND target <> 'Copy'", "converted"),
        count("processed AND status = 'Succeeded' AND target = 'Copy'", "copied"), count("status = 'Failed'", "failed"),
        count("status = 'Conflict'", "conflicts"), count("status IN ('EngineUnavailable', 'Unsupported')", "unavailable"),
        count("status = 'Skipped'", "skipped"), count("NOT processed AND status = 'Ready'", "not_selected"))


def worksheet_summary(ops: DataFrame) -> DataFrame:
    """Sheet counters per workbook and in total, by one pass over grouping sets."""
    selected = "status IN ('Succeeded', 'Failed', 'Cancelled', 'NotProcessed')"
    return ops.groupingSets([["relative_path"], []], "relative_path").agg(
        F.grouping("relative_path").cast("int").alias("is_total"), F.count("sheet_name").alias("sheets"), count(selected, "selected"),
        count("target = 'Csv' AND status = 'Succeeded'", "csv_exported"), count("target = 'Tsv' AND status = 'Succeeded'", "tsv_exported"),
        count(f"visibility <> 'visible' AND NOT ({selected})", "hidden_skipped"),
        count("message = 'worksheet_empty'", "empty"), count("status = 'Failed'", "failed"))


def format_counts(files: DataFrame) -> DataFrame:
    counts = detect_format(files).groupBy("format").agg(F.count("*").alias("n"))
    return counts.join(dim(files.sparkSession, "capabilities").select("format", "ordinal"), "format").orderBy("ordinal")


def extension_breakdown(files: DataFrame) -> DataFrame:
    """``(label, n)`` of each extension; whatever follows a last dot is one, so they stay rows."""
    ext = F.regexp_replace(extension_of(F.col("relative_path")), r"^\.", "")
    label = F.when(is_blank(ext), F.lit("No extension")).otherwise(F.upper(ext))
    return files.groupBy(label.alias("label")).agg(F.count("*").alias("n"))


def preview_filter(ops: DataFrame, which: str, format: str = None) -> DataFrame:
    statuses = {"convert": ["Ready", "Converting", "Succeeded", "Cancelled", "NotProcessed"], "skip": ["Skipped"],
                "unavailable": UNAVAILABLE, "conflicts": ["Conflict"], "errors": ["Failed"]}
    if which == "all":
        return ops
    return ops.filter(F.col("format") == format) if which == "format" else ops.filter(F.col("status").isin(statuses[which]))


def status_rank(status: Column) -> Column:
    rank = F.lit(99)
    for i, s in enumerate(STATUS_RANK + [None, "NotProcessed"], 1):
        rank = rank if s is None else F.when(status == s, i).otherwise(rank)
    return rank


def preview_order(column: str, descending: bool) -> list[Column]:
    """Sort keys of a preview column with its tie-breakers; a missing time is last both ways."""
    key = {"file": F.lower("relative_path"), "action": F.lower(F.concat("target", F.lit(":"), "format")),
           "status": status_rank(F.col("status")), "result": F.lower("target_path"), "size": F.col("size_bytes"),
           "time": F.col("elapsed_ms")}[column]
    tie = [F.lower("relative_path"), F.col("relative_path")]
    if descending:
        return [key.desc_nulls_last(), *[t.desc() for t in tie]]
    return [key.asc_nulls_last(), *[t.asc() for t in tie]]


def preview_sort(ops: DataFrame, column: str, descending: bool = False) -> DataFrame:
    return number_rows(ops, preview_order(column, descending), "position")


def dedupe_by_hash(files: DataFrame) -> DataFrame:
    """Byte-identical copies counted once; the first path represents them. No window, one grouping."""
    return files.groupBy("content_sha256").agg(F.min("relative_path").alias("representative"), F.count("*").alias("copies"))


def sets_equal(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    side = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(1))
    both = side(left, "l").join(side(right, "r"), key, "full_outer")
    return both.agg(F.expr("count_if(r IS NULL)").alias("only_left"), F.expr("count_if(l IS NULL)").alias("only_right"),
                    F.expr("count_if(l IS NULL OR r IS NULL) = 0").alias("is_equal"))


def verify_artifacts(manifest: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per artifact, per run): PASS, MISMATCH, MISSING or INVALID_PATH against a manifest."""
    a = actual.select("run_id", "path", F.col("sha256").alias("actual_sha256"), F.col("size_bytes").alias("actual_size"))
    rows = manifest.join(a, ["run_id", "path"], "left")
    # Folders are walked with both separators: a path may step out of a folder it has entered, not of the run.
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out"))

    def step(state, part):
        depth = state["depth"] + F.when(part == "..", -1).when(part.isin("", "."), 0).otherwise(1)
        return F.struct(depth.alias("depth"), (state["out"] | (depth < 0)).alias("out"))

    walked = F.aggregate(F.split("path", r"[/\\]"), start, step)
    escapes = F.col("path").rlike(r"^(/|\\|[A-Za-z]:)") | walked["out"]
    status = (F.when(escapes, "INVALID_PATH").when(F.col("actual_sha256").isNull(), "MISSING")
              .when((F.col("actual_size") == F.col("size_bytes")) & (F.lower("actual_sha256") == F.lower("sha256")), "PASS")
              .otherwise("MISMATCH"))
    rows = rows.select("run_id", "path", status.alias("status"))
    return rows, rows.groupBy("run_id").agg(F.expr("CASE WHEN every(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END").alias("verdict"),
                                            F.count("*").alias("artifacts"), F.expr("count_if(status <> 'PASS')").alias("problems"))


def acceptance_join(fixtures: DataFrame, items: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Each fixture must have exactly one item and that item one matching primary artifact."""
    norm = lambda c: F.lower(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^/+", ""))
    i = items.select(norm(F.col("relative_path")).alias("key"), "status", norm(F.col("result_path")).alias("result_key"))
    i = i.groupBy("key").agg(F.count("*").alias("n_items"), F.first("status").alias("status"), F.first("result_key").alias("result_key"))
    p = artifacts.filter("kind = 'primary'").groupBy(norm(F.col("path")).alias("result_key")).agg(
        F.count("*").alias("n_primary"), F.first("sha256").alias("output_sha256"), F.first("size_bytes").alias("output_size"))
    rows = fixtures.withColumn("key", norm(F.col("relative_path"))).join(i, "key", "left").join(p, "result_key", "left")
    one = F.coalesce("n_items", F.lit(0)) == 1
    has = F.coalesce("n_primary", F.lit(0)) == 1
    reasons = F.array_compact(F.array(
        F.when(~one, "expected exactly one report item"),
        F.when(one & (F.col("status") != "Succeeded"), F.concat(F.lit("status is "), "status")),
        F.when(one & F.col("result_key").isNull(), "no primary artifact for source"),
        F.when(one & F.col("result_key").isNotNull() & ~has, "expected exactly one primary artifact"),
        F.when(has & (F.col("output_size") == 0), "empty output"),
        F.when(has & (F.col("format") != "Txt") & (F.col("output_sha256") == F.col("content_sha256")), "output is identical to source")))
    return rows.select("relative_path", F.array_join(reasons, "; ").alias("reasons"),
                       F.when(F.size(reasons) == 0, "PASS").otherwise("FAIL").alias("verdict"))


def evidence_keys(runs: DataFrame) -> DataFrame:
    """Key of a run: hash over the canonical JSON of everything that identifies it."""
    key = F.sha2(F.to_json(F.struct("schema_version", "source_sha256", "markdown_sha256", "corpus", "engine", "pipeline")), 256)
    return runs.withColumn("evidence_key", key).withColumn("run_id", F.concat(F.lit("run-"), F.left(key, F.lit(12))))


def new_runs(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Runs the registry does not hold yet; the registry is only ever appended to."""
    return runs.join(registry.select("evidence_key"), "evidence_key", "left_anti")
