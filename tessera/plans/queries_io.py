"""Queries on readers, sinks and streams: rows of the given tables are written to the shared folder and read back."""
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import files as src
from ..sources import sinks
from ..streaming.convert import convert_stream
from . import views
from .oracle import query, unix
from .queries_files import _EVIDENCE, _runs
from .queries_harness import _CELLS, cells
from .registry import register

# Documents per written file: arrays in one file stay small whatever the table's size.
FILE_ROWS = 100


def _arrays(rows, key, record, path, wrap=lambda a: a):
    """JSON files of at most FILE_ROWS records each."""
    listed = rows.groupBy(F.floor(F.col(key) / FILE_ROWS).alias("_file")).agg(F.sort_array(F.collect_list(record)).alias("a"))
    listed.select(F.to_json(wrap(F.col("a"))).alias("value")).write.option("maxRecordsPerFile", 1).text(path)


@register("read_run_results", """SELECT CASE WHEN doc_id % 2 = 0 THEN 'direct' ELSE 'heavy' END AS arm, 'F' || doc_id AS fixture, n_chars / 8.0::DOUBLE AS duration_seconds, doc_id % 7 <> 3 AS success,
  CASE WHEN doc_id % 7 = 3 THEN 'failed "' || lang || '"' END AS error, n_chars AS char_count, doc_id % 5 AS num_pages FROM documents""")
def _(spark, sf_dir):
    path = scratch(spark)
    record = F.expr("""named_struct('arm', CASE WHEN doc_id % 2 = 0 THEN 'direct' ELSE 'heavy' END, 'fixture', concat('F', doc_id), 'duration_seconds', n_chars / 8.0D, 'success', doc_id % 7 <> 3,
      'error', CASE WHEN doc_id % 7 = 3 THEN concat('failed "', lang, '"') END, 'char_count', n_chars, 'provenance', named_struct('num_pages', doc_id % 5))""")
    _arrays(views.table(spark, sf_dir, "documents"), "doc_id", record, path)
    got = src.read_run_results(spark, path)
    return got.select("arm", "fixture", "duration_seconds", "success", "error", "char_count", F.col("provenance.num_pages").alias("num_pages"))


@register("read_lab_results", """SELECT source || '/' || doc_id AS input, lang AS extension, (doc_id % 3)::INT AS exit_code, CASE WHEN doc_id % 3 = 0 THEN sha256(text) END AS output_sha256, n_chars AS duration_ms FROM documents""")
def _(spark, sf_dir):
    path = scratch(spark)
    rows = views.table(spark, sf_dir, "documents").selectExpr(
        "concat(source, '/', doc_id) AS input", "lang AS extension", "doc_id % 3 AS exit_code", "CASE WHEN doc_id % 3 = 0 THEN sha2(encode(text, 'UTF-8'), 256) END AS output_sha256",
        "CAST(NULL AS STRING) AS report_sha256", "n_chars AS duration_ms")
    rows.write.option("sep", "\t").option("header", "true").csv(path)
    return src.read_lab_results(spark, path).drop("report_sha256")


@register("read_manifest", f"""SELECT 'profile-' || (doc_id // {FILE_ROWS}) AS profile_id, source || '/' || doc_id || '.txt' AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes FROM documents""")
def _(spark, sf_dir):
    path = scratch(spark)
    rows = views.table(spark, sf_dir, "documents")
    record = F.expr("named_struct('path', concat(source, '/', doc_id, '.txt'), 'sha256', sha2(encode(text, 'UTF-8'), 256), 'sizeBytes', octet_length(text))")
    _arrays(rows, "doc_id", record, path, lambda a: F.struct(F.concat(F.lit("profile-"), F.col("_file")).alias("profileId"), a.alias("files")))
    return src.read_manifest(spark, path)


@register("write_sheet_delimited", f"""SELECT workbook, sheet, string_agg(CASE WHEN regexp_matches(v, '[,"\\r\\n]') THEN '"' || replace(v, '"', '""') || '"' ELSE v END, ',' ORDER BY col) AS line FROM (
  SELECT g.workbook, g.sheet, g.row, g.col, coalesce(regexp_replace(c.value, '[\\r\\n]', ' ', 'g'), '') AS v FROM (
    SELECT workbook, sheet, row, unnest(range(last_col + 1)) AS col FROM (SELECT workbook, sheet, last_col, unnest(range(last_row + 1)) AS row
      FROM (SELECT workbook, sheet, max(col) AS last_col, max(row) AS last_row FROM ({_CELLS}) GROUP BY ALL))) g
  LEFT JOIN ({_CELLS}) c ON c.workbook = g.workbook AND c.sheet = g.sheet AND c.row = g.row AND c.col = g.col) GROUP BY workbook, sheet, row""")
def _(spark, sf_dir):
    """Lines of the written files; a value with a line break would span lines, so breaks are spaces here."""
    path = scratch(spark)
    sinks.write_sheet_delimited(cells(spark, sf_dir).withColumn("value", F.regexp_replace("value", "[\r\n]", " ")), path)
    back = spark.read.schema("value string, workbook bigint, sheet string").text(path)
    return back.select("workbook", "sheet", F.col("value").alias("line"))


@register("write_report_json", """SELECT doc_id, lang AS source_format, CASE WHEN n_chars % 3 = 0 THEN 'Failed' ELSE 'Succeeded' END AS status, 'primary:' || source || '/' || doc_id AS artifact,
  (SELECT count(*) FROM documents WHERE n_chars % 3 = 0) AS errors FROM documents""")
def _(spark, sf_dir):
    """One nested report of all documents, read back line by line."""
    path = scratch(spark)
    items = views.table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "lang AS source_format", "CASE WHEN n_chars % 3 = 0 THEN 'Failed' ELSE 'Succeeded' END AS status", "array(named_struct('kind', 'primary', 'relativePath', concat(source, '/', doc_id))) AS artifacts")
    counts = items.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "Failed").alias("failed"))
    errors = items.filter("status = 'Failed'").select(F.col("doc_id").cast("string").alias("relative_path"), F.lit("No access to this folder.").alias("message"))
    sinks.write_report_json(spark.createDataFrame([("1.0",)], "schema_version string"), counts, errors, items, path)
    rows = sinks.read_report_items(spark, path, "docId bigint, sourceFormat string, status string, artifacts array<struct<kind:string,relativePath:string>>")
    failed = sinks.read_report_items(spark, path, "message string").agg(F.count("*").alias("errors"), F.lit(1).alias("_one"))
    joined = rows.withColumn("_one", F.lit(1)).join(F.broadcast(failed), "_one")
    return joined.select(F.col("docId").alias("doc_id"), F.col("sourceFormat").alias("source_format"), "status",
                         F.concat_ws(":", F.col("artifacts")[0]["kind"], F.col("artifacts")[0]["relativePath"]).alias("artifact"), "errors")


@register("write_run_registry", query("hashed", f"SELECT relative_path, evidence_key FROM ({_EVIDENCE})"))
def _(spark, sf_dir):
    """Two appends, the second of all runs: each is held once."""
    path, runs = scratch(spark), _runs(spark, sf_dir)
    sinks.append_run_registry(runs.filter("n % 2 = 0"), runs.limit(0), path)
    sinks.append_run_registry(runs, spark.read.parquet(path), path)
    return spark.read.parquet(path).select("relative_path", "evidence_key")


@register("convert_stream", f"""SELECT CASE WHEN doc_id % 7 = 6 THEN 'unknown' ELSE doc_id::VARCHAR END AS id, doc_id % 7 NOT IN (5, 6) AS success,
  CASE WHEN doc_id % 7 = 6 THEN 'invalid_request' WHEN doc_id % 7 = 5 THEN 'unsupported_format' END AS error_code, CASE WHEN doc_id % 7 NOT IN (5, 6) THEN {unix('text')} END AS markdown FROM documents""")
def _(spark, sf_dir):
    """Every document as a request line, some of them broken, through the stream."""
    path = scratch(spark)
    line = F.expr("to_json(named_struct('id', CAST(doc_id AS STRING), 'text', text, 'sourceFormat', CASE WHEN doc_id % 7 = 5 THEN 'pdf' ELSE 'txt' END))")
    requests = views.table(spark, sf_dir, "documents").select(F.when(F.expr("doc_id % 7 = 6"), F.concat(F.lit("x"), line)).otherwise(line).alias("value"))
    requests.write.text(f"{path}/in")
    convert_stream(spark, f"{path}/in", f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select("id", "success", "error_code", "markdown")
