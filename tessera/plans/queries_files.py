"""Queries on the inventory: scan, formats, rules, routes, paths, plans, worksheets, reports, evidence."""
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..operators import reports as rp
from ..operators.render import number_assets
from ..session import scratch
from ..sources.files import local_path, scan_folder
from . import dims, views
from .oracle import cte, lit, query, strings, values
from .registry import register
from .views import view

OVERRIDES = [("Ppt", "Markdown"), ("Xlsx", "Csv"), ("Odt", "Markdown"), ("Epub", "Skip")]
ROOT, OUT = views.ROOT, views.OUT

_ext = lambda x: f"regexp_extract({x}, '(\\.[^./\\\\]*)$', 1)"
cte("detected", "files dim_extensions", f"""
SELECT f.*, lower({_ext('relative_path')}) AS extension, coalesce(format, 'Unknown') AS format
FROM files f LEFT JOIN dim_extensions e ON lower({_ext('f.relative_path')}) = e.extension""")
cte("ruled", "detected dim_capabilities", f"""
SELECT *, CASE WHEN rule_ok THEN coalesce(override, default_target) ELSE default_target END AS target FROM (
  SELECT d.*, c.default_target, c.allowed, c.family, o.override, o.override IS NULL OR list_contains(c.allowed, o.override) AS rule_ok
  FROM detected d JOIN dim_capabilities c USING (format) LEFT JOIN ({values(OVERRIDES, 'format, override')}) o USING (format))""")
cte("routed", "ruled dim_routes dim_target_extensions", f"""
SELECT r.*, a.adapter, coalesce(a.adapter IN ({", ".join(map(lit, dims.AVAILABLE_ADAPTERS))}), false) AS adapter_available,
  CASE WHEN r.target = 'Copy' THEN {_ext('relative_path')} ELSE t.target_extension END AS target_extension,
  '{OUT}/' || regexp_replace(relative_path, '\\.[^./\\\\]*$', '') || CASE WHEN r.target = 'Copy' THEN {_ext('relative_path')} ELSE t.target_extension END AS full_target
FROM ruled r LEFT JOIN (SELECT format, target, arg_min(adapter, priority) AS adapter FROM dim_routes GROUP BY ALL) a USING (format, target)
LEFT JOIN dim_target_extensions t USING (target)""")
_safe = f"""(NOT regexp_matches(relative_path, '^(/|\\\\|[A-Za-z]:)') AND trim(relative_path) <> ''
  AND len(list_filter(regexp_split_to_array(relative_path, '[/\\\\]'), lambda p: p IN ('.', '..'))) = 0 AND lower(source_path) = lower('{ROOT}/' || relative_path))"""
cte("ops", "routed existing", f"""
SELECT source_path, relative_path, format, target, target_extension, CASE WHEN placed THEN full_target ELSE '' END AS target_path,
  placed AND adapter_available AS adapter_available, status, CASE status WHEN 'Skipped' THEN 'OperationSkipped' WHEN 'Unsupported' THEN 'OperationUnsupported'
    WHEN 'Failed' THEN 'OperationInvalidTarget' WHEN 'Conflict' THEN 'OperationTargetExists' WHEN 'EngineUnavailable' THEN 'OperationUnavailable'
    ELSE CASE WHEN target = 'Copy' THEN 'OperationReadyCopy' ELSE 'OperationReady' END END AS message, size_bytes
FROM (SELECT *, status NOT IN ('Skipped', 'Failed') AND list_contains(allowed, target) AS placed FROM (
  SELECT r.*, CASE WHEN target = 'Skip' THEN 'Skipped' WHEN NOT list_contains(allowed, target) THEN 'Unsupported' WHEN NOT {_safe} THEN 'Failed'
      WHEN e.k IS NOT NULL THEN 'Conflict' WHEN adapter IS NULL THEN 'Unsupported' WHEN NOT adapter_available THEN 'EngineUnavailable' ELSE 'Ready' END AS status
  FROM routed r LEFT JOIN (SELECT DISTINCT lower(target_path) AS k FROM existing) e ON lower(r.full_target) = e.k))""")
_hex = lambda a, b: f"('0x' || substr(content_sha256, {a}, {b}))::BIGINT"
_sp_hex = lambda a, b: f"CAST(conv(substring(content_sha256, {a}, {b}), 16, 10) AS BIGINT)"

# --- derived results: outcome, hashes and artifacts follow from the content hash of a file -------
RESULT_CASES = """CASE WHEN {n} % 7 = 0 THEN 'Failed' ELSE 'Succeeded' END"""
ERROR_CASES = """CASE WHEN {n} % 7 = 0 THEN CASE {n} % 3 WHEN 0 THEN 'malformed_document' WHEN 1 THEN 'output_empty' ELSE 'unlisted_code' END END"""
MESSAGE_CASES = """CASE WHEN {n} % 7 = 0 THEN CASE {n} % 4 WHEN 0 THEN 'Failed to read document contents.' WHEN 1 THEN 'IO_FAILURE' ELSE 'other' END ELSE 'done' END"""
cte("hashed", "files", f"""SELECT *, {_hex(1, 6)} AS n, CASE WHEN {_hex(7, 4)} % 31 <> 0 THEN content_sha256 END AS sha256_before,
  CASE WHEN {_hex(7, 4)} % 17 = 0 THEN sha256(content_sha256) ELSE content_sha256 END AS sha256_after FROM files""")
cte("results", "ops hashed", f"""
SELECT o.relative_path, o.target, {RESULT_CASES.format(n='n')} AS status, {ERROR_CASES.format(n='n')} AS error_code, {MESSAGE_CASES.format(n='n')} AS message,
  o.target_path, h.content_sha256, n FROM ops o JOIN hashed h USING (relative_path) WHERE o.status = 'Ready' AND n % 29 <> 0""")
cte("artifacts", "results", """
SELECT relative_path, 'primary' AS kind, target_path AS path, CASE WHEN n % 23 <> 0 THEN sha256('out' || content_sha256) END AS sha256, n % 1000 AS size_bytes FROM results WHERE status = 'Succeeded'
UNION ALL SELECT relative_path, 'companion', target_path || '_assets/image-001' || ['.png', '.JPG', '.svg', '.gif'][n % 4 + 1], sha256(content_sha256), n % 5000 FROM results WHERE status = 'Succeeded' AND n % 3 = 0""")
cte("items", "hashed detected dim_capabilities results", f"""
SELECT h.relative_path, d.format, CASE WHEN sha256_before IS NULL THEN 'NotProcessed' WHEN NOT md THEN 'Unsupported' WHEN r.status IS NULL THEN 'NotProcessed' ELSE r.status END AS status,
  CASE WHEN sha256_before IS NULL THEN 'source_hash_failed' WHEN NOT md AND d.format = 'Html' THEN 'html_markdown_unsupported' WHEN NOT md THEN 'markdown_mapping_unsupported'
       WHEN r.status IS NULL THEN 'missing_conversion_result' ELSE r.error_code END AS diagnostic_code,
  CASE WHEN sha256_before IS NOT NULL AND md THEN r.target_path END AS result_path, h.size_bytes, sha256_before, sha256_after
FROM hashed h JOIN detected d USING (relative_path) JOIN (SELECT format, list_contains(allowed, 'Markdown') AS md FROM dim_capabilities) c ON c.format = d.format
LEFT JOIN results r ON lower(r.relative_path) = lower(h.relative_path)""")
cte("judged", "items artifacts", """
SELECT i.*, CASE WHEN sha256_before IS NULL OR sha256_after IS NULL THEN 'UNKNOWN' WHEN sha256_before = sha256_after THEN 'PASS' ELSE 'FAIL' END AS source_integrity,
  CASE WHEN status = 'Succeeded' THEN CASE WHEN coalesce(n, 0) > 0 AND bad = 0 THEN 'PASS' ELSE 'FAIL' END WHEN coalesce(bad, 0) > 0 THEN 'FAIL' ELSE 'NOT_APPLICABLE' END AS artifact_integrity
FROM items i LEFT JOIN (SELECT relative_path, count(*) AS n, count(*) FILTER (sha256 IS NULL) AS bad FROM artifacts GROUP BY ALL) a USING (relative_path)""")


@view
def ops(spark, sf_dir) -> DataFrame:
    return inv.plan_operations(views.files(spark, sf_dir), views.existing_targets(spark, sf_dir), ROOT, OUT, OVERRIDES)


@view
def hashed(spark, sf_dir) -> DataFrame:
    f = views.files(spark, sf_dir)
    return f.select(
        "*", F.expr(_sp_hex(1, 6)).alias("n"), F.expr(f"CASE WHEN {_sp_hex(7, 4)} % 31 <> 0 THEN content_sha256 END").alias("sha256_before"),
        F.expr(f"CASE WHEN {_sp_hex(7, 4)} % 17 = 0 THEN sha2(content_sha256, 256) ELSE content_sha256 END").alias("sha256_after"))


@view
def results(spark, sf_dir) -> DataFrame:
    h = hashed(spark, sf_dir).select("relative_path", "content_sha256", "n")
    rows = ops(spark, sf_dir).filter("status = 'Ready'").drop("status", "message").join(h, "relative_path").filter("n % 29 <> 0")
    return rows.select("relative_path", "target", F.expr(RESULT_CASES.format(n="n")).alias("status"),
                       F.expr(ERROR_CASES.format(n="n")).alias("error_code"), F.expr(MESSAGE_CASES.format(n="n")).alias("message"),
                       "target_path", "content_sha256", "n")


@view
def artifacts(spark, sf_dir) -> DataFrame:
    r = results(spark, sf_dir).filter("status = 'Succeeded'")
    return r.select("relative_path", F.explode(F.expr("""filter(array(
        struct('primary' AS kind, target_path AS path, CASE WHEN n % 23 <> 0 THEN sha2(concat('out', content_sha256), 256) END AS sha256, n % 1000 AS size_bytes),
        struct(CASE WHEN n % 3 = 0 THEN 'companion' END AS kind,
               concat(target_path, '_assets/image-001', element_at(array('.png', '.JPG', '.svg', '.gif'), CAST(n % 4 + 1 AS INT))) AS path,
               sha2(content_sha256, 256) AS sha256, n % 5000 AS size_bytes)), x -> x.kind IS NOT NULL)""")).alias("a")).select("relative_path", "a.*")


@view
def items(spark, sf_dir) -> DataFrame:
    return rp.results_to_items(hashed(spark, sf_dir), results(spark, sf_dir))


@view
def judged(spark, sf_dir) -> DataFrame:
    return rp.integrity_verdict(items(spark, sf_dir), artifacts(spark, sf_dir))


def q(name, needs, sql):
    return register(name, query(needs, sql))


_TREE = "regexp_replace(relative_path, '^[.][.]/', '__/')"


def _write_tree(batches):
    for batch in batches:
        for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write((text or "").encode())
        yield batch.select(["path"])


@q("scan_inventory", "files", f"""SELECT t AS relative_path, size_bytes, 0::BIGINT AS n_errors FROM (SELECT *, {_TREE} AS t FROM files)
WHERE NOT starts_with(regexp_extract(t, '([^/]*)$', 1), '~$') AND NOT starts_with(lower(t), '_converted/') AND lower(t) <> 'web/p0.html'""")
def _(spark, sf_dir):
    """All documents and pages written as a tree of files, then scanned; no page is followed out of the tree."""
    root = scratch(spark)
    tree = views.named_files(spark, sf_dir).select(F.concat(F.lit(local_path(root) + "/"), F.expr(_TREE)).alias("path"), "text")
    tree.mapInArrow(_write_tree, "path string").write.format("noop").mode("overwrite").save()
    found, errors = scan_folder(spark, root, True, "_converted", "web/P0.html")
    n = errors.agg(F.count("*").alias("n_errors"), F.lit(1).alias("_one"))
    return found.withColumn("_one", F.lit(1)).join(F.broadcast(n), "_one").select("relative_path", "size_bytes", "n_errors")


@q("detect_format", "detected", "SELECT relative_path, format FROM detected")
def _(spark, sf_dir):
    return inv.detect_format(views.files(spark, sf_dir)).select("relative_path", "format")


@q("semantic_family", "ruled", "SELECT relative_path, family FROM ruled")
def _(spark, sf_dir):
    return inv.with_capability(inv.detect_format(views.files(spark, sf_dir))).select("relative_path", "family")


def _ruled(spark, sf_dir):
    return inv.apply_rules(inv.detect_format(views.files(spark, sf_dir)), OVERRIDES)


@q("apply_rules", "ruled", "SELECT relative_path, target, rule_ok FROM ruled")
def _(spark, sf_dir):
    return _ruled(spark, sf_dir).select("relative_path", "target", "rule_ok")


@q("required_application", "ruled dim_engines", "SELECT relative_path, engine FROM ruled LEFT JOIN dim_engines USING (format, target)")
def _(spark, sf_dir):
    return inv.required_application(_ruled(spark, sf_dir)).select("relative_path", "engine")


@q("safe_copy_predicate", "ruled", f"SELECT relative_path, target = 'Copy' AND format IN ({', '.join(map(lit, dims.SAFE_COPY_FORMATS))}) AS safe_copy FROM ruled")
def _(spark, sf_dir):
    return _ruled(spark, sf_dir).select("relative_path", inv.is_safe_copy(F.col("format"), F.col("target")).alias("safe_copy"))


@q("resolve_route", "routed", "SELECT relative_path, adapter, adapter_available FROM routed")
def _(spark, sf_dir):
    return inv.resolve_route(_ruled(spark, sf_dir)).select("relative_path", "adapter", "adapter_available")


@q("target_path", "routed", "SELECT relative_path, full_target AS target_path FROM routed")
def _(spark, sf_dir):
    return inv.with_target_path(_ruled(spark, sf_dir), OUT).select("relative_path", "target_path")


@q("path_is_safe", "files", f"SELECT relative_path, {_safe} AS safe FROM files")
def _(spark, sf_dir):
    return views.files(spark, sf_dir).select("relative_path", inv.path_is_safe(F.col("source_path"), F.col("relative_path"), ROOT).alias("safe"))


_SRC, _DST = "regexp_replace(source_path, '/[^/]*$', '')", "CASE WHEN size_bytes % 3 = 0 THEN '/Corpus/' WHEN size_bytes % 3 = 1 THEN upper(regexp_replace(source_path, '/[^/]*$', '')) || '/' ELSE '/out' END"


@q("destination_check", "files", f"""SELECT relative_path, CASE WHEN s = d THEN 'output_equals_source' WHEN starts_with(s, d || '/') THEN 'output_is_source_parent' ELSE 'ok' END AS code
FROM (SELECT relative_path, lower({_SRC}) AS s, lower(regexp_replace({_DST}, '/+$', '')) AS d FROM files)""")
def _(spark, sf_dir):
    f = views.files(spark, sf_dir)
    return f.select("relative_path", inv.destination_check(F.expr(_SRC), F.expr(_DST)).alias("code"))


@q("archive_entry_check", "files ops", """SELECT coalesce(e.key, a.key) AS key, CASE WHEN a.key IS NULL THEN 'missing' WHEN e.key IS NULL THEN 'unexpected' WHEN a.n > 1 THEN 'duplicate'
  WHEN coalesce(trim(a.name), '') = '' OR starts_with(a.name, '/') OR contains(a.name, ':') OR len(list_filter(string_split(a.name, '/'), lambda p: p IN ('.', '..'))) > 0 THEN 'unsafe' ELSE 'ok' END AS code
FROM (SELECT lower(relative_path) AS key FROM files GROUP BY 1) e FULL JOIN (SELECT lower(regexp_replace(target_path, '^/out/', '')) AS key, min(regexp_replace(target_path, '^/out/', '')) AS name, count(*) AS n FROM ops WHERE target_path <> '' GROUP BY 1) a ON a.key = e.key""")
def _(spark, sf_dir):
    actual = ops(spark, sf_dir).filter("target_path <> ''").select(F.regexp_replace("target_path", "^/out/", "").alias("name"))
    return inv.archive_entry_check(views.files(spark, sf_dir).select(F.col("relative_path").alias("name")), actual)


@q("redact_path", "files", """SELECT relative_path, CASE WHEN starts_with(p, '/') OR contains(p, ':') OR list_contains(string_split(p, '/'), '..') THEN '[redacted]' ELSE p END AS safe_path
FROM (SELECT relative_path, CASE size_bytes % 4 WHEN 0 THEN source_path WHEN 1 THEN 'C:' || relative_path ELSE replace(relative_path, '\\', '/') END AS p FROM files)""")
def _(spark, sf_dir):
    p = F.expr("CASE size_bytes % 4 WHEN 0 THEN source_path WHEN 1 THEN concat('C:', relative_path) ELSE replace(relative_path, '/', '\\\\') END")
    return views.files(spark, sf_dir).select("relative_path", inv.redact_path(p).alias("safe_path"))


def _dsan(x):
    safe = f"regexp_replace(regexp_replace({tx_trim(x)}, {lit(inv.INVALID_NAME_CHARS)}, '_', 'g'), '[ .]+$', '')"
    safe = f"CASE WHEN trim({safe}) = '' THEN 'Sheet' ELSE {safe} END"
    return f"(SELECT CASE WHEN upper(split_part(s, '.', 1)) IN ({', '.join(map(lit, dims.RESERVED_NAMES))}) THEN '_' || s ELSE s END FROM (SELECT {safe} AS s))"


def tx_trim(x):
    from .oracle import trim_ws
    return trim_ws(x)


_SHEET = "text || CASE turn % 5 WHEN 0 THEN ': a/b. ' WHEN 1 THEN '. ' ELSE '' END"
_SHEET_SP = "concat(text, CASE turn % 5 WHEN 0 THEN ': a/b. ' WHEN 1 THEN '. ' ELSE '' END)"
_RAW_SHEET = f"CASE turn % 11 WHEN 3 THEN 'con.' || turn WHEN 4 THEN ' . ' ELSE {_SHEET} END"
_RAW_SHEET_SP = f"CASE turn % 11 WHEN 3 THEN concat('con.', turn) WHEN 4 THEN ' . ' ELSE {_SHEET_SP} END"


@register("sanitize_sheet_name", f"SELECT conv_id, turn, {_dsan(_RAW_SHEET)} AS name FROM conversations")
def _(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", inv.sanitize_sheet_name(F.expr(_RAW_SHEET_SP)).alias("name"))


_cut = lambda v, n: f"regexp_replace(left({v}, {n}), '[ .]+$', '')"
_BOOK = "repeat(s, 6)"


@register("sheet_output_name", f"""SELECT conv_id, turn, {_cut('b', 'bb')} || '__' || {_cut('s', '194 - bb')} || '.csv' AS file_name FROM (
SELECT *, least(length(b), 194 - least(length(s), 97)) AS bb FROM (SELECT conv_id, turn, s, {_BOOK} AS b FROM (SELECT conv_id, turn, {_dsan(_RAW_SHEET)} AS s FROM conversations)))""")
def _(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    c = c.select("conv_id", "turn", inv.sanitize_sheet_name(F.expr(_RAW_SHEET_SP)).alias("s")).withColumn("b", F.repeat("s", F.lit(6)))
    return c.select("conv_id", "turn", inv.sheet_output_name(F.col("b"), F.col("s"), F.lit(".csv"), F.lit("")).alias("file_name"))


@q("plan_operations", "ops", "SELECT * FROM ops")
def _(spark, sf_dir):
    return ops(spark, sf_dir)


_SAFE_SHEETS = ["Summary", "Sales_2026", "_CON", "Trailing", "Données", "summary"]
cte("books", "files", f"""SELECT *, n % 11 = 0 AS failed, n % 13 = 0 AS uninspected, CASE WHEN n % 13 = 0 THEN 0 ELSE n % 4 END AS cnt, starts_with(relative_path, '../') AS unsafe,
  regexp_replace(relative_path, '\\.[^./]*$', '') AS stem FROM (SELECT relative_path, {_hex(1, 6)} AS n FROM files WHERE regexp_matches(lower(relative_path), '\\.xlsx?$'))""")
cte("sheet_ops", "books existing", f"""
SELECT relative_path, NULL AS sheet_name, 'Csv' AS target, '' AS target_path, 'Failed' AS status, CASE WHEN unsafe THEN 'OperationUnsafeSource' ELSE 'worksheet_inspection_failure' END AS message, NULL AS visibility, false AS default_selected, 0 AS sheet_index
  FROM books WHERE failed OR unsafe
UNION ALL SELECT relative_path, NULL, 'Csv', '', 'Skipped', 'worksheet_none', NULL, false, 0 FROM books WHERE NOT failed AND NOT unsafe AND NOT uninspected AND cnt = 0
UNION ALL SELECT relative_path, sheet_name, 'Csv', path, status, CASE status WHEN 'Conflict' THEN 'OperationTargetExists' WHEN 'Skipped' THEN 'worksheet_empty'
    ELSE CASE WHEN visibility <> 'visible' THEN 'worksheet_hidden' ELSE 'OperationReady' END END, visibility, status = 'Ready' AND coalesce(visibility, 'visible') = 'visible', sheet_index
FROM (SELECT s.*, CASE WHEN e.k IS NOT NULL THEN 'Conflict' WHEN is_empty THEN 'Skipped' ELSE 'Ready' END AS status FROM (
    SELECT relative_path, NULL AS sheet_name, '{OUT}/' || stem || '.csv' AS path, NULL AS visibility, false AS is_empty, 0 AS sheet_index FROM books WHERE NOT failed AND NOT unsafe AND uninspected
    UNION ALL SELECT relative_path, {strings(views.SHEET_NAMES)}[(n + i) % 6 + 1], '{OUT}/' || stem || '__' || safe || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END || '.csv',
      CASE WHEN (n + i) % 4 = 0 THEN CASE WHEN i % 2 = 0 THEN 'hidden' ELSE 'veryHidden' END ELSE 'visible' END, (n + i) % 5 = 0, i + 1
    FROM (SELECT *, row_number() OVER (PARTITION BY relative_path, lower(safe) ORDER BY i) AS rn FROM (SELECT *, {strings(_SAFE_SHEETS)}[(n + i) % 6 + 1] AS safe FROM (
      SELECT *, unnest(range(cnt)) AS i FROM books WHERE NOT failed AND NOT unsafe AND NOT uninspected)))) s
  LEFT JOIN (SELECT DISTINCT lower(target_path) AS k FROM existing) e ON lower(s.path) = e.k)""")


@q("plan_worksheets", "sheet_ops", "SELECT * EXCLUDE (sheet_index) FROM sheet_ops")
def _(spark, sf_dir):
    books = views.files(spark, sf_dir).join(views.worksheets(spark, sf_dir), "relative_path")
    return inv.plan_worksheets(books, views.existing_targets(spark, sf_dir), OUT).drop("sheet_index")


# Names are given out one claim after the other; only claims that can meet another one are walked.
cte("batch", "ops sheet_ops", f"""
SELECT *, regexp_replace(target_path, '\\.[^./]*$', '') AS stem, {_ext('target_path')} AS ext FROM (
  SELECT relative_path, target, target_path, status, message, adapter_available, NULL AS sheet_name, 0 AS sheet_index, format IN ('Xls', 'Xlsx') AND target IN ('Csv', 'Tsv') AND target_path <> '' AS book
  FROM ops) WHERE NOT book
UNION ALL SELECT *, regexp_replace(target_path, '\\.[^./]*$', ''), {_ext('target_path')} FROM (
  SELECT relative_path, target, target_path, status, message, status IN ('Ready', 'Conflict') AS adapter_available, sheet_name, sheet_index, true AS book
  FROM sheet_ops SEMI JOIN (SELECT relative_path FROM ops WHERE format IN ('Xls', 'Xlsx') AND target = 'Csv' AND target_path <> '') USING (relative_path))""")
cte("contested", "batch", """
SELECT *, row_number() OVER (ORDER BY lower(relative_path), relative_path, sheet_index) AS n FROM (
  SELECT *, count(*) OVER (PARTITION BY lower(target_path)) AS c FROM batch WHERE target_path <> '')
WHERE c > 1 OR lower(regexp_replace(stem, '-[0-9]+$', '') || ext) IN (SELECT lower(target_path) FROM batch WHERE target_path <> '')""")


@q("plan_batch", "batch contested existing", """
SELECT relative_path, target, name AS target_path, message, adapter_available, sheet_name,
  CASE WHEN name = target_path OR status = 'Skipped' THEN status WHEN lower(name) IN (SELECT lower(target_path) FROM existing) THEN 'Conflict'
    WHEN status = 'Conflict' THEN CASE WHEN adapter_available THEN 'Ready' ELSE 'EngineUnavailable' END ELSE status END AS status
FROM (SELECT b.*, coalesce(w.name, b.target_path) AS name FROM batch b LEFT JOIN contested c USING (relative_path, sheet_index) LEFT JOIN (
  WITH RECURSIVE walk AS (
    SELECT 0::BIGINT AS n, []::VARCHAR[] AS used, NULL::VARCHAR AS name
    UNION ALL SELECT n, list_append(used, lower(name)), name FROM (
      SELECT c.n, w.used, CASE WHEN NOT list_contains(w.used, lower(c.target_path)) THEN c.target_path
        ELSE c.stem || '-' || list_filter(range(2, len(w.used) + 3), lambda k: NOT list_contains(w.used, lower(c.stem || '-' || k || c.ext)))[1] || c.ext END AS name
      FROM walk w JOIN contested c ON c.n = w.n + 1))
  SELECT n, name FROM walk) w ON w.n = c.n)""")
def _(spark, sf_dir):
    """Files and sheets in one plan, each with a name of its own."""
    return inv.plan_batch(views.files(spark, sf_dir), views.worksheets(spark, sf_dir), views.existing_targets(spark, sf_dir), ROOT, OUT, OVERRIDES).drop("sheet_index")


_DONE = "status IN ('Succeeded', 'Failed', 'Cancelled', 'NotProcessed')"


@q("worksheet_summary", "sheet_ops", f"""SELECT relative_path, grouping(relative_path) AS is_total, count(sheet_name) AS sheets, count(*) FILTER ({_DONE}) AS selected,
  count(*) FILTER (status = 'Succeeded') AS csv_exported, 0 AS tsv_exported, count(*) FILTER (visibility <> 'visible' AND NOT ({_DONE})) AS hidden_skipped,
  count(*) FILTER (message = 'worksheet_empty') AS empty, count(*) FILTER (status = 'Failed') AS failed
FROM (SELECT * REPLACE (CASE WHEN status = 'Ready' AND default_selected THEN 'Succeeded' ELSE status END AS status) FROM sheet_ops) GROUP BY GROUPING SETS ((relative_path), ())""")
def _(spark, sf_dir):
    books = views.files(spark, sf_dir).join(views.worksheets(spark, sf_dir), "relative_path")
    planned = inv.plan_worksheets(books, views.existing_targets(spark, sf_dir), OUT)
    done = planned.withColumn("status", F.when((F.col("status") == "Ready") & F.col("default_selected"), "Succeeded").otherwise(F.col("status")))
    return rp.worksheet_summary(done)


@q("diagnostic_lookup", "results dim_messages dim_error_codes dim_status_keys", """
SELECT relative_path, coalesce(m.message_key, c.message_key, e.message_key, CASE WHEN r.status = 'Succeeded' AND target = 'Copy' THEN 'StatusCopied' END, s.message_key, 'StatusNotSelected') AS message_key
FROM results r LEFT JOIN dim_messages m USING (message) LEFT JOIN dim_error_codes c ON lower(r.message) = c.code
LEFT JOIN dim_error_codes e ON lower(r.error_code) = e.code LEFT JOIN dim_status_keys s ON s.status = r.status""")
def _(spark, sf_dir):
    return inv.diagnostic_lookup(results(spark, sf_dir)).select("relative_path", "message_key")


@q("companion_check", "artifacts", f"""SELECT relative_path, bool_and(lower({_ext('path')}) IN ({', '.join(map(lit, dims.COMPANION_EXTENSIONS))})) AS assets_ok FROM artifacts WHERE kind = 'companion' GROUP BY ALL""")
def _(spark, sf_dir):
    a = artifacts(spark, sf_dir).filter("kind = 'companion'").withColumnRenamed("path", "asset_path")
    return inv.companion_check(a, dims.COMPANION_EXTENSIONS)


def _conflict(how):
    def run(spark, sf_dir):
        o = ops(spark, sf_dir).select("relative_path", F.lower("target_path").alias("k"))
        return o.join(views.existing_targets(spark, sf_dir).select(F.lower("target_path").alias("k")), "k", how).select("relative_path")
    return run


register("conflict_semi", query("ops existing", "SELECT relative_path FROM ops WHERE lower(target_path) IN (SELECT lower(target_path) FROM existing)"))(_conflict("left_semi"))
register("conflict_anti", query("ops existing", "SELECT relative_path FROM ops WHERE lower(target_path) NOT IN (SELECT lower(target_path) FROM existing)"))(_conflict("left_anti"))


@q("collision_suffix", "ops existing", f"""
SELECT relative_path, name AS target_path, CASE WHEN i = 0 THEN status WHEN e.k IS NOT NULL THEN 'Conflict' WHEN status = 'Conflict' THEN CASE WHEN adapter_available THEN 'Ready' ELSE 'EngineUnavailable' END ELSE status END AS status
FROM (SELECT *, CASE WHEN i = 0 OR target_path = '' THEN target_path ELSE regexp_replace(target_path, '\\.[^./]*$', '') || '-' || (i + 1) || {_ext('target_path')} END AS name FROM (
  SELECT *, CASE WHEN target_path = '' THEN 0 ELSE row_number() OVER (PARTITION BY lower(target_path) ORDER BY lower(relative_path), relative_path) - 1 END AS i FROM ops))
LEFT JOIN (SELECT DISTINCT lower(target_path) AS k FROM existing) e ON lower(name) = e.k""")
def _(spark, sf_dir):
    return inv.collision_suffix(ops(spark, sf_dir), views.existing_targets(spark, sf_dir)).select("relative_path", "target_path", "status")


@q("results_to_items", "items", "SELECT * FROM items")
def _(spark, sf_dir):
    return items(spark, sf_dir)


@q("integrity_verdict", "judged", "SELECT relative_path, source_integrity, artifact_integrity FROM judged")
def _(spark, sf_dir):
    return judged(spark, sf_dir).select("relative_path", "source_integrity", "artifact_integrity")


@q("format_counts", "detected dim_capabilities", "SELECT format, count(*) AS n, any_value(ordinal) AS ordinal FROM detected JOIN dim_capabilities USING (format) GROUP BY format")
def _(spark, sf_dir):
    return rp.format_counts(views.files(spark, sf_dir))


@q("extension_breakdown", "files", f"SELECT coalesce(nullif(upper(substr({_ext('relative_path')}, 2)), ''), 'No extension') AS label, count(*) AS n FROM files GROUP BY 1")
def _(spark, sf_dir):
    return rp.extension_breakdown(views.files(spark, sf_dir))


_c = lambda cond, n: f"count(*) FILTER ({cond}) AS {n}"


@q("summary_counts", "results", "SELECT " + ", ".join(_c(f"status = '{s}'", n) for s, n in (
    ("Succeeded", "succeeded"), ("Conflict", "conflicts"), ("Failed", "failed"), ("Skipped", "skipped"), ("EngineUnavailable", "engine_unavailable"), ("Unsupported", "unsupported"))) + " FROM results")
def _(spark, sf_dir):
    return rp.summary_counts(results(spark, sf_dir))


@q("batch_counts", "items", "SELECT count(*) AS total, " + ", ".join(_c(f"status = '{s}'", n) for s, n in (
    ("Succeeded", "succeeded"), ("Unsupported", "unsupported"), ("EngineUnavailable", "engine_unavailable"), ("Failed", "failed"), ("Conflict", "conflict"),
    ("Skipped", "skipped"), ("Cancelled", "cancelled"), ("NotProcessed", "not_processed"))) + " FROM items")
def _(spark, sf_dir):
    return rp.batch_counts(items(spark, sf_dir))


@q("batch_verdict", "judged hashed", """SELECT n_items, n_issues, n_errors, CASE WHEN n_items = 0 OR n_issues > 0 OR n_errors > 0 THEN 'COMPLETED_WITH_ISSUES' ELSE 'COMPLETED' END AS final_state
FROM (SELECT count(*) AS n_items, count(*) FILTER (status IN ('Unsupported', 'EngineUnavailable', 'Failed', 'Conflict', 'NotProcessed') OR source_integrity <> 'PASS' OR artifact_integrity = 'FAIL') AS n_issues FROM judged),
  (SELECT count(*) AS n_errors FROM hashed WHERE sha256_before IS NULL)""")
def _(spark, sf_dir):
    return rp.batch_verdict(judged(spark, sf_dir), hashed(spark, sf_dir).filter("sha256_before is null"))


@q("preview_summary", "ops", "SELECT count(DISTINCT lower(source_path)) AS found, " + ", ".join([
    _c("status IN ('Ready', 'Converting', 'Cancelled', 'NotProcessed')", "ready"), _c("status = 'Skipped'", "skipped"),
    _c("status IN ('EngineUnavailable', 'Unsupported')", "unavailable"), _c("status = 'Conflict'", "conflict"), _c("status = 'Failed'", "error")]) + " FROM ops")
def _(spark, sf_dir):
    return rp.preview_summary(ops(spark, sf_dir))


@q("final_counters", "ops results", """SELECT count(*) FILTER (p AND status = 'Succeeded' AND target <> 'Copy') AS converted, count(*) FILTER (p AND status = 'Succeeded' AND target = 'Copy') AS copied,
  count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (status = 'Conflict') AS conflicts, count(*) FILTER (status IN ('EngineUnavailable', 'Unsupported')) AS unavailable,
  count(*) FILTER (status = 'Skipped') AS skipped, count(*) FILTER (NOT p AND status = 'Ready') AS not_selected
FROM (SELECT status, target, true AS p FROM results UNION ALL SELECT status, target, false FROM ops WHERE lower(relative_path) NOT IN (SELECT lower(relative_path) FROM results))""")
def _(spark, sf_dir):
    return rp.final_counters(results(spark, sf_dir), ops(spark, sf_dir))


_RANK = "CASE status " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(dims.STATUS_RANK, 1)) + " WHEN 'NotProcessed' THEN 11 ELSE 99 END"


@q("preview_sort", "ops", f"SELECT relative_path, row_number() OVER (ORDER BY {_RANK} DESC, lower(relative_path) DESC, relative_path DESC) AS position FROM ops")
def _(spark, sf_dir):
    return rp.preview_sort(ops(spark, sf_dir), "status", descending=True).select("relative_path", "position")


@q("preview_filter", "ops", "SELECT relative_path, status FROM ops WHERE status IN ('EngineUnavailable', 'Unsupported')")
def _(spark, sf_dir):
    return rp.preview_filter(ops(spark, sf_dir), "unavailable").select("relative_path", "status")


@q("item_order", "items", "SELECT relative_path, row_number() OVER (ORDER BY relative_path) AS position FROM items")
def _(spark, sf_dir):
    from ..operators.numbering import number_rows
    return number_rows(items(spark, sf_dir), [F.col("relative_path")], "position").select("relative_path", "position")


@q("markdown_partition", "ruled", "SELECT relative_path, CASE WHEN list_contains(allowed, 'Markdown') THEN 'runnable' ELSE 'unsupported' END AS part FROM ruled")
def _(spark, sf_dir):
    f = rp.supports_markdown(inv.detect_format(views.files(spark, sf_dir)))
    return f.select("relative_path", F.when(F.col("markdown"), "runnable").otherwise("unsupported").alias("part"))


@register("dedupe_by_hash", "SELECT sha256(text) AS content_sha256, min('doc/' || doc_id) AS representative, count(*) AS copies FROM documents GROUP BY 1")
def _(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return rp.dedupe_by_hash(d.select(F.sha2(F.encode("text", "UTF-8"), 256).alias("content_sha256"), F.concat(F.lit("doc/"), "doc_id").alias("relative_path")))


@register("sets_equal", """SELECT count(*) FILTER (l.doc_id IS NULL) AS only_right, count(*) FILTER (d.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL OR l.doc_id IS NULL) = 0 AS is_equal
FROM (SELECT DISTINCT doc_id FROM labels) l FULL JOIN (SELECT DISTINCT doc_id FROM documents) d ON d.doc_id = l.doc_id""")
def _(spark, sf_dir):
    return rp.sets_equal(views.table(spark, sf_dir, "labels").select("doc_id"), views.table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


_MANIFEST = r"""SELECT regexp_extract(relative_path, '^([^/]*)/', 1) AS run_id, CASE n % 23 WHEN 5 THEN 'a/../' || relative_path WHEN 6 THEN 'a/b/../../../' || relative_path WHEN 7 THEN 'a\..\..\' || relative_path ELSE relative_path END AS path,
  content_sha256 AS sha256, size_bytes, n FROM hashed"""
cte("verified", "hashed", f"""SELECT m.run_id, m.path, CASE WHEN starts_with(m.path, '../') OR starts_with(m.path, 'a/../../') OR m.n % 23 IN (6, 7) THEN 'INVALID_PATH' WHEN a.path IS NULL THEN 'MISSING' WHEN a.sha256 = m.sha256 THEN 'PASS' ELSE 'MISMATCH' END AS status
FROM ({_MANIFEST}) m LEFT JOIN (SELECT regexp_extract(relative_path, '^([^/]*)/', 1) AS run_id, relative_path AS path, sha256_after AS sha256 FROM hashed WHERE n % 19 <> 0) a ON a.run_id = m.run_id AND a.path = m.path""")


def _verified(spark, sf_dir):
    h = hashed(spark, sf_dir).withColumn("run_id", F.regexp_extract("relative_path", "^([^/]*)/", 1)).withColumnRenamed("relative_path", "path")
    lead = F.when(F.expr("n % 23 = 5"), "a/../").when(F.expr("n % 23 = 6"), "a/b/../../../").when(F.expr("n % 23 = 7"), "a\\..\\..\\").otherwise("")
    manifest = h.select("run_id", F.concat(lead, "path").alias("path"), F.col("content_sha256").alias("sha256"), "size_bytes")
    return rp.verify_artifacts(manifest, h.filter("n % 19 <> 0").select("run_id", "path", F.col("sha256_after").alias("sha256"), "size_bytes"))


@q("verify_artifacts", "verified", "SELECT * FROM verified")
def _(spark, sf_dir):
    return _verified(spark, sf_dir)[0]


@q("verify_runs", "verified", "SELECT run_id, CASE WHEN bool_and(status = 'PASS') THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS artifacts, count(*) FILTER (status <> 'PASS') AS problems FROM verified GROUP BY run_id")
def _(spark, sf_dir):
    return _verified(spark, sf_dir)[1]


@q("acceptance_join", "detected items artifacts", """
SELECT relative_path, array_to_string(rs, '; ') AS reasons, CASE WHEN len(rs) = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (
SELECT f.relative_path, list_filter([CASE WHEN i.status <> 'Succeeded' THEN 'status is ' || i.status END, CASE WHEN i.result_path IS NULL THEN 'no primary artifact for source' END,
  CASE WHEN i.result_path IS NOT NULL AND coalesce(a.n, 0) <> 1 THEN 'expected exactly one primary artifact' END, CASE WHEN a.n = 1 AND a.size_bytes = 0 THEN 'empty output' END,
  CASE WHEN a.n = 1 AND f.format <> 'Txt' AND a.sha256 = f.content_sha256 THEN 'output is identical to source' END], lambda r: r IS NOT NULL) AS rs
FROM detected f JOIN items i USING (relative_path)
LEFT JOIN (SELECT lower(ltrim(path, '/')) AS k, count(*) AS n, any_value(sha256) AS sha256, any_value(size_bytes) AS size_bytes FROM artifacts WHERE kind = 'primary' GROUP BY 1) a ON a.k = lower(ltrim(i.result_path, '/')))""")
def _(spark, sf_dir):
    fixtures = inv.detect_format(views.files(spark, sf_dir)).select("relative_path", "format", "content_sha256")
    return rp.acceptance_join(fixtures, items(spark, sf_dir), artifacts(spark, sf_dir))


@q("lab_summary", "judged artifacts", """SELECT count(*) AS files_attempted, count(*) FILTER (status <> 'Succeeded') AS command_failures, count(*) FILTER (relative_path IN (SELECT relative_path FROM artifacts WHERE kind = 'primary' AND sha256 IS NOT NULL)) AS outputs_produced
FROM judged WHERE lower(regexp_extract(relative_path, '\\.([^./]*)$', 1)) IN ('pdf', 'docx', 'pptx', 'xlsx', 'txt')""")
def _(spark, sf_dir):
    from ..operators.harness import lab_summary
    out = artifacts(spark, sf_dir).filter("kind = 'primary'").select("relative_path", F.col("sha256").alias("output_sha256"))
    rows = items(spark, sf_dir).filter("lower(regexp_extract(relative_path, '\\\\.([^./]*)$', 1)) IN ('pdf', 'docx', 'pptx', 'xlsx', 'txt')")
    return lab_summary(rows.join(out, "relative_path", "left").withColumn("exit_code", F.expr("CASE WHEN status = 'Succeeded' THEN 0 ELSE 2 END")))


@register("sha256_hex", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


_EVIDENCE = """SELECT relative_path, sha256('{"schema_version":"run/1","source_sha256":"' || content_sha256 || '","markdown_sha256":"' || sha256('md' || content_sha256)
  || '","corpus":{"id":"ad-hoc","version":"1"},"engine":"text","pipeline":"fidelity/0.4"}') AS evidence_key, n FROM hashed"""


def _runs(spark, sf_dir):
    h = hashed(spark, sf_dir)
    return rp.evidence_keys(h.select(
        "relative_path", "n", F.lit("run/1").alias("schema_version"), F.col("content_sha256").alias("source_sha256"),
        F.sha2(F.concat(F.lit("md"), "content_sha256"), 256).alias("markdown_sha256"),
        F.struct(F.lit("ad-hoc").alias("id"), F.lit("1").alias("version")).alias("corpus"), F.lit("text").alias("engine"), F.lit("fidelity/0.4").alias("pipeline")))


@q("evidence_key", "hashed", f"SELECT relative_path, evidence_key, 'run-' || left(evidence_key, 12) AS run_id FROM ({_EVIDENCE})")
def _(spark, sf_dir):
    return _runs(spark, sf_dir).select("relative_path", "evidence_key", "run_id")


_MIME = ["image/png", "image/jpeg", "image/svg+xml", "IMAGE/GIF", "application/octet-stream"]
_PART = ["word/media/a.png", "word/media/b.jpeg", "word/media/c.svg", "word/media/d.GIF", "word/media/e.bin"]


@q("asset_numbering", "dim_image_types", f"""SELECT doc_id, asset_id, 'image-' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY pos))::VARCHAR, 3, '0') || '.' || ext AS file_name FROM (
SELECT doc_id, asset_id, pos, coalesce(extension, CASE WHEN lower(regexp_extract(part, '\\.([^./]+)$', 1)) IN ('png', 'jpg', 'gif', 'webp', 'bmp', 'tiff', 'jpeg') THEN regexp_extract(part, '\\.([^./]+)$', 1) END) AS ext
FROM (SELECT conv_id * 1000000 AS doc_id, length(text) % 40 AS asset_id, min(turn) AS pos, {strings(_MIME)}[length(text) % 40 % 5 + 1] AS mime, {strings(_PART)}[length(text) % 40 % 7 % 5 + 1] AS part FROM conversations GROUP BY ALL)
LEFT JOIN dim_image_types ON lower(mime) = media_type) WHERE ext IS NOT NULL""")
def _(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations").select(
        F.expr("conv_id * 1000000").alias("doc_id"), (F.length("text") % 40).alias("asset_id"), F.col("turn").alias("pos"))
    assets = c.select("doc_id", "asset_id").distinct().select(
        "doc_id", "asset_id", views.pick(_MIME, F.col("asset_id") % 5).alias("media_type"), views.pick(_PART, F.col("asset_id") % 7 % 5).alias("origin_part"))
    return number_assets(c, assets)
