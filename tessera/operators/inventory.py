"""Inventory and planning: formats, rules, routes, paths, worksheet names, operations, collisions."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.dims import AVAILABLE_ADAPTERS, RESERVED_NAMES, SAFE_COPY_FORMATS, dim
from ..session import cut_lineage
from .naming import free_indexes
from .numbering import number_rows

MAX_NAME = 200
INVALID_NAME_CHARS = r'[<>:"/\\|?*\x{00}-\x{1F}]'


def scan_filter(files: DataFrame, excluded_directory: str = None, excluded_file: str = None,
                recursive: bool = True) -> DataFrame:
    """Drop office lock files, an excluded directory below the root and an excluded file."""
    name = F.regexp_extract("relative_path", r"([^/]*)$", 1)
    keep = ~name.startswith("~$")
    if excluded_directory:
        keep &= ~F.lower("relative_path").startswith(excluded_directory.lower().rstrip("/") + "/")
    if excluded_file:
        keep &= F.lower("relative_path") != excluded_file.lower()
    if not recursive:
        keep &= ~F.col("relative_path").contains("/")
    return files.filter(keep)


def extension_of(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./\\]*)$", 1)


def detect_format(files: DataFrame) -> DataFrame:
    ext = dim(files.sparkSession, "extensions")
    return (files.withColumn("extension", F.lower(extension_of(F.col("relative_path"))))
            .join(ext, "extension", "left").withColumn("format", F.coalesce("format", F.lit("Unknown"))))


def with_capability(files: DataFrame) -> DataFrame:
    return files.join(dim(files.sparkSession, "capabilities"), "format")


def apply_rules(files: DataFrame, overrides: list[tuple[str, str]] = ()) -> DataFrame:
    """Target per file: the format's default, or an override the format supports; of several for one format the last counts."""
    wanted = F.broadcast(files.sparkSession.createDataFrame(list(dict(overrides).items()), "format string, override string"))
    rows = with_capability(files).join(wanted, "format", "left")
    ok = F.col("override").isNull() | F.array_contains("allowed", F.col("override"))
    return rows.withColumn("rule_ok", ok).withColumn(
        "target", F.when(ok, F.coalesce("override", "default_target")).otherwise(F.col("default_target"))).drop("override")


def required_application(ops: DataFrame) -> DataFrame:
    return ops.join(dim(ops.sparkSession, "engines"), ["format", "target"], "left")


def is_safe_copy(format: Column, target: Column) -> Column:
    return (target == "Copy") & format.isin(SAFE_COPY_FORMATS)


def resolve_route(ops: DataFrame, available: list[str] = None) -> DataFrame:
    """First adapter that accepts the pair, and whether it can run."""
    routes = dim(ops.sparkSession, "routes").groupBy("format", "target").agg(F.min_by("adapter", "priority").alias("adapter"))
    usable = F.col("adapter").isin(AVAILABLE_ADAPTERS if available is None else available)
    return ops.join(F.broadcast(routes), ["format", "target"], "left").withColumn(
        "adapter_available", F.coalesce(usable, F.lit(False)))


def with_target_path(ops: DataFrame, out: str) -> DataFrame:
    """Result path below ``out``; Copy keeps the source extension."""
    ext = dim(ops.sparkSession, "target_extensions")
    rows = ops.join(ext, "target", "left").withColumn(
        "target_extension", F.when(F.col("target") == "Copy", extension_of(F.col("relative_path"))).otherwise(F.col("target_extension")))
    stem = F.regexp_replace("relative_path", r"\.[^./\\]*$", "")
    return rows.withColumn("target_path", F.concat(F.lit(out + "/"), stem, "target_extension"))


def path_is_safe(source_path: Column, relative_path: Column, root: str) -> Column:
    """Relative, without traversal, and exactly the source below the root."""
    parts = F.split(relative_path, r"[/\\]")
    return (~relative_path.rlike(r"^(/|\\|[A-Za-z]:)") & (tx.trim_ws(relative_path) != "")
            & ~F.exists(parts, lambda p: p.isin(".", ".."))
            & (F.lower(source_path) == F.lower(F.concat(F.lit(root + "/"), relative_path))))


def destination_check(source_root: Column, output_root: Column) -> Column:
    s, o = (F.lower(F.regexp_replace(c, r"[/\\]+$", "")) for c in (source_root, output_root))
    return (F.when(tx.is_blank(source_root) | tx.is_blank(output_root), "output_path_missing")
            .when(s == o, "output_equals_source").when(s.startswith(F.concat(o, F.lit("/"))), "output_is_source_parent")
            .otherwise("ok"))


def redact_path(path: Column) -> Column:
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = path.rlike(r"^[/\\]") | slashed.contains(":") | F.array_contains(F.split(slashed, "/"), "..") | slashed.rlike(r"\p{Cc}")
    return F.when(bad, F.lit("[redacted]")).otherwise(slashed)


def is_safe_entry(name: Column) -> Column:
    parts = F.filter(F.split(name, "/"), lambda p: p != "")
    return (~tx.is_blank(name) & ~name.rlike(r"^[/\\]") & ~name.contains(":") & (F.size(parts) > 0)
            & ~F.exists(parts, lambda p: p.isin(".", "..")))


def archive_entry_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Code per entry of ``expected(name)`` and ``actual(name)``, names compared without case."""
    side = lambda df, n: df.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias(n), F.count("*").alias("n_" + n))
    rows = side(expected, "expected").join(side(actual, "actual"), "key", "full_outer")
    name = F.coalesce("actual", "expected")
    return rows.select(
        "key", F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected")
        .when(F.col("n_actual") > 1, "duplicate").when(~is_safe_entry(name), "unsafe").otherwise("ok").alias("code"))


def rtrim_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[ .]+$", "")


def sanitize_sheet_name(name: Column) -> Column:
    safe = rtrim_name(F.regexp_replace(tx.trim_ws(name), INVALID_NAME_CHARS, "_"))
    safe = F.when(tx.is_blank(safe), F.lit("Sheet")).otherwise(safe)
    reserved = F.upper(F.substring_index(safe, ".", 1)).isin(RESERVED_NAMES)
    return F.when(reserved, F.concat(F.lit("_"), safe)).otherwise(safe)


def sheet_output_name(book: Column, sheet: Column, extension: Column, suffix: Column) -> Column:
    """``book__sheet<suffix>.ext`` inside the name budget; both names are already sanitised."""
    budget = F.lit(MAX_NAME - 2) - F.length(extension) - F.length(suffix)
    book_budget = F.least(F.length(book), budget - F.least(F.length(sheet), F.floor(budget / 2)))
    cut = lambda v, n: rtrim_name(F.left(v, n.cast("int")))
    return F.concat(cut(book, book_budget), F.lit("__"), cut(sheet, budget - book_budget), suffix, extension)


def collision_name(path: Column, index: Column) -> Column:
    """Path of the ``index``-th claimant (0-based) of a target: the second gets ``-2``."""
    folder, name = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    ext = extension_of(name)
    tail = F.concat(F.lit("-"), (index + 1).cast("string"), ext)
    stem = F.left(F.regexp_replace(name, r"\.[^./\\]*$", ""), F.lit(MAX_NAME) - F.length(tail))
    return F.when(index == 0, path).otherwise(F.concat(folder, rtrim_name(stem), tail))


def plan_operations(files: DataFrame, existing: DataFrame, root: str, out: str, overrides=(), available=None) -> DataFrame:
    """One operation per file: skip, unsupported, bad path, conflict, no adapter, unavailable, ready."""
    rows = apply_rules(detect_format(files), overrides)
    rows = with_target_path(resolve_route(rows, available), out)
    there = existing.select(F.lower("target_path").alias("_key")).distinct().withColumn("_there", F.lit(True))
    rows = rows.join(there, F.lower("target_path") == F.col("_key"), "left").drop("_key")
    safe = path_is_safe(F.col("source_path"), F.col("relative_path"), root)
    status = (F.when(F.col("target") == "Skip", "Skipped")
              .when(~F.array_contains("allowed", F.col("target")), "Unsupported")
              .when(~safe, "Failed").when(F.col("_there"), "Conflict").when(F.col("adapter").isNull(), "Unsupported")
              .when(~F.col("adapter_available"), "EngineUnavailable").otherwise("Ready"))
    message = (F.when(F.col("status") == "Skipped", "OperationSkipped").when(F.col("status") == "Unsupported", "OperationUnsupported")
               .when(F.col("status") == "Failed", "OperationInvalidTarget").when(F.col("status") == "Conflict", "OperationTargetExists")
               .when(F.col("status") == "EngineUnavailable", "OperationUnavailable")
               .when(F.col("target") == "Copy", "OperationReadyCopy").otherwise("OperationReady"))
    rows = rows.withColumn("status", status)
    placed = ~F.col("status").isin("Skipped", "Failed") & F.array_contains("allowed", F.col("target"))
    return rows.select(
        "source_path", "relative_path", "format", "target", "target_extension",
        F.when(placed, F.col("target_path")).otherwise("").alias("target_path"),
        (placed & F.col("adapter_available")).alias("adapter_available"), "status", message.alias("message"), "size_bytes")


def collision_suffix(ops: DataFrame, existing: DataFrame) -> DataFrame:
    """Give every operation a target of its own, in path order without case.

    Claimants of one target are numbered by a distributed sort, so a target wanted by a third of
    all files is not pulled into one task. A suffixed name may be the plain target of another
    operation; ``naming`` finds the next free ones without rounds over claimants. Only names cut to
    ``MAX_NAME`` can then still meet those of another family; they are settled in rounds: the earlier
    operation keeps the name, the later one and those behind it in its family move on. Operations on
    sheets of one workbook follow each other by ``sheet_index``; what is skipped stays skipped.
    """
    sheets = [F.col("sheet_index")] if "sheet_index" in ops.columns else []
    ordered = [F.lower("target_path"), F.lower("relative_path"), F.col("relative_path"), *sheets]
    claims = ops.filter("target_path <> ''")
    numbered = number_rows(claims, ordered, "_n")
    first = numbered.groupBy(F.lower("target_path").alias("_base")).agg(F.min("_n").alias("_first"))
    rows = numbered.withColumn("_base", F.lower("target_path")).join(first, "_base")
    rows = rows.withColumn("_i", F.col("_n") - F.col("_first")).drop("_first")
    plan = [F.lower("relative_path").alias("_path"), *[c.alias("_sheet") for c in sheets]]
    rows = rows.select("*", *plan)
    order = ["_path", "relative_path", *["_sheet" for _ in sheets], "_n"]
    rows = cut_lineage(free_indexes(rows, order, MAX_NAME).drop("_path", "_sheet"))
    named = rows.withColumn("_name", collision_name(F.col("target_path"), F.col("_i")))
    rank = F.struct(F.lower("relative_path").alias("a"), F.col("relative_path").alias("b"), *[c.alias("s") for c in sheets], F.col("_n").alias("n"))
    while True:
        wanted = named.groupBy(F.lower("_name").alias("_key")).agg(F.count("*").alias("_c"), F.min(rank).alias("_winner")).filter("_c > 1")
        if wanted.isEmpty():
            break
        moved = named.join(wanted, F.lower("_name") == F.col("_key"), "left").withColumn(
            "_i", F.col("_i") + F.coalesce((F.col("_winner.n") != F.col("_n")).cast("int"), F.lit(0)))
        behind = W.partitionBy("_base").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
        touched = named.join(wanted, F.lower("_name") == F.col("_key"), "left_semi").select("_base").distinct()
        moved = moved.drop("_key", "_c", "_winner")
        again = moved.join(touched, "_base", "left_semi").withColumn(
            "_i", F.col("_n") + F.max(F.col("_i") - F.col("_n")).over(behind))
        moved = moved.join(touched, "_base", "left_anti").unionByName(again)
        named = cut_lineage(moved.withColumn("_name", collision_name(F.col("target_path"), F.col("_i"))))
    there = existing.select(F.lower("target_path").alias("_key")).distinct().withColumn("_there", F.lit(True))
    named = named.join(there, F.lower("_name") == F.col("_key"), "left")
    changed = F.col("_name") != F.col("target_path")
    status = (F.when(~changed | (F.col("status") == "Skipped"), F.col("status")).when(F.col("_there"), "Conflict")
              .when((F.col("status") == "Conflict"), F.when(F.col("adapter_available"), "Ready").otherwise("EngineUnavailable"))
              .otherwise(F.col("status")))
    settled = named.select(*[c for c in ops.columns if c not in ("target_path", "status")],
                           F.col("_name").alias("target_path"), status.alias("status"))
    return settled.unionByName(ops.filter("target_path = ''"))


def plan_worksheets(books: DataFrame, existing: DataFrame, out: str, target: str = "Csv", available: list[str] = None) -> DataFrame:
    """One operation per worksheet of ``books(source_path, relative_path, worksheets, inspection_error)``."""
    spark = books.sparkSession
    extension = F.lit("." + target.lower())
    rows = detect_format(books).withColumn("target", F.lit(target))
    rows = resolve_route(rows, available).withColumn("sheet", F.explode_outer("worksheets"))
    book = sanitize_sheet_name(F.regexp_replace(F.regexp_extract("relative_path", r"([^/]*)$", 1), r"\.[^.]*$", ""))
    folder = F.coalesce(F.regexp_extract("relative_path", r"^(.*/)[^/]*$", 1), F.lit(""))
    rows = rows.withColumn("book", book).withColumn("safe_sheet", sanitize_sheet_name(F.col("sheet.name")))
    plain = sheet_output_name(F.col("book"), F.col("safe_sheet"), extension, F.lit(""))
    rows = rows.withColumn("plain", plain)
    # A workbook's sheets come from one array cell, which bounds the window.
    n = F.row_number().over(W.partitionBy("relative_path", F.lower("plain")).orderBy("sheet.index"))
    suffix = F.when(n > 1, F.concat(F.lit("-"), n)).otherwise(F.lit(""))
    rows = rows.withColumn("suffix", suffix).withColumn("file_name", sheet_output_name(
        F.col("book"), F.col("safe_sheet"), extension, F.col("suffix")))
    # Without inspected sheets the workbook stays one plain operation.
    stem = F.regexp_replace("relative_path", r"\.[^./\\]*$", "")
    rows = rows.withColumn("path", F.when(F.col("sheet").isNotNull(), F.concat(F.lit(out + "/"), folder, "file_name"))
                           .when(F.col("worksheets").isNull(), F.concat(F.lit(out + "/"), stem, extension)))
    there = existing.select(F.lower("target_path").alias("_key")).distinct().withColumn("_there", F.lit(True))
    rows = rows.join(there, F.lower("path") == F.col("_key"), "left")
    failed, none = F.col("inspection_error").isNotNull(), F.col("worksheets").isNotNull() & (F.size("worksheets") == 0)
    unsafe = F.exists(F.split("relative_path", "/"), lambda p: p.isin(".", ".."))
    status = (F.when(unsafe | failed, "Failed").when(none, "Skipped").when(F.col("_there"), "Conflict")
              .when(F.col("sheet.is_empty"), "Skipped").when(F.col("adapter").isNull(), "Unsupported")
              .when(~F.col("adapter_available"), "EngineUnavailable").otherwise("Ready"))
    message = (F.when(unsafe, "OperationUnsafeSource").when(failed, "worksheet_inspection_failure").when(none, "worksheet_none")
               .when(F.col("_there"), "OperationTargetExists").when(F.col("sheet.is_empty"), "worksheet_empty")
               .when(F.col("adapter").isNull(), "OperationUnsupported").when(~F.col("adapter_available"), "OperationUnavailable")
               .when(F.col("sheet.visibility") != "visible", "worksheet_hidden").otherwise("OperationReady"))
    live = ~failed & ~unsafe
    rows = rows.filter(live | F.col("sheet").isNull() | (F.col("sheet.index") == 1))
    rows = rows.withColumn("status", status)
    return rows.select(
        "relative_path", F.when(live, F.col("sheet.name")).alias("sheet_name"), F.coalesce("sheet.index", F.lit(0)).alias("sheet_index"), "target",
        F.when(live, F.coalesce("path", F.lit(""))).otherwise("").alias("target_path"), "status", message.alias("message"),
        F.when(live, F.col("sheet.visibility")).alias("visibility"),
        ((F.col("status") == "Ready") & F.coalesce(F.col("sheet.visibility") == "visible", F.lit(True))).alias("default_selected"))


def plan_batch(files: DataFrame, worksheets: DataFrame, existing: DataFrame, root: str, out: str, overrides=(), available=None) -> DataFrame:
    """The whole plan: one operation per file, or per sheet of a workbook that goes to CSV or TSV, each with a target of its own.

    ``worksheets(relative_path, worksheets, inspection_error)`` belongs to the workbooks.
    """
    plain = plan_operations(files, existing, root, out, overrides, available)
    to_sheets = F.col("format").isin("Xls", "Xlsx") & F.col("target").isin("Csv", "Tsv") & (F.col("target_path") != "")
    shared = ["relative_path", "target", "target_path", "status", "message"]
    single = plain.filter(~to_sheets).select(*shared, "adapter_available", F.lit(None).cast("string").alias("sheet_name"), F.lit(0).alias("sheet_index"))
    plans = [single]
    for target in ("Csv", "Tsv"):
        books = files.join(plain.filter(to_sheets & (F.col("target") == target)).select("relative_path"), "relative_path", "left_semi").join(worksheets, "relative_path", "left")
        rows = plan_worksheets(books, existing, out, target, available)
        able = rows["status"].isin("Ready", "Conflict")
        plans.append(rows.select(*shared, able.alias("adapter_available"), "sheet_name", "sheet_index"))
    every = plans[0].unionByName(plans[1]).unionByName(plans[2])
    return collision_suffix(every, existing)


def diagnostic_lookup(results: DataFrame) -> DataFrame:
    """Message key: by message, by message as a code, by error code, by status."""
    spark = results.sparkSession
    codes, messages, statuses = dim(spark, "error_codes"), dim(spark, "messages"), dim(spark, "status_keys")
    by = lambda d, key, name: d.select(F.col(d.columns[0]).alias(key), F.col("message_key").alias(name))
    rows = (results.join(by(messages, "message", "k1"), "message", "left")
            .join(by(codes, "_m", "k2"), F.lower("message") == F.col("_m"), "left")
            .join(by(codes, "_e", "k3"), F.lower("error_code") == F.col("_e"), "left")
            .join(by(statuses, "status", "k4"), "status", "left"))
    copied = F.when((F.col("status") == "Succeeded") & (F.col("target") == "Copy"), "StatusCopied")
    return rows.select(*results.columns, F.coalesce("k1", "k2", "k3", copied, "k4", F.lit("StatusNotSelected")).alias("message_key"))


def companion_check(assets: DataFrame, allowed: list[str]) -> DataFrame:
    name = F.regexp_extract("asset_path", r"([^/]*)$", 1)
    ok = F.lower(extension_of(name)).isin(allowed) & ~name.startswith(".") & ~name.contains(":")
    return assets.groupBy("relative_path").agg(F.every(ok).alias("assets_ok"))


def validate_output(outputs: DataFrame) -> DataFrame:
    """Code of ``outputs(path, target, content BINARY, source_length, parts ARRAY<STRING>)``, null when valid."""
    required = F.create_map(*[F.lit(x) for x in ("Docx", "word/document.xml", "Xlsx", "xl/workbook.xml", "Pptx", "ppt/presentation.xml")])
    names = F.transform("parts", F.lower)
    ooxml = F.coalesce(F.array_contains(names, "[content_types].xml") & F.array_contains(
        names, F.element_at(required, F.col("target"))), F.lit(False))
    text = F.try_validate_utf8("content")
    code = (F.when(F.col("content").isNull(), "output_missing")
            .when(F.length("content") == 0, F.when((F.col("target") != "Markdown") | (F.col("source_length") != 0), "output_empty"))
            .when(F.col("target").isin("Docx", "Xlsx", "Pptx"), F.when(~ooxml, "ooxml_structure_invalid"))
            .when(F.col("target") == "Pdf", F.when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "pdf_signature_invalid"))
            .when(F.col("target") == "Markdown", F.when(text.isNull(), "output_invalid_utf8")
                  .when(tx.is_blank(text) & (F.col("source_length") != 0), "output_empty"))
            .when(F.col("target").isin("Txt", "Csv", "Tsv", "Copy"), None).otherwise("unsupported_output_validation"))
    return outputs.select("path", code.alias("error_code"), code.isNull().alias("valid"))
