"""Readers: file inventory, strict text, run results, lab logs, manifests, quality profiles."""
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.inventory import scan_filter
from ..session import scratch


def _relative(root: str):
    plain = F.regexp_replace("path", "^file:/*", "/")
    return F.regexp_replace(plain, "^" + root.rstrip("/") + "/", "")


def scan_inventory(spark: SparkSession, root: str, recursive: bool = True, excluded_directory: str = None,
                   excluded_file: str = None) -> DataFrame:
    """Paths and sizes below a folder; the content column is pruned, so no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rows = files.select(F.col("path").alias("source_path"), _relative(root).alias("relative_path"), F.col("length").alias("size_bytes"))
    return scan_filter(rows, excluded_directory, excluded_file, recursive)


LISTED = "kind string, path string, size_bytes bigint, message string"
ENTRIES = 8192
# What a scan says about a root or folder it can't use.
MISSING, LINKED, DENIED = "Selected folder does not exist.", "Selected folder is a reparse point.", "No access to this folder."


def local_path(path: str) -> str:
    return re.sub("^file:/*", "/", path)


def _entries(folder: str, is_root: bool):
    """Files, folders and errors of one folder; links are neither followed nor listed."""
    if is_root and os.path.islink(folder):
        yield "error", folder, None, LINKED
        return
    try:
        with os.scandir(folder) as found:
            for e in found:
                if e.is_symlink():
                    continue
                if e.is_dir(follow_symlinks=False):
                    yield "folder", e.path, None, None
                elif e.is_file(follow_symlinks=False):
                    yield "file", e.path, e.stat(follow_symlinks=False).st_size, None
    except OSError as e:
        gone = is_root and isinstance(e, (FileNotFoundError, NotADirectoryError))
        yield "error", folder, None, MISSING if gone else DENIED


def _lister(is_root: bool):
    names = [c.split(" ")[0] for c in LISTED.split(", ")]

    def batch(rows):
        columns = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=names)

    def run(batches):
        rows = []
        for folders in batches:
            for folder in folders.column(0).to_pylist():
                for row in _entries(folder, is_root):
                    rows.append(row)
                    if len(rows) >= ENTRIES:                  # a folder may hold any number of files
                        yield batch(rows)
                        rows = []
        yield batch(rows)
    return run


def scan_folder(spark: SparkSession, root: str, recursive: bool = True, excluded_directory: str = None,
                excluded_file: str = None) -> tuple[DataFrame, DataFrame]:
    """``files(source_path, relative_path, size_bytes)`` below a folder all executors reach, and ``errors(relative_path, message)``.

    One job lists all folders of a level, each folder in a task; what it finds is written, and its
    folders are the next level. A missing root, a root that is a link and folders that can't be read
    become error rows, and the rest is still scanned. For stores that only Spark reads, see
    ``scan_inventory``.
    """
    root, out, level = local_path(root).rstrip("/"), scratch(spark), 0
    frontier = spark.createDataFrame([(root,)], "path string")
    relative = F.expr(f"substring(path, {len(root) + 2})")
    while True:
        frontier.repartition("path").mapInArrow(_lister(level == 0), LISTED).write.parquet(f"{out}/level={level}")
        if not recursive:
            break
        found = spark.read.schema(LISTED).parquet(f"{out}/level={level}").filter("kind = 'folder'")
        if excluded_directory:
            found = found.filter(F.lower(relative) != excluded_directory.lower().strip("/"))
        frontier, level = found.select("path"), level + 1
        if frontier.isEmpty():
            break
    rows = spark.read.schema(LISTED + ", level int").parquet(out)
    files = rows.filter("kind = 'file'").select(F.col("path").alias("source_path"), relative.alias("relative_path"), "size_bytes")
    errors = rows.filter("kind = 'error'").select(relative.alias("relative_path"), "message")
    return scan_filter(files, excluded_directory, excluded_file, recursive), errors


def read_content(spark: SparkSession, root: str, max_bytes: int = 512 << 20) -> DataFrame:
    """``(path, content, error_code)`` of all files; a larger one is not opened and says resource_limit."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path, none = _relative(root).alias("path"), F.lit(None)
    small = files.filter(F.col("length") <= max_bytes).select(path, "content", none.cast("string").alias("error_code"))
    large = files.filter(F.col("length") > max_bytes).select(path, none.cast("binary").alias("content"), F.lit("resource_limit").alias("error_code"))
    return small.unionByName(large)


def _utf16(content, order: str):
    """Text of UTF-16 bytes; null for an odd count and for surrogates that stand alone."""
    high, low = ("D[89AB]", "D[C-F]")
    unit = "(?:[0-9A-CEF][0-9A-F]|D[0-7])"
    pair = {"BE": rf"(?:{unit}[0-9A-F]{{2}}|{high}[0-9A-F]{{2}}{low}[0-9A-F]{{2}})", "LE": rf"(?:[0-9A-F]{{2}}{unit}|[0-9A-F]{{2}}{high}[0-9A-F]{{2}}{low})"}
    return F.when(F.hex(content).rlike(f"^{pair[order]}*+$"), F.decode(content, f"UTF-16{order}"))


def decode_strict(files: DataFrame) -> DataFrame:
    """Text of ``files(path, content)`` by byte-order mark, strict UTF-8 without one; what can't be
    decoded keeps its row with an error code, and an error of the reader stays."""
    head = F.hex(F.substring("content", 1, 3))
    rest = lambda n: F.substring("content", n, 2147483647)
    utf8 = F.try_validate_utf8(F.when(head.startswith("EFBBBF"), rest(4)).otherwise(F.col("content")))
    text = F.when(head.startswith("FFFE"), _utf16(rest(3), "LE")).when(head.startswith("FEFF"), _utf16(rest(3), "BE")).otherwise(utf8)
    earlier = F.col("error_code") if "error_code" in files.columns else F.lit(None).cast("string")
    return files.select("path", text.alias("text"), F.coalesce(earlier, F.when(text.isNull(), "text_encoding_unsupported")).alias("error_code"))


def transcode_utf16_utf8(files: DataFrame) -> DataFrame:
    """UTF-16 LE bytes (mark dropped) to UTF-8 bytes; malformed ones to null with an error code."""
    text = F.regexp_replace(_utf16(F.col("content"), "LE"), "^\\x{FEFF}", "")
    return files.select("path", F.encode(text, "UTF-8").alias("content"), F.when(text.isNull(), "text_encoding_unsupported").alias("error_code"))


RUN_SCHEMA = """arm string, fixture string, duration_seconds double, start_rss_mb double, post_rss_mb double, peak_rss_mb double,
  success boolean, error string, char_count bigint, line_count bigint,
  provenance struct<num_pages:bigint,num_texts:bigint,num_tables:bigint,num_pictures:bigint,has_provenance_bboxes:boolean,valid_bbox_count:bigint,keys:array<string>>"""


def read_run_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path, multiLine=True)


def read_lab_results(spark: SparkSession, path: str) -> DataFrame:
    schema = "input string, extension string, exit_code int, output_sha256 string, report_sha256 string, duration_ms bigint"
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per file of a manifest."""
    schema = "profileId string, files array<struct<path:string,sha256:string,sizeBytes:bigint>>"
    m = spark.read.schema(schema).json(path, multiLine=True)
    return m.select(F.col("profileId").alias("profile_id"), F.explode("files").alias("f")).select(
        "profile_id", "f.path", "f.sha256", F.col("f.sizeBytes").alias("size_bytes"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """One row per format, rule type and rule of a quality profile."""
    schema = "profileId string, formats map<string, struct<status:string,metrics:array<string>,findings:array<string>>>"
    p = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("formats").alias("format", "f"))
    rules = F.concat(F.transform("f.metrics", lambda m: F.struct(F.lit("metric").alias("rule_type"), m.alias("rule_name"))),
                     F.transform("f.findings", lambda c: F.struct(F.lit("finding").alias("rule_type"), c.alias("rule_name"))))
    return p.select("format", "f.status", F.explode_outer(rules).alias("r")).select("format", "status", "r.*")
