"""Formats, targets, routes, metric registry, quality profile, error codes.

The tables have a fixed number of rows that does not grow with the data, so they are the only
frames in the package that carry a broadcast hint.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: source formats in enumeration order ---------------------------------------
FORMATS = ["Json", "Doc", "Xls", "Ppt", "Docx", "Xlsx", "Pptx", "Odt", "Ods", "Odp", "Pdf",
           "Csv", "Tsv", "Epub", "Image", "Archive", "Html", "Txt", "Unknown"]

# --- fixed values: extension -> format --------------------------------------------------------
IMAGE_EXTENSIONS = [".avif", ".bmp", ".gif", ".heic", ".heif", ".ico", ".jp2", ".jpe", ".jpeg",
                    ".jpg", ".png", ".tif", ".tiff", ".webp"]
ARCHIVE_EXTENSIONS = [".7z", ".bz2", ".gz", ".rar", ".tar", ".tgz", ".zip"]
EXTENSIONS = (
    [("." + f.lower(), f) for f in FORMATS if f not in ("Image", "Archive", "Unknown")]
    + [(".htm", "Html")]
    + [(e, "Image") for e in IMAGE_EXTENSIONS]
    + [(e, "Archive") for e in ARCHIVE_EXTENSIONS]
)

# --- fixed values: format -> semantic family --------------------------------------------------
FAMILIES = {
    "Doc": "Document", "Docx": "Document", "Odt": "Document",
    "Xls": "Spreadsheet", "Xlsx": "Spreadsheet", "Ods": "Spreadsheet",
    "Ppt": "Presentation", "Pptx": "Presentation", "Odp": "Presentation",
    "Pdf": "Pdf",
    "Json": "DataCode", "Html": "DataCode",
    "Txt": "TextData", "Csv": "TextData", "Tsv": "TextData",
    "Image": "Image",
    "Epub": "Ebook",
    "Archive": "Generic", "Unknown": "Generic",
}

# --- fixed values: format -> (default target, allowed targets) --------------------------------
CAPABILITIES = {
    "Json": ("Txt", ["Txt", "Markdown", "Skip"]),
    "Doc": ("Docx", ["Docx", "Markdown", "Skip"]),
    "Xls": ("Xlsx", ["Xlsx", "Markdown", "Csv", "Tsv", "Skip"]),
    "Ppt": ("Pptx", ["Pptx", "Markdown", "Skip"]),
    "Docx": ("Markdown", ["Markdown", "Copy", "Skip"]),
    "Xlsx": ("Markdown", ["Markdown", "Copy", "Csv", "Tsv", "Skip"]),
    "Pptx": ("Markdown", ["Markdown", "Copy", "Skip"]),
    "Odt": ("Skip", ["Skip"]),
    "Ods": ("Skip", ["Skip"]),
    "Odp": ("Skip", ["Skip"]),
    "Pdf": ("Markdown", ["Markdown", "Copy", "Skip"]),
    "Csv": ("Copy", ["Copy", "Skip"]),
    "Tsv": ("Copy", ["Copy", "Skip"]),
    "Epub": ("Copy", ["Copy", "Skip"]),
    "Image": ("Copy", ["Copy", "Skip"]),
    "Archive": ("Skip", ["Skip"]),
    "Html": ("Copy", ["Copy", "Skip"]),
    "Txt": ("Markdown", ["Markdown", "Copy", "Skip"]),
    "Unknown": ("Skip", ["Skip"]),
}

# --- fixed values: target -> extension (Copy keeps the source extension) ----------------------
TARGET_EXTENSIONS = {
    "Skip": "", "Txt": ".txt", "Markdown": ".md", "Docx": ".docx", "Xlsx": ".xlsx",
    "Pptx": ".pptx", "Pdf": ".pdf", "Csv": ".csv", "Tsv": ".tsv",
}

# --- fixed values: (format, target) -> office application -------------------------------------
ENGINES = [
    ("Doc", "Docx", "Word"),
    ("Xls", "Xlsx", "Excel"),
    ("Xls", "Csv", "Excel"), ("Xls", "Tsv", "Excel"),
    ("Xlsx", "Csv", "Excel"), ("Xlsx", "Tsv", "Excel"),
    ("Ppt", "Pptx", "PowerPoint"),
]

# --- fixed values: formats whose Copy target is a byte copy -----------------------------------
SAFE_COPY_FORMATS = ["Docx", "Xlsx", "Pptx", "Pdf", "Csv", "Tsv", "Epub", "Image", "Html", "Txt"]

# --- fixed values: formats read by the document-to-Markdown worker ----------------------------
DOCUMENT_WORKER_FORMATS = ["Doc", "Docx", "Xls", "Xlsx", "Ppt", "Pptx", "Pdf"]

# Adapters in resolution order; the first one that accepts a (format, target) pair wins.
ROUTES = (
    [(1, "json", "Json", t) for t in ("Txt", "Markdown")]
    + [(2, "copy", f, "Copy") for f in SAFE_COPY_FORMATS]
    + [(3 + ["Word", "Excel", "PowerPoint"].index(e), e.lower(), f, t) for f, t, e in ENGINES]
    + [(6, "text", "Txt", "Markdown")]
    + [(7, "document", f, "Markdown") for f in DOCUMENT_WORKER_FORMATS]
)

# Adapters that need an installed application or worker; the rest are always available.
# The default inventory has the document worker and Excel, but neither Word nor PowerPoint.
AVAILABLE_ADAPTERS = ["json", "copy", "text", "document", "excel"]

# --- fixed values: fact kinds -----------------------------------------------------------------
CONTENT_KINDS = ["TEXT_BLOCK", "HEADING", "LIST_ITEM", "TABLE_CELL"]
EXACT = ["SOURCE_EXACT", "DERIVED_EXACT"]

# --- fixed values: metric -> method, in report order ------------------------------------------
METRICS = [
    ("evaluation_coverage_exact", "source_fact_certainty_coverage"),
    ("text_recall", "unicode_nfc_case_sensitive_token_multiset"),
    ("text_precision", "unicode_nfc_case_sensitive_token_multiset"),
    ("heading_recall", "exact_normalized_text_one_to_one"),
    ("heading_precision", "exact_normalized_text_one_to_one"),
    ("heading_level_accuracy", "matched_heading_exact_level"),
    ("list_item_recall", "exact_normalized_text_one_to_one"),
    ("list_item_precision", "exact_normalized_text_one_to_one"),
    ("list_level_accuracy", "matched_list_item_exact_level"),
    ("table_count_recall", "count_only_v0_2"),
    ("table_count_precision", "count_only_v0_2"),
    ("table_cell_recall", "exact_normalized_text_one_to_one"),
    ("table_cell_precision", "exact_normalized_text_one_to_one"),
    ("table_cell_position_accuracy", "matched_cell_exact_row_column"),
    ("link_target_recall", "canonical_uri_multiset"),
    ("link_target_precision", "canonical_uri_multiset"),
    ("link_anchor_text_recall", "exact_normalized_anchor_text"),
    ("image_reference_count_recall", "count_only_v0_3"),
    ("image_reference_count_precision", "count_only_v0_3"),
    ("output_nonempty", "source_aware_markdown_semantic_fact_presence"),
    ("duplicate_or_extra_content_count", "token_multiset_excess_count"),
    ("content_token_length_ratio", "output_content_tokens/source_content_tokens"),
    ("order_anchor_coverage", "exact_kind_text_anchor"),
    ("pairwise_order_accuracy", "pairwise_relative_order"),
]

# --- fixed values: dimension -> metrics of the experimental mean ------------------------------
EXPERIMENTAL_DIMENSIONS = [
    ("content", ["text_recall", "text_precision"]),
    ("structure", ["heading_recall", "heading_precision", "heading_level_accuracy",
                   "list_item_recall", "list_item_precision", "list_level_accuracy",
                   "table_count_recall", "table_count_precision", "table_cell_recall",
                   "table_cell_precision", "table_cell_position_accuracy", "link_target_recall",
                   "link_anchor_text_recall", "image_reference_count_recall",
                   "image_reference_count_precision"]),
    ("order", ["order_anchor_coverage", "pairwise_order_accuracy"]),
    ("integrity", ["output_nonempty"]),
    ("noise", []),
]

# --- fixed values: (dimension, family, primary metric) ----------------------------------------
SCORE_FAMILIES = [
    ("content", "text", "text_recall"),
    ("structure", "headings", "heading_recall"),
    ("structure", "heading_hierarchy", "heading_level_accuracy"),
    ("structure", "lists", "list_item_recall"),
    ("structure", "list_hierarchy", "list_level_accuracy"),
    ("structure", "tables", "table_cell_recall"),
    ("structure", "table_geometry", "table_cell_position_accuracy"),
    ("structure", "links", "link_target_recall"),
    ("structure", "images", "image_reference_count_recall"),
    ("noise", "extra_content", "text_precision"),
    ("noise", "extra_headings", "heading_precision"),
    ("noise", "extra_lists", "list_item_precision"),
    ("noise", "extra_tables", "table_cell_precision"),
    ("noise", "extra_links", "link_target_precision"),
    ("noise", "extra_images", "image_reference_count_precision"),
    ("order", "reading_order", "pairwise_order_accuracy"),
]
SCORED_DIMENSIONS = ["content", "structure", "order", "noise"]

METHODOLOGY_VERSION = "conversion-score/0.3.0"
TARGET_PROFILE = "markdown-target/0.1"

# --- fixed values: qualification profile per format -------------------------------------------
PROFILE = {
    "txt": ("QUALIFIED_BOUNDED",
            ["text_recall", "text_precision", "duplicate_or_extra_content_count",
             "output_nonempty", "content_token_length_ratio", "pairwise_order_accuracy",
             "order_anchor_coverage", "evaluation_coverage_exact"],
            ["EMPTY_OUTPUT", "EXTRA_OR_DUPLICATED_CONTENT"]),
    "docx": ("QUALIFIED_BOUNDED",
             ["text_recall", "heading_recall", "heading_level_accuracy", "list_item_recall",
              "list_level_accuracy", "table_cell_recall", "table_cell_position_accuracy",
              "pairwise_order_accuracy", "order_anchor_coverage", "output_nonempty",
              "evaluation_coverage_exact"],
             ["EMPTY_OUTPUT", "MISSING_HEADING", "MISSING_LIST_ITEM", "MISSING_TABLE_CELL"]),
    "pptx": ("QUALIFIED_BOUNDED",
             ["text_recall", "heading_recall", "heading_level_accuracy", "list_item_recall",
              "list_level_accuracy", "output_nonempty", "evaluation_coverage_exact"],
             ["EMPTY_OUTPUT", "MISSING_HEADING", "MISSING_LIST_ITEM"]),
    "xlsx": ("QUALIFIED_BOUNDED",
             ["text_recall", "table_cell_recall", "table_cell_position_accuracy",
              "pairwise_order_accuracy", "order_anchor_coverage", "output_nonempty",
              "evaluation_coverage_exact"],
             ["EMPTY_OUTPUT", "MISSING_TABLE_CELL"]),
    "pdf": ("COVERAGE_ONLY", ["evaluation_coverage_exact"], []),
    "html": ("NOT_IN_ROUTE", [], []),
}

# --- fixed values: inspector support by source extension --------------------------------------
INSPECTED_FORMATS = ["txt", "html", "htm", "pdf", "docx", "pptx", "xlsx"]

# --- fixed values: diagnostic code -> message key ---------------------------------------------
ERROR_CODES = [
    ("worksheet_inspection_failure", "WorksheetInspectionFailed"),
    ("worksheet_none", "WorksheetNone"),
    ("worksheet_empty", "WorksheetEmpty"),
    ("worksheet_hidden", "WorksheetHidden"),
    ("excel_sheet_operation_failure", "OperationOfficeFailure"),
    ("unsafe_source", "OperationUnsafeSource"),
    ("unsafe_target", "OperationInvalidTarget"),
    ("target_directory_missing", "OperationInvalidTarget"),
    ("unsafe_target_after_create", "OperationInvalidTarget"),
    ("target_conflict", "OperationTargetExists"),
    ("source_unreadable", "OperationSourceUnreadable"),
    ("output_missing", "OperationOutputMissing"),
    ("output_empty", "OperationOutputInvalid"),
    ("output_extension_invalid", "OperationOutputExtensionInvalid"),
    ("ooxml_structure_invalid", "OperationOutputInvalid"),
    ("pdf_signature_invalid", "OperationOutputInvalid"),
    ("unsupported_output_validation", "OperationOutputInvalid"),
    ("output_unreadable", "OperationOutputInvalid"),
    ("output_invalid_utf8", "OperationOutputInvalid"),
    ("source_changed", "OperationSourceChanged"),
    ("io_failure", "OperationProcessingFailed"),
    ("unexpected_adapter_failure", "OperationProcessingFailed"),
    ("invalid_json", "OperationInvalidJson"),
    ("copy_mapping_unsupported", "OperationCopyUnsupported"),
    ("copy_integrity_mismatch", "OperationOutputInvalid"),
    ("office_mapping_unsupported", "OperationUnsupported"),
    ("markdown_mapping_unsupported", "OperationUnsupported"),
    ("office_application_missing", "OperationOfficeMissing"),
    ("worker_missing", "OperationOfficeComponentUnavailable"),
    ("worker_start_failure", "OperationOfficeComponentUnavailable"),
    ("worker_timeout", "OperationTimeout"),
    ("worker_protocol_failure", "OperationOfficeFailure"),
    ("worker_protocol_invalid", "OperationOfficeFailure"),
    ("worker_result_missing", "OperationOfficeFailure"),
    ("powerpoint_already_running", "OperationPowerPointRunning"),
    ("powerpoint_session_ownership_lost", "OperationPowerPointProtected"),
    ("office_com_failure", "OperationOfficeFailure"),
    ("legacy_ppt_table_semantics_partial", "LegacyPptTableSemanticsPartial"),
    ("scanned_pdf_unsupported", "ScannedPdfUnsupported"),
    ("pdf_specialist_required", "ScannedPdfUnsupported"),
    ("intermediate_output_missing", "OperationOutputMissing"),
    ("intermediate_file_invalid", "OperationOutputInvalid"),
    ("document_encrypted", "DocumentEncrypted"),
    ("resource_limit", "DocumentResourceLimit"),
    ("malformed_document", "MalformedDocument"),
    ("read_error", "DocumentReadError"),
    ("asset_export_error", "AssetExportError"),
    ("text_encoding_unsupported", "TextEncodingUnsupported"),
    ("companion_assets_invalid", "CompanionAssetsInvalid"),
    ("unsupported_format", "DocumentUnsupportedFormat"),
    ("source_not_found", "DocumentSourceNotFound"),
    ("write_error", "DocumentWriteError"),
]

# --- fixed values: known messages -> message key ----------------------------------------------
MESSAGES = [
    ("The document is password-protected or encrypted.", "DocumentEncrypted"),
    ("Resource limit exceeded while processing document.", "DocumentResourceLimit"),
    ("Document structure is corrupted or invalid.", "MalformedDocument"),
    ("Failed to read document contents.", "DocumentReadError"),
    ("Failed to export embedded document assets.", "AssetExportError"),
    ("Text file encoding is not supported.", "TextEncodingUnsupported"),
    ("Result companion assets failed validation.", "CompanionAssetsInvalid"),
    ("Source document was not found.", "DocumentSourceNotFound"),
    ("Failed to write Markdown result file.", "DocumentWriteError"),
]

# --- fixed values: status -> fallback message key ---------------------------------------------
STATUS_KEYS = [
    ("Failed", "OperationProcessingFailed"),
    ("Conflict", "OperationTargetExists"),
    ("Unsupported", "OperationUnsupported"),
    ("EngineUnavailable", "OperationUnavailable"),
    ("Skipped", "OperationSkipped"),
    ("Cancelled", "OperationCancelled"),
    ("NotProcessed", "OperationNotProcessed"),
    ("Succeeded", "StatusConverted"),
]

# --- fixed values: converter failure kind -> stable code --------------------------------------
CONVERT_ERRORS = [
    ("Unsupported", "unsupported_format"),
    ("NeedsOcr", "pdf_specialist_required"),
    ("Malformed", "malformed_document"),
    ("Encrypted", "document_encrypted"),
    ("ResourceLimit", "resource_limit"),
    ("MissingPart", "malformed_document"),
    ("Io", "read_error"),
]

# --- fixed values: sort rank of an operation status -------------------------------------------
STATUS_RANK = ["Ready", "Converting", "Succeeded", "Skipped", "Conflict", "EngineUnavailable",
               "Unsupported", "Failed", "Cancelled"]

# --- fixed values: reserved device names ------------------------------------------------------
RESERVED_NAMES = (["CON", "PRN", "AUX", "NUL"]
                  + ["COM%d" % i for i in range(1, 10)] + ["LPT%d" % i for i in range(1, 10)])

# --- fixed values: assets -----------------------------------------------------------------------
COMPANION_EXTENSIONS = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff"]
IMAGE_MIME_EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg",
                         "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp",
                         "image/tiff": "tiff"}

RULES = [
    (i, f, FAMILIES[f], CAPABILITIES[f][0], CAPABILITIES[f][1]) for i, f in enumerate(FORMATS)
]
PROFILE_RULES = (
    [(f, "metric", m) for f, (_, ms, _) in PROFILE.items() for m in ms]
    + [(f, "finding", c) for f, (_, _, cs) in PROFILE.items() for c in cs]
)

# Every table below has a constant row count, hence the broadcast.
TABLES = {
    "extensions": ("extension string, format string", EXTENSIONS),
    "capabilities": ("ordinal int, format string, family string, default_target string, "
                     "allowed array<string>", RULES),
    "engines": ("format string, target string, engine string", ENGINES),
    "routes": ("priority int, adapter string, format string, target string", ROUTES),
    "target_extensions": ("target string, target_extension string",
                          list(TARGET_EXTENSIONS.items())),
    "metric_methods": ("ordinal int, name string, method string",
                       [(i, n, m) for i, (n, m) in enumerate(METRICS)]),
    "metric_dimensions": ("dimension string, name string",
                          [(d, m) for d, ms in EXPERIMENTAL_DIMENSIONS for m in ms]),
    "score_families": ("ordinal int, dimension string, family string, primary_metric string",
                       [(i, *f) for i, f in enumerate(SCORE_FAMILIES)]),
    "profile_status": ("format string, qualification_status string",
                       [(f, s) for f, (s, _, _) in PROFILE.items()]),
    "profile_rules": ("format string, rule_type string, rule_name string", PROFILE_RULES),
    "error_codes": ("code string, message_key string", ERROR_CODES),
    "messages": ("message string, message_key string", MESSAGES),
    "status_keys": ("status string, message_key string", STATUS_KEYS),
    "convert_errors": ("failure string, error_code string", CONVERT_ERRORS),
    "image_types": ("media_type string, extension string", list(IMAGE_MIME_EXTENSIONS.items())),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    """One of the constant tables above, ready for a broadcast join."""
    schema, rows = TABLES[name]
    return F.broadcast(spark.createDataFrame(rows, schema))
