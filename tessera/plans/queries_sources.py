"""Queries on sources: text decoding, output validation, requests, office packages."""
from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..operators import ooxml_facts as of
from ..sources.files import decode_strict, transcode_utf16_utf8
from ..sources.ooxml import ooxml_parts
from . import packages as pk
from . import views
from .oracle import split
from .registry import register


def contents(spark, sf_dir):
    """Documents as bytes: UTF-8 with and without mark, UTF-16 of both orders, broken UTF-8."""
    d = views.table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("path"), F.expr("""CASE doc_id % 5 WHEN 0 THEN encode(text, 'UTF-8') WHEN 1 THEN concat(X'EFBBBF', encode(text, 'UTF-8'))
        WHEN 2 THEN concat(X'FFFE', encode(text, 'UTF-16LE')) WHEN 3 THEN concat(X'FEFF', encode(text, 'UTF-16BE')) ELSE concat(encode(text, 'UTF-8'), X'FF') END""").alias("content"))


@register("read_text_strict", "SELECT doc_id::VARCHAR AS path, CASE WHEN doc_id % 5 < 4 THEN text END AS text, CASE WHEN doc_id % 5 = 4 THEN 'text_encoding_unsupported' END AS error_code FROM documents")
def _(spark, sf_dir):
    return decode_strict(contents(spark, sf_dir))


@register("transcode_utf16_utf8", "SELECT doc_id::VARCHAR AS path, sha256(text) AS sha256, strlen(text)::BIGINT AS size_bytes FROM documents")
def _(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    wide = d.select(F.col("doc_id").cast("string").alias("path"), F.expr("concat(X'FFFE', encode(text, 'UTF-16LE'))").alias("content"))
    return transcode_utf16_utf8(wide).select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("bigint").alias("size_bytes"))


@register("validate_output", """SELECT doc_id::VARCHAR AS path, code AS error_code, code IS NULL AS valid FROM (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'output_invalid_utf8' WHEN 2 THEN 'output_empty'
  WHEN 3 THEN CASE WHEN n_chars % 2 = 0 THEN NULL ELSE 'ooxml_structure_invalid' END WHEN 4 THEN 'pdf_signature_invalid' WHEN 5 THEN NULL WHEN 6 THEN 'output_missing' ELSE 'unsupported_output_validation' END AS code FROM documents)""")
def _(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return inv.validate_output(d.select(
        F.col("doc_id").cast("string").alias("path"),
        views.pick(["Markdown", "Markdown", "Markdown", "Docx", "Pdf", "Pdf", "Txt", "Other"], F.col("doc_id") % 8).alias("target"),
        F.expr("""CASE doc_id % 8 WHEN 1 THEN concat(encode(text, 'UTF-8'), X'FF') WHEN 2 THEN encode(' \\n', 'UTF-8') WHEN 5 THEN encode(concat('%PDF-', text), 'UTF-8')
                  WHEN 6 THEN NULL ELSE encode(text, 'UTF-8') END""").alias("content"),
        F.col("n_chars").alias("source_length"),
        F.expr("CASE WHEN n_chars % 2 = 0 THEN array('[Content_Types].xml', 'Word/document.xml') ELSE array('word/document.xml') END").alias("parts")))


def parts(spark, sf_dir, build):
    d = views.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return ooxml_parts(pk.packages(d.repartition("path"), build))


@register("ooxml_parts", """SELECT doc_id::VARCHAR AS path, unnest(['word/_rels/document.xml.rels', 'word/document.xml', 'word/numbering.xml', 'word/styles.xml']) AS part FROM documents""")
def _(spark, sf_dir):
    return parts(spark, sf_dir, pk.word_package).filter("node = 'part'").select("path", "part")


def facts(df):
    attr = lambda k: F.element_at("attributes", k)
    return df.select("doc_id", "fact_id", "kind", "text", "ord", "certainty", attr("level").alias("level"), attr("row").alias("row_no"), attr("column").alias("col_no"),
                     F.coalesce(attr("target"), attr("partUri")).alias("target"),
                     F.element_at("property_certainty", "text").alias("text_certainty"), F.element_at("property_certainty", "order").alias("order_certainty"))


_LINES = f"(SELECT doc_id::VARCHAR AS doc_id, unnest(l) AS t, unnest(range(len(l))) AS i, len(l) AS n FROM (SELECT doc_id, {split('text')} AS l FROM documents))"


_CELLS = f"""(SELECT doc_id, i, unnest(range(len(v))) AS c, unnest(v) AS text FROM (
  SELECT doc_id, i, [i::VARCHAR, t, length(t)::VARCHAR] || CASE WHEN i = 0 THEN ['2', 'TRUE', '#N/A', 'in', '0.5'] ELSE [] END AS v FROM {_LINES}))"""


@register("docx_facts", f"""SELECT doc_id, CASE WHEN i = 0 THEN 'heading:' WHEN i % 3 = 2 THEN 'list-item:' ELSE 'text-block:' END || (i + 1) AS fact_id,
  CASE WHEN i = 0 THEN 'HEADING' WHEN i % 3 = 2 THEN 'LIST_ITEM' ELSE 'TEXT_BLOCK' END AS kind, t AS text, i AS ord, CASE WHEN i = 0 OR i % 3 = 2 THEN 'DERIVED_EXACT' ELSE 'SOURCE_EXACT' END AS certainty,
  CASE WHEN i = 0 OR i % 3 = 2 THEN '1' END AS level, NULL AS row_no, NULL AS col_no, NULL AS target, NULL AS text_certainty, NULL AS order_certainty FROM {_LINES}
UNION ALL SELECT doc_id, CASE k WHEN 0 THEN 'heading:' || (n + 1) WHEN 1 THEN 'table:1' WHEN 2 THEN 'table:1:cell:0:0' WHEN 3 THEN 'table:1:cell:0:2' WHEN 4 THEN 'link:1' WHEN 5 THEN 'text-block:' || (n + 6) ELSE 'image:1' END,
  ['HEADING', 'TABLE', 'TABLE_CELL', 'TABLE_CELL', 'LINK', 'TEXT_BLOCK', 'IMAGE'][k + 1], ['Outlined', NULL, 'wide', 'go', 'go', '', NULL][k + 1], n + k, 'SOURCE_EXACT', CASE k WHEN 0 THEN '2' END,
  CASE WHEN k IN (2, 3) THEN '0' END, CASE k WHEN 2 THEN '0' WHEN 3 THEN '2' END, CASE k WHEN 4 THEN 'https://example.org/go' WHEN 6 THEN 'media/image1.png' END, NULL, NULL
FROM (SELECT DISTINCT doc_id, n, unnest(range(7)) AS k FROM {_LINES})""")
def _(spark, sf_dir):
    return facts(of.docx_facts(parts(spark, sf_dir, pk.word_package)))


@register("pptx_facts", f"""SELECT doc_id, CASE WHEN k = 0 THEN 'heading:' ELSE 'list:' END || (o + 1) AS fact_id, CASE WHEN k = 0 THEN 'HEADING' ELSE 'LIST_ITEM' END AS kind, text, o AS ord,
  CASE WHEN k = 0 THEN 'DERIVED_EXACT' ELSE 'SOURCE_EXACT' END AS certainty, '1' AS level, NULL AS row_no, NULL AS col_no, NULL AS target, NULL AS text_certainty, 'UNAVAILABLE' AS order_certainty
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS o FROM (SELECT doc_id, i, unnest([0, 1]) AS k, unnest([string_split(t, ' ')[1], t]) AS text FROM {_LINES}) WHERE trim(text) <> '')""")
def _(spark, sf_dir):
    return facts(of.pptx_facts(parts(spark, sf_dir, pk.slide_package)))


@register("xlsx_facts", f"""SELECT doc_id, 'table:1:cell:' || i || ':' || c AS fact_id, 'TABLE_CELL' AS kind, text, i * 3 + c + 1 + CASE WHEN i > 0 THEN 5 ELSE 0 END AS ord, 'SOURCE_EXACT' AS certainty, NULL AS level, i::VARCHAR AS row_no, c::VARCHAR AS col_no, NULL AS target,
  ['DERIVED_EXACT', 'SOURCE_EXACT', 'INFERRED', 'INFERRED', 'DERIVED_EXACT', 'SOURCE_EXACT', 'SOURCE_EXACT', 'INFERRED'][c + 1] AS text_certainty, 'SOURCE_EXACT' AS order_certainty FROM {_CELLS}
UNION ALL SELECT doc_id::VARCHAR, 'table:1', 'TABLE', NULL, 0, 'SOURCE_EXACT', NULL, NULL, NULL, NULL, NULL, NULL FROM documents""")
def _(spark, sf_dir):
    return facts(of.xlsx_facts(parts(spark, sf_dir, pk.sheet_package)))


@register("xlsx_value_semantics", f"SELECT doc_id, i::VARCHAR AS row_no, c::VARCHAR AS col_no, ['displayed-general-integer', 'displayed-string', 'displayed-formatted-numeric-unverified', 'cached-formula-display-unverified', 'displayed-boolean', 'displayed-error', 'displayed-string', 'displayed-general-numeric-unverified'][c + 1] AS semantics FROM {_CELLS}")
def _(spark, sf_dir):
    a = lambda k: F.element_at("attributes", k)
    cells = of.xlsx_facts(parts(spark, sf_dir, pk.sheet_package)).filter("kind = 'TABLE_CELL'")
    return cells.select("doc_id", a("row").alias("row_no"), a("column").alias("col_no"), a("valueSemantics").alias("semantics"))
