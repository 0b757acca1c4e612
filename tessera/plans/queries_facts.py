"""Queries on facts: extraction per source, Markdown outputs, statuses, scalar fact functions."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url
from ..operators import match
from ..operators.facts import page_text_facts, txt_facts
from ..sources.ooxml import ooxml_parts, source_status
from . import dims, views
from . import packages as pk
from .oracle import collapse, lit, norm, query, tokens, unix, uri
from .registry import register

SOURCE_COLS = "doc_id, fact_id, kind, text, ord, location, certainty, level, row_no, col_no, target"
OUTPUT_COLS = "doc_id, arm, fact_id, kind, text, ord, location, level, row_no, col_no, target, n_rows, n_cols"


def flat(facts: DataFrame, *extra: str) -> DataFrame:
    """Facts with the attributes that matter as columns."""
    attr = lambda k, name: F.element_at("attributes", k).alias(name)
    keep = [c for c in facts.columns if c not in ("attributes", "property_certainty")]
    return facts.select(*keep, attr("level", "level"), attr("row", "row_no"), attr("column", "col_no"),
                        attr("target", "target"), *[attr(k, n) for k, n in (("rows", "n_rows"), ("columns", "n_cols")) if n in extra])


@register("txt_facts", query("txt_s", f"SELECT {SOURCE_COLS} FROM txt_s"))
def q_txt_facts(spark, sf_dir):
    return flat(txt_facts(views.txt_corpus(spark, sf_dir)))


@register("html_facts", query("html_s", f"SELECT {SOURCE_COLS} FROM html_s"))
def q_html_facts(spark, sf_dir):
    return flat(views.html_source_facts(spark, sf_dir))


@register("page_text_facts", f"""
SELECT conv_id AS doc_id, 'text:' || (ord + 1) AS fact_id, 'TEXT_BLOCK' AS kind, text, ord, 'pdf/page[' || turn || ']' AS location,
  'INFERRED' AS certainty, NULL AS level, NULL AS row_no, NULL AS col_no, NULL AS target
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord
      FROM (SELECT conv_id, turn, {collapse('text')} AS text FROM conversations) WHERE text <> '')""")
def q_page_text_facts(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return flat(page_text_facts(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")))


@register("sheet_facts", query("xlsx_s", "SELECT doc_id, fact_id, kind, text, ord, text_certainty, row_no, col_no, n_rows FROM xlsx_s"))
def q_sheet_facts(spark, sf_dir):
    f = views.sheet_facts(spark, sf_dir)
    a = lambda k: F.element_at("attributes", k)
    return f.select("doc_id", "fact_id", "kind", "text", "ord", F.element_at("property_certainty", "text").alias("text_certainty"),
                    a("row").alias("row_no"), a("column").alias("col_no"), a("rows").alias("n_rows"))


@register("markdown_facts", query("out_facts", f"SELECT {OUTPUT_COLS} FROM out_facts"))
def q_markdown_facts(spark, sf_dir):
    return flat(views.output_facts(spark, sf_dir), "n_rows", "n_cols")


# What was written, not how it reads: the twin knows every link from the page it came from.
WRITTEN_LINKS = f"""
SELECT doc_id, n, style, CASE style WHEN 0 THEN text WHEN 1 THEN text || ' ' || n WHEN 2 THEN n || ' ' || text ELSE bare END AS text,
  CASE style WHEN 3 THEN bare ELSE target END AS target, CASE style WHEN 0 THEN 'late ' || n WHEN 1 THEN 'early' END AS title
FROM (SELECT doc_id, n, n % 4 AS style, text, target, regexp_replace({lit(views.SITE)} || target, '[?!.,:]$', '') AS bare,
        regexp_extract({lit(views.SITE)} || target, '[?!.,:]$') AS cut
      FROM (SELECT doc_id, text, target, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS n FROM html_s WHERE kind = 'LINK'))"""


@register("markdown_references", query("html_s", f"""
SELECT doc_id, 2 * n AS ord, 'TEXT_BLOCK' AS kind, CASE style WHEN 3 THEN 'see ' || {lit(views.SITE)} || raw || ' ok' ELSE text END AS text, NULL AS target, NULL AS title
FROM (SELECT w.*, l.target AS raw FROM ({WRITTEN_LINKS}) w JOIN (
  SELECT doc_id, target, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS n FROM html_s WHERE kind = 'LINK') l USING (doc_id, n))
UNION ALL SELECT doc_id, 2 * n + 1, 'LINK', text, target, title FROM ({WRITTEN_LINKS})"""))
def q_markdown_references(spark, sf_dir):
    """Reference links and bare links of whole pages, resolved."""
    f = views.reference_facts(spark, sf_dir)
    a = lambda k: F.element_at("attributes", k).alias(k)
    return f.select("doc_id", "ord", "kind", "text", a("target"), a("title"))


@register("controlled_mutations", query("arms", "SELECT doc_id, format, arm, markdown, expected_code FROM arms"))
def q_controlled_mutations(spark, sf_dir):
    return views.arms(spark, sf_dir)


@register("txt_to_markdown", f"SELECT doc_id, {unix('text')} AS markdown FROM documents")
def q_txt_to_markdown(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.unix_newlines(F.col("text")).alias("markdown"))


@register("normalize_text", f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def q_normalize_text(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("norm"))


@register("tokenize", f"""
SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos FROM (SELECT doc_id, {tokens(norm('text'))} AS t FROM documents)""")
def q_tokenize(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("norm"))
    return d.select("doc_id", F.posexplode(tx.tokens(F.col("norm"))).alias("pos", "token")).withColumn("pos", F.col("pos").cast("bigint"))


@register("canonical_uri", f"SELECT page_id, {uri('url')} AS uri FROM pages")
def q_canonical_uri(spark, sf_dir):
    """Addresses of the pages, written with dot segments that lead nowhere."""
    p = views.table(spark, sf_dir, "pages")
    dotted = F.regexp_replace("url", "^([A-Za-z]+://[^/]+)/", "$1/x/.././y/z/../../")
    return p.select("page_id", url.canonical_uri(dotted).alias("uri"))


@register("fact_is_exact", query("src_facts", """
SELECT doc_id, fact_id, coalesce(text_certainty, certainty) IN ('SOURCE_EXACT', 'DERIVED_EXACT') AS text_exact,
  certainty IN ('SOURCE_EXACT', 'DERIVED_EXACT') AS order_exact FROM src_facts"""))
def q_fact_is_exact(spark, sf_dir):
    return views.source_facts(spark, sf_dir).select(
        "doc_id", "fact_id", match.fact_is_exact("text").alias("text_exact"), match.fact_is_exact("order").alias("order_exact"))


@register("has_attributes", query("src_facts", """
SELECT doc_id, fact_id, coalesce(trim(level), '') <> '' AS has_level, row_no IS NOT NULL AND col_no IS NOT NULL AS has_position FROM src_facts"""))
def q_has_attributes(spark, sf_dir):
    a = F.col("attributes")
    return views.source_facts(spark, sf_dir).select(
        "doc_id", "fact_id", match.has_attributes(a, ["level"]).alias("has_level"),
        match.has_attributes(a, ["row", "column"]).alias("has_position"))


@register("evaluation_status", query("files", f"""
SELECT relative_path, source_status, markdown_status,
  CASE WHEN source_status <> 'EVALUATED' THEN source_status WHEN markdown_status <> 'EVALUATED' THEN markdown_status ELSE 'EVALUATED' END AS comparison_status
FROM (SELECT f.relative_path, CASE WHEN lower(regexp_extract(f.relative_path, '\\.([^./]*)$', 1)) NOT IN ({", ".join(lit(x) for x in dims.INSPECTED_FORMATS)})
          THEN 'NOT_EVALUATED_SOURCE_UNSUPPORTED' WHEN size_bytes < 200 AND ends_with(lower(f.relative_path), 'x') THEN 'NOT_EVALUATED_SOURCE_INVALID' ELSE 'EVALUATED' END AS source_status,
        CASE WHEN starts_with(f.relative_path, 'web/') THEN 'NOT_EVALUATED_OUTPUT_UNSUPPORTED' ELSE 'EVALUATED' END AS markdown_status FROM files f)"""))
def q_evaluation_status(spark, sf_dir):
    """Unsupported formats stay in the result; office files are opened, and those cut short are invalid."""
    f = views.files(spark, sf_dir)
    office = views.named_documents(spark, sf_dir).filter(F.lower("relative_path").rlike("(?:docx|xlsx|pptx)$"))
    texts = office.select(F.col("relative_path").alias("path"), "text", (F.octet_length("text") < 200).alias("cut"))
    made = pk.packages(texts.repartition("path"), pk.word_package).join(texts.select("path", "cut"), "path")
    content = F.when(F.col("cut"), F.expr("substring(content, 1, cast(length(content) / 2 as int))")).otherwise(F.col("content"))
    opened = source_status(ooxml_parts(made.select("path", content.alias("content")))).select(F.col("path").alias("relative_path"), (F.col("status") == "EVALUATED").alias("opened"))
    staged = f.join(opened, "relative_path", "left").select(
        "relative_path", F.lower(F.regexp_extract("relative_path", r"\.([^./]*)$", 1)).alias("extension"),
        F.coalesce("opened", F.lit(True)).alias("readable"),
        F.when(F.col("relative_path").startswith("web/"), "html").otherwise("md").alias("output_extension"))
    return evaluation_status(staged)


def evaluation_status(staged: DataFrame) -> DataFrame:
    """Stage statuses from source extension, readability and output extension."""
    source = (F.when(~F.col("extension").isin(dims.INSPECTED_FORMATS), "NOT_EVALUATED_SOURCE_UNSUPPORTED")
              .when(~F.col("readable"), "NOT_EVALUATED_SOURCE_INVALID").otherwise("EVALUATED"))
    output = F.when(F.lower("output_extension").isin("md", "markdown"), "EVALUATED").otherwise("NOT_EVALUATED_OUTPUT_UNSUPPORTED")
    rows = staged.select("relative_path", source.alias("source_status"), output.alias("markdown_status"))
    return rows.withColumn("comparison_status", F.expr(
        "CASE WHEN source_status <> 'EVALUATED' THEN source_status ELSE markdown_status END"))
