"""Typed facts of plain text, HTML, extracted page text and Markdown.

Every function takes one row per document and returns one row per fact. The rows of a document
are kept together by a single exchange of the raw text, see ``session.by_document``.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import html
from ..functions.text import collapse_ws, unix_newlines
from .html_tree import page_nodes
from .numbering import number_in_group

def no_map() -> Column:
    return F.lit(None).cast("map<string,string>")


def source_rows(df: DataFrame, certainty: str, attributes: Column = None) -> DataFrame:
    """Bring fact columns into the common source-fact schema."""
    return df.select(
        "doc_id", "fact_id", "kind", "text", F.col("ord").cast("bigint").alias("ord"), "location",
        F.lit(certainty).alias("certainty"),
        (no_map() if attributes is None else attributes).alias("attributes"),
        no_map().alias("property_certainty"))


def txt_facts(docs: DataFrame) -> DataFrame:
    """One exact TEXT_BLOCK per non-empty line of ``docs(doc_id, text)``; no exchange at all."""
    lines = F.transform(F.split(unix_newlines(F.col("text")), "\n"),
                        lambda t, i: F.struct((i + 1).alias("line"), t.alias("text")))
    kept = F.filter(lines, lambda s: F.length(s["text"]) > 0)
    rows = docs.select("doc_id", F.posexplode(kept).alias("ord", "f")).select(
        "doc_id", "ord", "f.line", "f.text",
        F.concat(F.lit("line:"), F.col("f.line")).alias("fact_id"),
        F.lit("TEXT_BLOCK").alias("kind"),
        F.concat(F.lit("txt/line["), F.col("f.line"), F.lit("]")).alias("location"))
    return source_rows(rows, "SOURCE_EXACT",
                       F.create_map(F.lit("line"), F.col("line").cast("string")))


def page_text_facts(pages: DataFrame) -> DataFrame:
    """One inferred TEXT_BLOCK per non-empty page of ``pages(doc_id, page, text)``."""
    rows = pages.select("doc_id", "page", collapse_ws(F.col("text")).alias("text")).filter("text <> ''")
    rows = number_in_group(rows, ["doc_id"], "page", "ord").select(
        "doc_id", "ord", "page", "text",
        F.concat(F.lit("text:"), F.col("ord") + 1).alias("fact_id"),
        F.lit("TEXT_BLOCK").alias("kind"),
        F.concat(F.lit("pdf/page["), F.col("page"), F.lit("]")).alias("location"))
    return source_rows(rows, "INFERRED", F.create_map(
        F.lit("page"), F.col("page").cast("string"), F.lit("extraction"), F.lit("content-order")))


HEADING_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6"]


def html_facts(pages: DataFrame) -> DataFrame:
    """Headings, paragraphs, list items, tables, cells, links and images of ``pages(doc_id, html)``.

    The element tree gives every text the elements it belongs to; what an element says is put
    together by one grouping.
    """
    tokens, nodes = page_nodes(F.col("html"))
    rows = pages.select("doc_id", tokens.alias("tokens"), nodes.alias("nodes"))
    named = F.transform("nodes", lambda n: F.struct(n.alias("n"), F.element_at("tokens", n["tok"] + 1).alias("token")))
    rows = rows.select("doc_id", F.explode(named).alias("x")).select("doc_id", "x.n.*", "x.token")
    tag, token = F.col("tag"), F.col("token")
    kind = (F.when(tag.isin(HEADING_TAGS) & (F.col("inside") == 0), "HEADING")
            .when((tag == "p") & (F.col("inside") == 0), "TEXT_BLOCK")
            .when((tag == "li") & (F.col("inside") < 2), "LIST_ITEM")
            .when(tag == "table", "TABLE").when(tag.isin("td", "th"), "TABLE_CELL")
            .when(tag == "a", "LINK").when(tag == "img", "IMAGE"))
    rows = rows.withColumn("kind", kind)
    target = (F.when(F.col("kind") == "LINK", html.attribute(token, "href")).when(F.col("kind") == "IMAGE", html.attribute(token, "src")))
    rows = rows.withColumn("target", target).filter(tag.isNull() | (F.col("kind").isNotNull() & (~F.col("kind").isin("LINK", "IMAGE") | F.col("target").isNotNull())))
    alt = F.when(F.col("kind") == "IMAGE", html.attribute(token, "alt"))
    meta = F.when(tag.isNotNull(), F.struct("kind", "tag", "tok", F.col("row"), F.col("col").alias("column"), "level", "tbl", F.col("n_rows").alias("rows"),
                                            F.col("n_cols").alias("columns"), "target", alt.alias("alt")))
    script = token.rlike(r"(?is)^<(script|style)\b")
    piece = F.when(script, F.regexp_extract(token, r"(?is)^<[a-z]+[^>]*>(.*)</", 1)).otherwise(html.decode_entities(token))
    said = F.when(tag.isNull(), F.struct(F.col("id").alias("run"), F.col("tok").alias("at"), piece.alias("piece")))
    owners = F.when(tag.isNull(), F.col("owners")).otherwise(F.array("id"))
    rows = rows.select("doc_id", owners.alias("owners"), meta.alias("meta"), said.alias("said"))
    grouped = (rows.select("doc_id", F.explode("owners").alias("owner"), "meta", "said")
               .groupBy("doc_id", "owner").agg(F.max("meta").alias("m"), F.sort_array(F.collect_list("said")).alias("said"))
               .filter(F.col("m").isNotNull()))
    # Items and cells join their texts by a space, the rest is plain text content.
    whole = F.array_join(F.transform("said", lambda x: x["piece"]), "")
    apart = F.array_join(F.transform("said", lambda x, i: F.when(
        (i > 0) & (x["run"] != F.element_at("said", F.greatest(i, F.lit(1)))["run"]), F.concat(F.lit(" "), x["piece"])).otherwise(x["piece"])), "")
    text = (F.when(F.col("m.kind").isin("LIST_ITEM", "TABLE_CELL"), collapse_ws(apart))
            .when(F.col("m.kind").isin("HEADING", "TEXT_BLOCK", "LINK"), collapse_ws(whole))
            .when(F.col("m.kind") == "IMAGE", F.col("m.alt")))
    facts = grouped.select("doc_id", "owner", "m.*", text.alias("text"))
    facts = facts.filter((F.col("text") != "") | ~F.col("kind").isin("HEADING", "TEXT_BLOCK", "LIST_ITEM"))
    # Cells follow their table at once; links inside them keep their own place.
    place = [F.when(F.col("kind") == "TABLE_CELL", F.col("tbl")).otherwise(F.col("owner")),
             (F.col("kind") == "TABLE_CELL").cast("int"), F.col("owner")]
    order = W.partitionBy("doc_id").orderBy(*place)
    facts = facts.select(
        "*", (F.row_number().over(order) - 1).alias("ord"),
        F.sum((F.col("kind") == "TABLE").cast("int")).over(
            order.rowsBetween(W.unboundedPreceding, 0)).alias("table_no"))
    number = (F.col("ord") + 1).cast("string")
    table_id = F.concat(F.lit("table:"), F.col("table_no"))
    fact_id = (F.when(F.col("kind") == "HEADING", F.concat(F.lit("heading:"), number))
               .when(F.col("kind") == "TEXT_BLOCK", F.concat(F.lit("text:"), number))
               .when(F.col("kind") == "LIST_ITEM", F.concat(F.lit("list:"), number))
               .when(F.col("kind") == "TABLE", table_id)
               .when(F.col("kind") == "TABLE_CELL",
                     F.concat_ws(":", table_id, F.lit("cell"), F.col("row"), F.col("column")))
               .when(F.col("kind") == "LINK", F.concat(F.lit("link:"), number))
               .otherwise(F.concat(F.lit("image:"), number)))
    s = lambda c: F.col(c).cast("string")
    attributes = (
        F.when(F.col("kind") == "HEADING", F.create_map(F.lit("level"), F.substring("tag", 2, 1)))
        .when(F.col("kind") == "LIST_ITEM", F.create_map(F.lit("level"), s("level")))
        .when(F.col("kind") == "TABLE", F.create_map(
            F.lit("rows"), F.coalesce(s("rows"), F.lit("0")),
            F.lit("columns"), F.coalesce(s("columns"), F.lit("0"))))
        .when(F.col("kind") == "TABLE_CELL", F.create_map(
            F.lit("tableId"), table_id, F.lit("row"), s("row"), F.lit("column"), s("column")))
        .when(F.col("kind") == "LINK", F.create_map(F.lit("target"), F.col("target")))
        .when(F.col("kind") == "IMAGE", F.create_map(F.lit("source"), F.col("target"))))
    rows = facts.select("doc_id", fact_id.alias("fact_id"), "kind", "text", "ord",
                        F.concat(F.lit("html/"), F.col("tag"), F.lit("["), F.col("tok"), F.lit("]"))
                        .alias("location"), attributes.alias("attributes"))
    return source_rows(rows, "SOURCE_EXACT", F.col("attributes"))
