"""Source facts of word, slide and sheet packages: joins over the part tables."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ooxml import cell_column_index, cell_row_index, value_semantics
from ..sources import ooxml as ox

NO_CERTAINTY = "CAST(NULL AS MAP<STRING, STRING>)"


def _attributes(**columns: Column) -> Column:
    pairs = [c for k, v in columns.items() for c in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())


def _heading_number(text: Column) -> Column:
    digit = F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^heading\s*([1-9])$", 1)
    return F.when(digit != "", digit.cast("int"))


def resolved_styles(parts: DataFrame) -> DataFrame:
    """(path, _style, name, style_outline, num, owner): numbering of every style, own or inherited.

    The based-on chain is walked once for each style, over the style map of its package, as many steps
    as that has styles.
    """
    styles = ox.kind_of(parts, "style").withColumn("key", F.lower("style"))
    styles = styles.groupBy("path", "key").agg(*[F.first(c).alias(c) for c in ("name", "outline", "num_id", "based_on")])
    entry = F.struct("key", F.struct("name", "outline", "num_id", F.lower("based_on").alias("based_on")))
    book = styles.filter("key IS NOT NULL").groupBy("path").agg(F.map_from_entries(F.collect_list(entry)).alias("book"))
    none = F.lit(None).cast("string")

    def walk(key):
        def step(state, _):
            here = F.try_element_at("book", state["at"])
            return F.when(state["num"].isNotNull() | here.isNull(), state).otherwise(
                F.struct(here["based_on"].alias("at"), here["num_id"].alias("num"), F.when(here["num_id"].isNotNull(), state["at"]).alias("owner")))
        return F.aggregate(F.sequence(F.lit(1), F.size("book")), F.struct(key.alias("at"), none.alias("num"), none.alias("owner")), step)

    each = F.transform(F.map_keys("book"), lambda k: F.struct(k.alias("key"), F.element_at("book", k).alias("own"), walk(k).alias("walk")))
    rows = book.select("path", F.explode(each).alias("s"))
    return rows.select("path", F.col("s.key").alias("_style"), F.col("s.own.name").alias("name"), F.col("s.own.outline").alias("style_outline"),
                       F.col("s.walk.num").alias("num"), F.col("s.walk.owner").alias("owner"))


def docx_facts(parts: DataFrame) -> DataFrame:
    """Headings, list items, text, tables, cells, links and images of word packages.

    A paragraph's numbering may come from its style or from the styles that one is based on.
    """
    body = ox.kind_of(parts, "p", "tbl", "tc", "link", "image")
    rows = body.withColumn("_style", F.lower("style")).join(resolved_styles(parts), ["path", "_style"], "left")
    rows = rows.withColumn("number", F.coalesce("num_id", "num"))
    # The level of a style-driven list is the first one tied to the applied or the numbering style.
    levels = ox.kind_of(parts, "level").select("path", F.col("num_id").alias("number"), "pos", F.lower("style").alias("_ls"), F.col("ilvl").alias("_lv"))
    tied = rows.filter("node = 'p' AND number IS NOT NULL").select("path", "ord", "number", "_style", F.col("owner").alias("_owner"), "num_id").join(
        levels, ["path", "number"]).filter("_ls = _style OR (num_id IS NULL AND _ls = _owner)")
    tied = tied.groupBy("path", "ord").agg(F.min_by("_lv", "pos").alias("style_level"))
    rows = rows.join(tied, ["path", "ord"], "left")
    source = F.when(F.col("num_id").isNotNull(), "paragraph").otherwise(F.concat(F.lit("style:"), F.col("owner")))
    level = (F.when(F.col("outline").isNotNull(), F.col("outline").try_cast("int") + 1)
             .when(F.col("style_outline").isNotNull(), F.col("style_outline").try_cast("int") + 1)
             .otherwise(F.coalesce(_heading_number(F.col("style")), _heading_number(F.col("name")))))
    rows = rows.withColumn("numbering_source", source).withColumn("heading", F.when(F.col("node") == "p", level))
    listed = (F.col("node") == "p") & F.col("heading").isNull() & F.col("number").isNotNull() & (F.col("number") != "0")
    kind = (F.when(F.col("heading").isNotNull(), "HEADING").when(listed, "LIST_ITEM").when(F.col("node") == "p", "TEXT_BLOCK")
            .when(F.col("node") == "tbl", "TABLE").when(F.col("node") == "tc", "TABLE_CELL").when(F.col("node") == "link", "LINK").otherwise("IMAGE"))
    derived = (F.col("outline").isNull() & F.col("heading").isNotNull()) | (listed & F.col("num_id").isNull())
    rows = rows.withColumn("kind", kind).withColumn("certainty", F.when(derived, "DERIVED_EXACT").otherwise("SOURCE_EXACT"))
    place = (F.col("ord") + 1).cast("string")
    table = F.concat(F.lit("table:"), "tbl")
    fact_id = (F.when(F.col("kind") == "HEADING", F.concat(F.lit("heading:"), place)).when(F.col("kind") == "LIST_ITEM", F.concat(F.lit("list-item:"), place))
               .when(F.col("kind") == "TEXT_BLOCK", F.concat(F.lit("text-block:"), place)).when(F.col("kind") == "TABLE", table)
               .when(F.col("kind") == "TABLE_CELL", F.concat_ws(":", table, F.lit("cell"), F.col("row"), F.col("column")))
               .when(F.col("kind") == "LINK", F.concat(F.lit("link:"), "n")).otherwise(F.concat(F.lit("image:"), "n")))
    is_cell, is_table, item = F.col("kind") == "TABLE_CELL", F.col("kind") == "TABLE", F.col("kind") == "LIST_ITEM"
    attributes = _attributes(
        styleId=F.when(F.col("node") == "p", F.col("style")),
        level=F.when(F.col("kind") == "HEADING", F.col("heading").cast("string")).when(
            item, F.when(F.col("num_id").isNotNull(), F.coalesce("ilvl", "style_level")).otherwise(F.col("style_level"))),
        numId=F.when(item, F.col("number")), numberingSource=F.when(item, F.col("numbering_source")),
        rows=F.when(is_table, F.col("n_rows")), columns=F.when(is_table, F.col("columns")),
        tableId=F.when(is_cell, table), row=F.when(is_cell, F.col("row")), column=F.when(is_cell, F.col("column")),
        columnSpan=F.when(is_cell, F.col("span")), target=F.when(F.col("kind") == "LINK", F.col("target")),
        partUri=F.when(F.col("kind") == "IMAGE", F.col("target")), anchor=F.col("anchor"), relationshipId=F.col("rel_id"))
    return rows.select(F.col("path").alias("doc_id"), fact_id.alias("fact_id"), "kind", "text", "ord",
                       F.concat(F.lit("word/document.xml/"), "node", F.lit("["), "n", F.lit("]")).alias("location"), "certainty",
                       attributes.alias("attributes"), F.expr(NO_CERTAINTY).alias("property_certainty"))


def pptx_facts(parts: DataFrame) -> DataFrame:
    """Paragraphs of slides: title placeholders are headings, bullets items; order is not certain."""
    kind = F.when(F.col("placeholder").isin("title", "ctrTitle"), "HEADING").when(F.col("bullet"), "LIST_ITEM").otherwise("TEXT_BLOCK")
    rows = ox.kind_of(parts, "slide").withColumn("kind", kind)
    prefix = F.when(F.col("kind") == "HEADING", "heading:").when(F.col("kind") == "LIST_ITEM", "list:").otherwise("text:")
    level = F.when(F.col("kind") == "HEADING", F.lit("1")).when(F.col("kind") == "LIST_ITEM", F.col("level").cast("string"))
    return rows.select(F.col("path").alias("doc_id"), F.concat(prefix, F.col("ord") + 1).alias("fact_id"), "kind", "text", "ord",
                       F.concat(F.lit("ppt/slide"), "slide", F.lit("/shape["), "shape", F.lit("]/p["), "para", F.lit("]")).alias("location"),
                       F.when(F.col("kind") == "HEADING", "DERIVED_EXACT").otherwise("SOURCE_EXACT").alias("certainty"),
                       _attributes(slide=F.col("slide"), shape=F.col("shape"), level=level).alias("attributes"),
                       F.create_map(F.lit("order"), F.lit("UNAVAILABLE")).alias("property_certainty"))


def xlsx_facts(parts: DataFrame) -> DataFrame:
    """One table per sheet with rows and one cell fact per stored cell with its value evidence."""
    cells = ox.kind_of(parts, "cell").drop("text")
    strings = ox.kind_of(parts, "shared").select("path", F.col("ord").alias("idx"), F.col("text").alias("shared"))
    cells = cells.withColumn("idx", F.when(F.col("type") == "s", F.col("raw").try_cast("bigint"))).join(strings, ["path", "idx"], "left")
    # A shared index beyond the table shows nothing; without a table the raw value stays.
    cells = cells.withColumn("shared", F.when(F.col("idx").isNotNull() & F.col("strings"), F.coalesce("shared", F.lit(""))))
    at = cell_row_index(F.col("ref"))
    cells = cells.withColumn("row", F.when(at >= 0, at).otherwise(F.coalesce(F.col("row_at") - 1, F.col("row_no")))).withColumn("column", cell_column_index(F.col("ref")))
    extent = cells.groupBy("path", "tbl").agg(F.max(F.when(at >= 0, at)).alias("top"), F.max("column").alias("right"))
    value = value_semantics(F.struct("raw", "type", "formula", "shared", "inline", "number_format_id"))
    table = F.concat(F.lit("table:"), "tbl")
    c = cells.select(
        "path", "ord", F.concat_ws(":", table, F.lit("cell"), F.col("row"), F.col("column")).alias("fact_id"),
        F.lit("TABLE_CELL").alias("kind"), value["text"].alias("text"),
        F.concat(F.lit("xl/sheet"), "sheet_no", F.lit("/"), F.coalesce("ref", F.lit(""))).alias("location"),
        _attributes(tableId=table, row=F.col("row"), column=F.col("column"), sheet=F.col("sheet"), valueSemantics=value["semantics"],
                    numberFormatId=F.col("number_format_id")).alias("attributes"),
        F.create_map(F.lit("text"), value["certainty"], *[F.lit(x) for p in ("position", "order", "presence") for x in (p, "SOURCE_EXACT")]).alias("property_certainty"))
    sheets = ox.kind_of(parts, "sheet").join(extent, ["path", "tbl"], "left")
    t = sheets.select(
        "path", "ord", table.alias("fact_id"), F.lit("TABLE").alias("kind"), F.lit(None).cast("string").alias("text"),
        F.concat(F.lit("xl/sheet"), "sheet_no").alias("location"),
        _attributes(sheet=F.col("sheet"), rows=F.coalesce(F.col("top"), F.col("n_rows") - 1) + 1, nonEmptyRows=F.col("n_rows"),
                    columns=F.coalesce("right", F.lit(0)) + 1).alias("attributes"), F.expr(NO_CERTAINTY).alias("property_certainty"))
    return t.unionByName(c).select(F.col("path").alias("doc_id"), "fact_id", "kind", "text", "ord", "location",
                                   F.lit("SOURCE_EXACT").alias("certainty"), "attributes", "property_certainty")
