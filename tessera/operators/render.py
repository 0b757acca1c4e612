"""Markdown rendering: inlines, blocks, lists, tables, notes and whole documents.

Text is assembled by grouping: pieces -> container -> document. A rendered document is one string
cell, which bounds every group here.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url
from ..plans.dims import IMAGE_MIME_EXTENSIONS, dim

# --- fixed values: class names of the emitted HTML fragments -----------------------------------
MARKER_CLASS = "list-marker"
MARKER_ITEM = f'<li style="list-style-type:none"><span class="{MARKER_CLASS}">'
MARKER_ITEM_STABLE = f'<div role="listitem" class="custom-list-item"><span class="{MARKER_CLASS}">'


def joined(order: str, value: str, sep: str = "") -> Column:
    """Concatenate ``value`` in ``order`` within a group."""
    return F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(order, value))), lambda s: s[value]), sep)


def anchor_span(anchor: Column) -> Column:
    return F.concat(F.lit('<span id="'), url.anchor_id(anchor), F.lit('"></span>'))


def _lines(text: Column) -> Column:
    """Lines of a text; a final newline ends the last line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, r"\n\z", ""), "\n"))


def _text_markdown() -> Column:
    s = tx.escape_markdown(F.col("text"))
    star = F.repeat(F.lit("*"), F.col("bold").cast("int") * 2 + F.col("italic").cast("int"))
    strike = F.when(F.col("strike"), F.lit("~~")).otherwise(F.lit(""))
    return F.when(F.col("code"), tx.code_span(F.col("text"))).otherwise(F.concat(strike, star, s, star, strike))


def _text_html() -> Column:
    s = tx.escape_html(F.col("text"))
    for flag, tag in (("code", "code"), ("bold", "strong"), ("italic", "em"), ("strike", "del")):
        s = F.when(F.col(flag), F.concat(F.lit(f"<{tag}>"), s, F.lit(f"</{tag}>"))).otherwise(s)
    return s


def inline_markdown() -> Column:
    """Markdown of one row of ``inlines``; ``asset_path`` is set for exported images."""
    kind, text, target = F.col("type"), F.col("text"), F.col("target")
    alt = F.coalesce(F.col("alt"), F.lit(""))
    src = F.when(F.col("asset_path").isNotNull(), url.asset_url("asset_path")).otherwise(
        url.markdown_image_url(F.coalesce(target, F.lit(""))))
    omitted = F.when(tx.trim_ws(alt) == "", F.lit("[Image]")).otherwise(
        F.concat(F.lit("[Image: "), tx.escape_link_label(tx.trim_ws(alt)), F.lit("]")))
    href = F.when(kind == "anchor_link", F.concat(F.lit("#"), url.anchor_id(target))).otherwise(
        url.markdown_link_url(target))
    return (F.when(kind == "text", _text_markdown())
            .when(kind.isin("link", "anchor_link"),
                  F.concat(F.lit("["), _text_markdown(), F.lit("]("), href, F.lit(")")))
            .when(kind == "image", F.when(src == "", omitted).otherwise(
                F.concat(F.lit("!["), tx.escape_link_label(alt), F.lit("]("), src, F.lit(")"))))
            .when(kind == "break", F.lit("  \n"))
            .when(kind == "checkbox", F.when(text == "true", F.lit("[x] ")).otherwise(F.lit("[ ] ")))
            .when(kind == "math", F.concat(F.lit("$"), tx.trim_ws(text), F.lit("$")))
            .when(kind == "anchor", anchor_span(text))
            .when(kind == "note_ref", F.concat(F.lit("[^"), text, F.lit("]"))))


def inline_html() -> Column:
    kind, text, target = F.col("type"), F.col("text"), F.col("target")
    alt = F.coalesce(F.col("alt"), F.lit(""))
    src = F.when(F.col("asset_path").isNotNull(), url.asset_url("asset_path")).otherwise(
        F.coalesce(tx.escape_html(url.safe_image(target)), F.lit("")))
    label = F.when(tx.trim_ws(alt) == "", F.lit("[Image]")).otherwise(
        F.concat(F.lit("[Image: "), tx.escape_html(tx.trim_ws(alt)), F.lit("]")))
    href = F.when(kind == "anchor_link", F.concat(F.lit("#"), url.anchor_id(target))).otherwise(
        F.coalesce(tx.escape_html(url.safe_link(target)), F.lit("#")))
    note = tx.escape_html(text)
    return (F.when(kind == "text", _text_html())
            .when(kind.isin("link", "anchor_link"),
                  F.concat(F.lit('<a href="'), href, F.lit('">'), _text_html(), F.lit("</a>")))
            .when(kind == "image", F.when(src == "", F.concat(
                F.lit('<span class="image-omitted">'), label, F.lit("</span>"))).otherwise(F.concat(
                    F.lit('<img src="'), src, F.lit('" alt="'), tx.escape_html(alt), F.lit('" />'))))
            .when(kind == "break", F.lit("<br />"))
            .when(kind == "checkbox", F.when(text == "true", F.lit("[x]")).otherwise(F.lit("[ ]")))
            .when(kind == "math", F.concat(F.lit("<code>"), tx.escape_html(text), F.lit("</code>")))
            .when(kind == "anchor", anchor_span(text))
            .when(kind == "note_ref", F.concat(F.lit('<sup><a href="#'), note, F.lit('">['), note,
                                               F.lit("]</a></sup>"))))


def render_inlines(inlines: DataFrame) -> DataFrame:
    """``(doc_id, container_id)`` -> Markdown, HTML and table-cell Markdown of its inlines."""
    pieces = inlines.select("doc_id", "container_id", "ord", inline_markdown().alias("md"),
                            inline_html().alias("html"),
                            F.when(F.col("type") == "break", F.lit("<br>")).otherwise(inline_markdown()).alias("cell_md"))
    return pieces.groupBy("doc_id", "container_id").agg(
        joined("ord", "md").alias("md"), joined("ord", "html").alias("html"),
        joined("ord", "cell_md").alias("cell_md"))


def block_markdown() -> Column:
    """Markdown of one row of ``blocks``; ``md`` is the inline Markdown, ``text`` the raw text."""
    kind, md, text = F.col("type"), F.col("md"), F.col("text")
    anchor = F.when(F.col("anchor").isNotNull(), F.concat(anchor_span(F.col("anchor")), F.lit("\n"))).otherwise("")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.col("level")))
    quoted = F.array_join(F.transform(_lines(F.concat(md, F.lit("\n\n"))),
                                      lambda t: F.concat(F.lit("> "), t, F.lit("\n"))), "")
    return (F.when(kind == "heading", F.concat(F.lit("\n"), anchor, F.repeat(F.lit("#"), level), F.lit(" "), md, F.lit("\n\n")))
            .when(kind == "paragraph", F.concat(md, F.lit("\n\n")))
            .when(kind == "quote", F.concat(quoted, F.lit("\n")))
            .when(kind == "code", F.concat(tx.code_fence(text, F.col("lang")), F.lit("\n\n")))
            .when(kind == "rule", F.lit("---\n\n"))
            .when(kind == "math", F.concat(F.lit("$$\n"), tx.trim_ws(text), F.lit("\n$$\n\n"))))


def render_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.select("doc_id", "block_id", block_markdown().alias("md"))


def _roman(n: Column) -> Column:
    digits = lambda one, five, ten: F.array(*[F.lit(s.replace("i", one).replace("v", five).replace("x", ten))
                                              for s in ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")])
    pick = lambda table, unit: F.element_at(table, (F.floor(n / unit) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), pick(digits("c", "d", "m"), 100),
                    pick(digits("x", "l", "c"), 10), pick(digits("i", "v", "x"), 1))


def _alpha(n: Column) -> Column:
    letter = F.char(F.lit(97) + (n - 1) % 26)
    return F.when(n <= 26, letter).otherwise(F.concat(F.char(F.lit(96) + F.floor((n - 1) / 26)), letter))


def list_marker(item: Column, index: Column) -> Column:
    """Marker of an item at 0-based ``index`` of its list, with the trailing space."""
    n = item["start"] + index
    kind = item["marker"]
    ordinal = (F.when(kind == "lower_alpha", _alpha(n)).when(kind == "upper_alpha", F.upper(_alpha(n)))
               .when(kind == "lower_roman", _roman(n)).when(kind == "upper_roman", F.upper(_roman(n)))
               .otherwise(n.cast("string")))
    return (F.when(item["label"].isNotNull(), F.concat(tx.trim_ws(item["label"]), F.lit(" ")))
            .when(kind == "bullet", F.lit("* ")).otherwise(F.concat(ordinal, F.lit(". "))))


def _indented(paragraph: Column, first: Column, rest: Column) -> Column:
    """Lines of a paragraph behind their prefixes; blank lines stay blank."""
    return F.array_join(F.transform(_lines(paragraph), lambda t, i: F.concat(
        F.when(i == 0, first).when(t == "", F.lit("")).otherwise(rest), t, F.lit("\n"))), "")


OPEN = "struct<index:int,width:int>"


def _item_text(item: Column, indent: Column, mark: Column) -> Column:
    outer = F.repeat(F.lit(" "), indent)
    prefix, rest = F.concat(outer, mark), F.concat(outer, F.repeat(F.lit(" "), F.length(mark)))
    paragraphs = item["paragraphs"]
    first = F.when((F.size(paragraphs) == 0) | (paragraphs[0] == ""), F.concat(prefix, F.lit("\n"))).otherwise(
        _indented(paragraphs[0], prefix, rest))
    more = F.transform(F.slice(paragraphs, 2, F.greatest(F.size(paragraphs), F.lit(1))), lambda p: F.concat(F.lit("\n"), _indented(p, rest, rest)))
    return F.concat(first, F.array_join(more, ""))


def render_lists(items: DataFrame) -> DataFrame:
    """Lists from items in reading order.

    ``items(doc_id, list_id, ord, depth, marker, start, label, paragraphs)``; the depth starts at
    0. One scan over a list carries the open item of every depth, with its place among its siblings and
    the width of its marker: an item is indented by the widths of those around it, and a new one at an
    outer depth closes what is open below. Depths without an open item add nothing. The depth is found
    while reading, so the plan is the same for every list.
    """
    read = F.sort_array(F.collect_list(F.struct("ord", *[F.col(c).cast("int").alias(c) for c in ("depth", "start")], "marker", "label", "paragraphs")))
    lists = items.groupBy("doc_id", "list_id").agg(read.alias("items"))
    none = F.struct(F.lit(-1).alias("index"), F.lit(0).alias("width")).cast(OPEN)
    around = lambda stack, x: F.slice(stack, 1, x["depth"])
    index = lambda stack, x: F.when(F.size(stack) > x["depth"], F.try_element_at(stack, x["depth"] + 1)["index"] + 1).otherwise(0)

    def step(stack, x):
        own = F.array(tx.let(index(stack, x), lambda i: F.struct(i.alias("index"), F.length(list_marker(x, i)).alias("width"))).cast(OPEN))
        outer = around(stack, x)
        return F.concat(outer, F.array_repeat(none, x["depth"] - F.size(outer)), own)

    def out(stack, x):
        indent = F.aggregate(around(stack, x), F.lit(0), lambda n, o: n + o["width"])
        return tx.let(list_marker(x, index(stack, x)), lambda mark: _item_text(x, indent, mark))

    bodies = tx.scan(F.col("items"), F.array().cast(f"array<{OPEN}>"), step, out, "string")
    return lists.select("doc_id", "list_id", F.array_join(bodies, "").alias("md"))


def table_is_complex(cells: DataFrame) -> DataFrame:
    """Tables that need HTML: several header rows, spans, covered cells, rich cell content."""
    return cells.groupBy("table_id").agg(F.bool_or(
        (F.col("header_rows") > 1) | F.col("covered") | (F.col("row_span") > 1) | (F.col("col_span") > 1)
        | (F.col("n_blocks") > 1) | ~F.col("block_type").isin("paragraph", "heading")).alias("is_complex"))


def _table_rows(cells: DataFrame, value: Column, *extra: Column) -> DataFrame:
    rows = cells.groupBy("table_id", "row").agg(
        F.sort_array(F.collect_list(F.struct("col", value.alias("v")))).alias("cells"),
        F.max("header_rows").alias("header_rows"), *extra)
    return rows.withColumn("cells", F.transform("cells", lambda c: c["v"]))


def gfm_row(row: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(row, " | "), F.lit(" |\n"))


def gfm_cell(text: Column) -> Column:
    text = F.replace(text, F.lit("\n"), F.lit(" "))
    text = F.replace(F.replace(text, F.lit("\r"), F.lit("")), F.lit("|"), F.lit("\\|"))
    return tx.trim_ws(text)


def gfm_table(rows: Column, header_rows: Column) -> Column:
    """Pipe table of an array of rows; short rows are padded, a missing header is empty."""
    blank = lambda n: F.array_repeat(F.lit(""), n)
    return tx.let(rows, lambda r: tx.let(
        F.struct(r.alias("rows"), F.array_max(F.transform(r, F.size)).alias("width")),
        lambda t: F.concat(
            F.lit("\n"),
            F.when(header_rows >= 1, F.lit("")).otherwise(gfm_row(blank(t["width"]))),
            F.array_join(F.transform(t["rows"], lambda cells, i: F.concat(
                F.when((i == 0) & (header_rows < 1), gfm_row(F.array_repeat(F.lit("---"), t["width"]))).otherwise(""),
                gfm_row(F.concat(cells, blank(t["width"] - F.size(cells)))),
                F.when((i == 0) & (header_rows >= 1), gfm_row(F.array_repeat(F.lit("---"), t["width"]))).otherwise(""))), ""),
            F.lit("\n"))))


def render_gfm_table(cells: DataFrame) -> DataFrame:
    value = F.when(F.col("covered"), F.lit("")).otherwise(gfm_cell(F.col("md")))
    rows = _table_rows(cells, value)
    tables = rows.groupBy("table_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows"),
        F.max("header_rows").alias("header_rows"))
    return tables.select("table_id", gfm_table(F.col("rows"), F.col("header_rows")).alias("md"))


def render_html_table(cells: DataFrame) -> DataFrame:
    """HTML table with spans; ``html`` holds the content of a cell."""
    n_rows = cells.groupBy("table_id").agg((F.max("row") + 1).alias("n_rows"))
    cells = cells.join(n_rows, "table_id")
    headed = (F.col("header_rows") > 0) & (F.col("header_rows") <= F.col("n_rows"))
    header = headed & (F.col("row") < F.col("header_rows"))
    tag = F.when(header, F.lit("th")).otherwise(F.lit("td"))
    span = lambda c, name: F.when(F.col(c) > 1, F.concat(F.lit(f' {name}="'), F.col(c), F.lit('"'))).otherwise("")
    cell = F.concat(F.lit("    <"), tag, span("col_span", "colspan"), span("row_span", "rowspan"), F.lit(">"),
                    F.col("html"), F.lit("</"), tag, F.lit(">\n"))
    cells = cells.withColumn("piece", F.when(F.col("covered"), F.lit("")).otherwise(cell))
    rows = cells.groupBy("table_id", "row").agg(
        joined("col", "piece").alias("piece"), F.max("n_rows").alias("n_rows"),
        F.max(F.when(headed, F.col("header_rows")).otherwise(0)).alias("heads"))
    row, heads = F.col("row"), F.col("heads")
    opening = F.when((row == 0) & (heads > 0), F.lit("<thead>\n")).when(row == heads, F.lit("<tbody>\n")).otherwise("")
    closing = (F.when(row == heads - 1, F.lit("</thead>\n"))
               .when(row == F.col("n_rows") - 1, F.lit("</tbody>\n")).otherwise(""))
    rows = rows.withColumn("md", F.concat(opening, F.lit("  <tr>\n"), "piece", F.lit("  </tr>\n"), closing))
    return rows.groupBy("table_id").agg(F.concat(
        F.lit("<table>\n"), joined("row", "md"), F.lit("</table>\n\n")).alias("md"))


def render_notes(notes: DataFrame) -> DataFrame:
    """Footnotes of ``notes(doc_id, note_id, ord, md)`` behind a rule."""
    body = F.array_join(F.transform(_lines(tx.trim_ws(F.col("md"))), lambda t, i: F.concat(
        F.when(i == 0, F.lit("")).otherwise(F.lit("\n")),
        F.when(i == 0, t).when(tx.is_blank(t), F.lit("")).otherwise(F.concat(F.lit("    "), t)))), "")
    rows = notes.select("doc_id", "ord", F.concat(
        F.lit("[^"), F.col("note_id"), F.lit("]: "), body, F.lit("\n\n")).alias("piece"))
    return rows.groupBy("doc_id").agg(F.concat(F.lit("\n\n---\n\n"), joined("ord", "piece")).alias("md"))


def finish_document(text: Column) -> Column:
    """A text without white space at its ends, and a line feed where anything is left of it."""
    return tx.let(tx.trim_ws(text), lambda t: F.when(t == "", t).otherwise(F.concat(t, F.lit("\n"))))


def render_document(parts: DataFrame, notes: DataFrame = None) -> DataFrame:
    """Documents from ``parts(doc_id, ord, md)`` and their rendered notes."""
    docs = parts.groupBy("doc_id").agg(joined("ord", "md").alias("body"))
    if notes is None:
        return docs.select("doc_id", finish_document(F.col("body")).alias("markdown"))
    docs = docs.join(notes.withColumnRenamed("md", "notes"), "doc_id", "full_outer")
    return docs.select("doc_id", finish_document(F.concat(
        F.coalesce("body", F.lit("")), F.coalesce("notes", F.lit("")))).alias("markdown"))


def stabilize_list_markers(docs: DataFrame) -> DataFrame:
    """Turn custom-marker list items into containers that need no inline style.

    Item tags are paired by depth: a closing tag belongs to the last opening tag at its depth.
    Items that are never closed stay as they are.
    """
    token = r"(?s)<li\b[^>]*>|</li>|<|[^<]+"
    rows = docs.select("doc_id", F.posexplode(
        F.regexp_extract_all("markdown", F.lit(token), F.lit(0))).alias("pos", "tok"))
    tok = F.col("tok")
    opens, closes = tok.startswith("<li") & (tok != "<li"), tok == "</li>"
    read = W.partitionBy("doc_id").orderBy("pos")
    behind = F.concat(F.lead("tok", 1, "").over(read), F.lead("tok", 2, "").over(read))
    opened = F.sum(opens.cast("int")).over(read.rowsBetween(W.unboundedPreceding, 0))
    closed = F.coalesce(F.sum(closes.cast("int")).over(read.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    custom = (tok == '<li style="list-style-type:none">') & behind.startswith(f'<span class="{MARKER_CLASS}">')
    rows = rows.select("doc_id", "pos", "tok", opens.alias("opens"), closes.alias("closes"),
                       custom.alias("custom"), (opened - closed).alias("depth"))
    level = W.partitionBy("doc_id", "depth").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(
        "*", F.sum(F.col("opens").cast("int")).over(level).alias("item"),
        F.last(F.when(F.col("opens"), F.col("custom")), ignorenulls=True).over(level).alias("of_custom"))
    item = W.partitionBy("doc_id", "depth", "item")
    rows = rows.withColumn("closed", F.bool_or(F.col("closes")).over(item))
    piece = (F.when(F.col("custom") & F.col("closed"), F.lit(MARKER_ITEM_STABLE.split("<span")[0]))
             .when(F.col("closes") & F.coalesce(F.col("of_custom"), F.lit(False)), F.lit("</div>"))
             .otherwise(F.col("tok")))
    return rows.withColumn("piece", piece).groupBy("doc_id").agg(joined("pos", "piece").alias("markdown"))


def number_assets(inlines: DataFrame, assets: DataFrame) -> DataFrame:
    """Referenced assets in first-appearance order, numbered among the exportable types."""
    spark = inlines.sparkSession
    first = inlines.filter("asset_id is not null").groupBy("doc_id", "asset_id").agg(F.min("pos").alias("pos"))
    mime = dim(spark, "image_types")
    known = list(dict.fromkeys(IMAGE_MIME_EXTENSIONS.values())) + ["jpeg"]
    part_ext = F.regexp_extract("origin_part", r"\.([^./]+)$", 1)
    rows = (first.join(assets, ["doc_id", "asset_id"])
            .join(mime, F.lower(assets["media_type"]) == mime["media_type"], "left")
            .select("doc_id", "asset_id", "pos", F.coalesce(
                "extension", F.when(F.lower(part_ext).isin(known), part_ext)).alias("ext"))
            .filter("ext is not null"))
    n = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    return rows.select("doc_id", "asset_id", F.format_string("image-%03d.%s", n, "ext").alias("file_name"))
