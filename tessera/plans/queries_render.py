"""Queries on rendering: scalar escapes and links, inlines, blocks, lists, tables, notes, documents."""
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url
from ..operators import render as rd
from . import dims, views
from .oracle import (anchor_id, code_fence, code_span, cte, esc_html, esc_label, esc_md, lit, md_url, query, safe_image,
                     safe_link, scheme, split, strings, trim_ws)
from .registry import register


def _scalar(name, table, key, sql, column):
    @register(name, f"SELECT {key}, {sql} FROM {table}")
    def run(spark, sf_dir):
        return views.table(spark, sf_dir, table).select(*[k.strip() for k in key.split(",")], *column())


T = lambda: F.col("text")
_scalar("escape_html", "documents", "doc_id", esc_html("text") + " AS escaped", lambda: [tx.escape_html(T()).alias("escaped")])
_scalar("escape_markdown", "documents", "doc_id", esc_md("text") + " AS escaped", lambda: [tx.escape_markdown(T()).alias("escaped")])
_scalar("escape_link_label", "documents", "doc_id", esc_label("text || '[' || lang || ']'") + " AS escaped",
        lambda: [tx.escape_link_label(F.concat(T(), F.lit("["), "lang", F.lit("]"))).alias("escaped")])
_TICKS = "replace(text, ' e', repeat('`', (turn % 4)::INT) || ' e')"
_TICKS_SP = "replace(text, ' e', concat(repeat('`', CAST(turn % 4 AS INT)), ' e'))"
_scalar("code_span", "conversations", "conv_id, turn", f"{code_span(_TICKS)} AS md", lambda: [tx.code_span(F.expr(_TICKS_SP)).alias("md")])
_scalar("code_fence", "conversations", "conv_id, turn", f"{code_fence(_TICKS, 'role')} AS md", lambda: [tx.code_fence(F.expr(_TICKS_SP), F.col("role")).alias("md")])
_scalar("anchor_id", "documents", "doc_id", anchor_id("text") + " AS anchor", lambda: [url.anchor_id(T()).alias("anchor")])

# Real links of the pages, behind beginnings that make them safe or not.
_STARTS = ["", "https://example.com/a b?x=(", " mailto:a@b.c", "javascript:", "jav\tascript:", "#My Section: ", "docs", "ftp://h", " HTTP://Ex.com", "data:", "//cdn"]
_ENDS = ["", ".png", ".SVG", ".svg?y", "#x"]
_LINKS = f"""(SELECT doc_id, n, {strings(_STARTS)}[n % {len(_STARTS)} + 1] || target || {strings(_ENDS)}[n % {len(_ENDS)} + 1] AS link FROM (
  SELECT doc_id, target, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS n FROM html_s WHERE kind = 'LINK'))"""


def links(spark, sf_dir):
    rows = views.page_links(spark, sf_dir)
    return rows.select("doc_id", "n", F.concat(views.pick(_STARTS, F.col("n") % len(_STARTS)), "target", views.pick(_ENDS, F.col("n") % len(_ENDS))).alias("link"))


_scalar("url_scheme", "pages", "page_id", scheme("url") + " AS scheme", lambda: [url.url_scheme(F.col("url")).alias("scheme")])
_scalar("asset_url_encode", "conversations", "conv_id, turn", "replace(url_encode(role || '*~/' || text), '%2F', '/') AS encoded",
        lambda: [url.asset_url(F.concat("role", F.lit("*~/"), "text")).alias("encoded")])

@register("safe_link_url", query("html_s", f"SELECT doc_id, n, {safe_link('link')} AS safe, {md_url(safe_link('link'))} AS markdown_url FROM {_LINKS}"))
def _(spark, sf_dir):
    return links(spark, sf_dir).select("doc_id", "n", url.safe_link(F.col("link")).alias("safe"), url.markdown_link_url(F.col("link")).alias("markdown_url"))


@register("safe_image_url", query("html_s", f"SELECT doc_id, n, {safe_image('link')} AS safe, {md_url(safe_image('link'), '')} AS markdown_url FROM {_LINKS}"))
def _(spark, sf_dir):
    return links(spark, sf_dir).select("doc_id", "n", url.safe_image(F.col("link")).alias("safe"), url.markdown_image_url(F.col("link")).alias("markdown_url"))


# --- inlines: the words of a turn, typed by position -------------------------------------------
TYPES = ["text", "text", "text", "text", "text", "text", "link", "image", "break", "checkbox", "math", "anchor", "note_ref", "anchor_link"]
_DOC = _DOC_SP = "conv_id * 1000000"
_TARGETS = ["https://example.com/a b?x=(", "javascript:", "/rel/", "#"]
cte("inlines", "", f"""
SELECT doc_id, container_id, ord, {strings(TYPES)}[ord % 14 + 1] AS type, ord % 2 = 1 AS bold, ord % 3 = 1 AS italic, ord % 5 = 4 AS strike, ord % 14 = 5 AS code,
  CASE WHEN ord % 14 = 9 THEN CASE WHEN length(word) % 2 = 0 THEN 'true' ELSE 'false' END ELSE word END AS text,
  CASE WHEN ord % 14 = 7 THEN 'https://img.example.com/' || word || CASE WHEN length(word) % 2 = 0 THEN '.svg' ELSE '.png' END ELSE {strings(_TARGETS)}[ord % 4 + 1] || word END AS target,
  CASE WHEN length(word) % 5 <> 0 THEN word ELSE '' END AS alt
FROM (SELECT {_DOC} AS doc_id, turn AS container_id, unnest(w) AS word, unnest(range(len(w))) AS ord FROM (SELECT *, string_split(text, ' ') AS w FROM conversations))""")


def _emph(code, style):
    s = f"CASE WHEN bold AND italic THEN '***' WHEN bold THEN '**' WHEN italic THEN '*' ELSE '' END"
    x = f"CASE WHEN strike THEN '~~' ELSE '' END"
    return f"CASE WHEN code THEN {code} ELSE {x} || {s} || {style} || {s} || {x} END"


_HTML_TEXT = "CASE WHEN strike THEN '<del>' ELSE '' END || CASE WHEN italic THEN '<em>' ELSE '' END || CASE WHEN bold THEN '<strong>' ELSE '' END || CASE WHEN code THEN '<code>' ELSE '' END || " + esc_html("text") + " || CASE WHEN code THEN '</code>' ELSE '' END || CASE WHEN bold THEN '</strong>' ELSE '' END || CASE WHEN italic THEN '</em>' ELSE '' END || CASE WHEN strike THEN '</del>' ELSE '' END"
_span = lambda x: f"'<span id=\"' || {anchor_id(x)} || '\"></span>'"
_omit = f"CASE WHEN trim(alt) = '' THEN '[Image]' ELSE '[Image: ' || {esc_label('alt')} || ']' END"
_omit_h = f"CASE WHEN trim(alt) = '' THEN '[Image]' ELSE '[Image: ' || {esc_html('alt')} || ']' END"
_INLINE_MD = f"""CASE type WHEN 'text' THEN {_emph(code_span('text'), esc_md('text'))}
  WHEN 'link' THEN '[' || {_emph(code_span('text'), esc_md('text'))} || '](' || {md_url(safe_link('target'))} || ')'
  WHEN 'anchor_link' THEN '[' || {_emph(code_span('text'), esc_md('text'))} || '](#' || {anchor_id('target')} || ')'
  WHEN 'image' THEN CASE WHEN {md_url(safe_image('target'), '')} = '' THEN {_omit} ELSE '![' || {esc_label('alt')} || '](' || {md_url(safe_image('target'), '')} || ')' END
  WHEN 'break' THEN '  ' || chr(10) WHEN 'checkbox' THEN CASE WHEN text = 'true' THEN '[x] ' ELSE '[ ] ' END WHEN 'math' THEN '$' || {trim_ws('text')} || '$'
  WHEN 'anchor' THEN {_span('text')} WHEN 'note_ref' THEN '[^' || text || ']' END"""
_INLINE_HTML = f"""CASE type WHEN 'text' THEN {_HTML_TEXT} WHEN 'link' THEN '<a href="' || coalesce({esc_html(safe_link('target'))}, '#') || '">' || {_HTML_TEXT} || '</a>'
  WHEN 'anchor_link' THEN '<a href="#' || {anchor_id('target')} || '">' || {_HTML_TEXT} || '</a>'
  WHEN 'image' THEN CASE WHEN coalesce({esc_html(safe_image('target'))}, '') = '' THEN '<span class="image-omitted">' || {_omit_h} || '</span>'
       ELSE '<img src="' || {esc_html(safe_image('target'))} || '" alt="' || {esc_html('alt')} || '" />' END
  WHEN 'break' THEN '<br />' WHEN 'checkbox' THEN CASE WHEN text = 'true' THEN '[x]' ELSE '[ ]' END WHEN 'math' THEN '<code>' || {esc_html('text')} || '</code>'
  WHEN 'anchor' THEN {_span('text')} WHEN 'note_ref' THEN '<sup><a href="#' || {esc_html('text')} || '">[' || {esc_html('text')} || ']</a></sup>' END"""


def inlines(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    w = c.select(F.expr(_DOC_SP).alias("doc_id"), F.col("turn").alias("container_id"), F.posexplode(F.split("text", " ")).alias("ord", "word"))
    return w.select(
        "doc_id", "container_id", "ord", views.pick(TYPES, F.col("ord") % 14).alias("type"),
        F.expr("ord % 2 = 1 AS bold"), F.expr("ord % 3 = 1 AS italic"), F.expr("ord % 5 = 4 AS strike"), F.expr("ord % 14 = 5 AS code"),
        F.expr("CASE WHEN ord % 14 = 9 THEN CASE WHEN length(word) % 2 = 0 THEN 'true' ELSE 'false' END ELSE word END AS text"),
        F.when(F.expr("ord % 14 = 7"), F.expr("concat('https://img.example.com/', word, CASE WHEN length(word) % 2 = 0 THEN '.svg' ELSE '.png' END)"))
        .otherwise(F.concat(views.pick(_TARGETS, F.col("ord") % 4), "word")).alias("target"),
        F.expr("CASE WHEN length(word) % 5 <> 0 THEN word ELSE '' END AS alt"), F.lit(None).cast("string").alias("asset_path"))


@register("render_inlines", query("inlines", f"""SELECT doc_id, container_id, string_agg(md, '' ORDER BY ord) AS md, string_agg(html, '' ORDER BY ord) AS html,
  string_agg(CASE WHEN type = 'break' THEN '<br>' ELSE md END, '' ORDER BY ord) AS cell_md FROM (SELECT *, {_INLINE_MD} AS md, {_INLINE_HTML} AS html FROM inlines) GROUP BY ALL"""))
def _(spark, sf_dir):
    return rd.render_inlines(inlines(spark, sf_dir))


# --- blocks, notes and documents: one block per turn -------------------------------------------
BLOCK_TYPES = ["heading", "paragraph", "quote", "code", "rule", "math"]
_lines_of = lambda x: f"CASE WHEN {x} = '' THEN [] ELSE {split(f'regexp_replace({x}, chr(10) || {lit("$")}, {lit("")})')} END"
cte("rblocks", "", f"""SELECT {_DOC} AS doc_id, turn AS block_id, {strings(BLOCK_TYPES)}[turn % 6 + 1] AS type, turn % 9 AS level, CASE WHEN turn % 12 = 0 THEN 'Sec: ' || turn END AS anchor,
  CASE WHEN turn % 4 = 3 THEN 'p`y' || role END AS lang, text, {esc_md('text')} AS md FROM conversations""")
cte("block_md", "rblocks", f"""SELECT doc_id, block_id, CASE type
  WHEN 'heading' THEN chr(10) || CASE WHEN anchor IS NOT NULL THEN {_span('anchor')} || chr(10) ELSE '' END || repeat('#', greatest(1, least(6, level))::INT) || ' ' || md || chr(10) || chr(10)
  WHEN 'paragraph' THEN md || chr(10) || chr(10) WHEN 'quote' THEN array_to_string(list_transform({split("md || chr(10)")}, lambda t: '> ' || t || chr(10)), '') || chr(10)
  WHEN 'code' THEN {code_fence('text', 'lang')} || chr(10) || chr(10) WHEN 'rule' THEN '---' || chr(10) || chr(10) ELSE '$$' || chr(10) || {trim_ws('text')} || chr(10) || '$$' || chr(10) || chr(10) END AS md FROM rblocks""")
cte("notes_md", "", f"""SELECT doc_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg('[^' || turn || ']: ' || body || chr(10) || chr(10), '' ORDER BY turn) AS md
FROM (SELECT {_DOC} AS doc_id, turn, array_to_string(list_transform({split(trim_ws("text || chr(10) || chr(10) || role"))}, lambda t, i: CASE WHEN i = 1 THEN t WHEN trim(t) = '' THEN '' ELSE '    ' || t END), chr(10)) AS body FROM conversations) GROUP BY doc_id""")


def rblocks(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.select(F.expr(_DOC_SP).alias("doc_id"), F.col("turn").alias("block_id"), views.pick(BLOCK_TYPES, F.col("turn") % 6).alias("type"),
                    (F.col("turn") % 9).cast("int").alias("level"), F.expr("CASE WHEN turn % 12 = 0 THEN concat('Sec: ', turn) END AS anchor"),
                    F.expr("CASE WHEN turn % 4 = 3 THEN concat('p`y', role) END AS lang"), "text", tx.escape_markdown(F.col("text")).alias("md"))


def rnotes(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    return c.select(F.expr(_DOC_SP).alias("doc_id"), F.col("turn").cast("string").alias("note_id"), F.col("turn").alias("ord"),
                    F.concat("text", F.lit("\n\n"), "role").alias("md"))


@register("render_blocks", query("block_md", "SELECT * FROM block_md"))
def _(spark, sf_dir):
    return rd.render_blocks(rblocks(spark, sf_dir))


@register("render_notes", query("notes_md", "SELECT * FROM notes_md"))
def _(spark, sf_dir):
    return rd.render_notes(rnotes(spark, sf_dir))


@register("render_document", query("block_md notes_md", f"""SELECT doc_id, CASE WHEN t = '' THEN '' ELSE t || chr(10) END AS markdown FROM (
SELECT doc_id, {trim_ws("b.md || coalesce(n.md, '')")} AS t FROM (SELECT doc_id, string_agg(md, '' ORDER BY block_id) AS md FROM block_md GROUP BY doc_id) b LEFT JOIN notes_md n USING (doc_id))"""))
def _(spark, sf_dir):
    parts = rd.render_blocks(rblocks(spark, sf_dir)).withColumnRenamed("block_id", "ord")
    return rd.render_document(parts, rd.render_notes(rnotes(spark, sf_dir)))


# --- lists: the lines of a document, nested by position ----------------------------------------
cte("list_items", "", f"""SELECT doc_id, ord, [0, 1, 2, 1][ord % 4 + 1] AS depth, CASE WHEN length(line) % 10 = 7 THEN ' x) ' END AS label, line,
  CASE WHEN length(line) % 3 = 0 THEN [line, lang] ELSE [line] END AS paragraphs FROM (
  SELECT doc_id, lang, unnest(l) AS line, unnest(range(len(l))) AS ord FROM (SELECT doc_id, lang, {split('text')} AS l FROM documents))""")
_lw = "(PARTITION BY doc_id ORDER BY ord)"


@register("render_lists", query("list_items", f"""SELECT doc_id, string_agg(body, '' ORDER BY ord) AS md FROM (
SELECT doc_id, ord, outer_ || mark || paragraphs[1] || chr(10) || CASE WHEN len(paragraphs) > 1 THEN chr(10) || outer_ || repeat(' ', length(mark)) || paragraphs[2] || chr(10) ELSE '' END AS body FROM (
  SELECT *, repeat(' ', (CASE WHEN depth > 0 THEN last_value(CASE WHEN depth = 0 THEN length(mark) END IGNORE NULLS) OVER {_lw} ELSE 0 END + CASE WHEN depth > 1 THEN last_value(CASE WHEN depth = 1 THEN length(mark) END IGNORE NULLS) OVER {_lw} ELSE 0 END)::INT) AS outer_ FROM (
    SELECT *, CASE WHEN label IS NOT NULL THEN 'x) ' WHEN depth = 0 THEN (8 + row_number() OVER (PARTITION BY doc_id, depth ORDER BY ord)) || '. ' WHEN depth = 1 THEN '* ' ELSE 'iii. ' END AS mark FROM list_items))) GROUP BY doc_id"""))
def _(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    rows = rows.select("doc_id", F.lit(1).alias("list_id"), "ord", F.expr("element_at(array(0, 1, 2, 1), ord % 4 + 1)").alias("depth"),
                       F.expr("CASE WHEN length(line) % 10 = 7 THEN ' x) ' END").alias("label"),
                       F.expr("CASE WHEN length(line) % 3 = 0 THEN array(line, lang) ELSE array(line) END").alias("paragraphs"))
    rows = rows.withColumn("marker", F.expr("element_at(array('decimal', 'bullet', 'lower_roman'), depth + 1)")).withColumn(
        "start", F.expr("element_at(array(9, 1, 3), depth + 1)"))
    return rd.render_lists(rows).select("doc_id", "md")


# --- tables: one per conversation -------------------------------------------------------
cte("rcells", "", f"""SELECT table_id, row, col, CASE WHEN table_id % 5 = 0 AND row = 0 AND col = 0 THEN 2 ELSE 1 END AS col_span, 1 AS row_span, table_id % 5 = 0 AND row = 0 AND col = 1 AS covered,
  (table_id // 1000000) % 3 AS header_rows, CASE WHEN (table_id // 1000000) % 7 = 0 AND row = 1 THEN 2 ELSE 1 END AS n_blocks, CASE WHEN (table_id // 1000000) % 11 = 0 AND col = 2 THEN 'list' ELSE 'paragraph' END AS block_type, v FROM (
  SELECT {_DOC} AS table_id, turn AS row, unnest([0, 1, 2]) AS col, unnest([turn::VARCHAR, role || '|', text]) AS v FROM conversations)""")


def rcells(spark, sf_dir):
    c = views.table(spark, sf_dir, "conversations")
    rows = c.select(F.expr(_DOC_SP).alias("table_id"), F.col("turn").alias("row"),
                    F.posexplode(F.expr("array(CAST(turn AS STRING), concat(role, '|'), text)")).alias("col", "v"))
    return rows.select(
        "table_id", "row", "col", F.expr("CASE WHEN table_id % 5 = 0 AND row = 0 AND col = 0 THEN 2 ELSE 1 END AS col_span"), F.lit(1).alias("row_span"),
        F.expr("table_id % 5 = 0 AND row = 0 AND col = 1 AS covered"), F.expr("(table_id DIV 1000000) % 3 AS header_rows"),
        F.expr("CASE WHEN (table_id DIV 1000000) % 7 = 0 AND row = 1 THEN 2 ELSE 1 END AS n_blocks"),
        F.expr("CASE WHEN (table_id DIV 1000000) % 11 = 0 AND col = 2 THEN 'list' ELSE 'paragraph' END AS block_type"),
        tx.escape_markdown(F.col("v")).alias("md"), tx.escape_html(F.col("v")).alias("html"))


@register("table_is_complex", query("rcells", "SELECT table_id, bool_or(header_rows > 1 OR covered OR col_span > 1 OR n_blocks > 1 OR block_type <> 'paragraph') AS is_complex FROM rcells GROUP BY table_id"))
def _(spark, sf_dir):
    return rd.table_is_complex(rcells(spark, sf_dir))


_row = "'| ' || string_agg(CASE WHEN covered THEN '' ELSE " + trim_ws("replace(replace(replace(" + esc_md("v") + ", chr(10), ' '), chr(13), ''), '|', '\\|')") + " END, ' | ' ORDER BY col) || ' |' || chr(10)"


@register("render_gfm_table", query("rcells", f"""SELECT table_id, chr(10) || CASE WHEN any_value(hr) < 1 THEN '|  |  |  |' || chr(10) || '| --- | --- | --- |' || chr(10) ELSE '' END
  || string_agg(line || CASE WHEN hr >= 1 AND row = 0 THEN '| --- | --- | --- |' || chr(10) ELSE '' END, '' ORDER BY row) || chr(10) AS md
FROM (SELECT table_id, row, any_value(header_rows) AS hr, {_row} AS line FROM rcells GROUP BY table_id, row) GROUP BY table_id"""))
def _(spark, sf_dir):
    return rd.render_gfm_table(rcells(spark, sf_dir))


@register("render_html_table", query("rcells", f"""SELECT table_id, '<table>' || chr(10) || string_agg(CASE WHEN row = 0 AND hr > 0 THEN '<thead>' || chr(10) WHEN row = hr THEN '<tbody>' || chr(10) ELSE '' END
  || '  <tr>' || chr(10) || line || '  </tr>' || chr(10) || CASE WHEN row = hr - 1 THEN '</thead>' || chr(10) WHEN row = nr - 1 THEN '</tbody>' || chr(10) ELSE '' END, '' ORDER BY row) || '</table>' || chr(10) || chr(10) AS md
FROM (SELECT table_id, row, any_value(hr) AS hr, any_value(nr) AS nr, string_agg(CASE WHEN covered THEN '' ELSE '    <' || tag || CASE WHEN col_span > 1 THEN ' colspan="' || col_span || '"' ELSE '' END || '>' || {esc_html('v')} || '</' || tag || '>' || chr(10) END, '' ORDER BY col) AS line
  FROM (SELECT *, CASE WHEN row < hr THEN 'th' ELSE 'td' END AS tag FROM (SELECT r.*, nr, CASE WHEN header_rows <= nr THEN header_rows ELSE 0 END AS hr FROM rcells r JOIN (SELECT table_id, max(row) + 1 AS nr FROM rcells GROUP BY 1) USING (table_id)))
  GROUP BY table_id, row) GROUP BY table_id"""))
def _(spark, sf_dir):
    return rd.render_html_table(rcells(spark, sf_dir))


_open, _safe = rd.MARKER_ITEM, rd.MARKER_ITEM_STABLE
_flat = lambda tag, end: f"'<ol>' || array_to_string(list_transform({split('text')}, lambda t, i: '{tag}' || i || ')</span> ' || t || '{end}'), '') || '<li>end</li></ol>'"


@register("stabilize_list_markers", f"SELECT doc_id, {_flat(_safe, '</div>')} AS markdown FROM documents")
def _(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    items = F.transform(F.split("text", "\n"), lambda t, i: F.concat(F.lit(_open), i + 1, F.lit(")</span> "), t, F.lit("</li>")))
    return rd.stabilize_list_markers(d.select("doc_id", F.concat(F.lit("<ol>"), F.array_join(items, ""), F.lit("<li>end</li></ol>")).alias("markdown")))


_KINDS = ["Unsupported", "NeedsOcr", "Malformed", "Encrypted", "ResourceLimit", "MissingPart", "Io", "Other"]


@register("conversion_errors", query("dim_convert_errors", f"""SELECT doc_id, CASE WHEN n_chars % 2 = 0 THEN coalesce(error_code, 'conversion_failed') WHEN n_chars < 40 THEN 'pdf_specialist_required' END AS error_code
FROM (SELECT *, {strings(_KINDS)}[doc_id % 8 + 1] AS failure FROM documents) LEFT JOIN dim_convert_errors USING (failure)"""))
def _(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select("doc_id", F.expr("n_chars < 40 AS no_text"), F.when(F.expr("n_chars % 2 = 0"), views.pick(_KINDS, F.col("doc_id") % 8)).alias("failure"))
    return conversion_errors(d)


def conversion_errors(results):
    """Stable code per converter failure; a document without extractable text needs recognition."""
    rows = results.join(dims.dim(results.sparkSession, "convert_errors"), "failure", "left")
    return rows.select("doc_id", F.when(F.col("failure").isNotNull(), F.coalesce("error_code", F.lit("conversion_failed")))
                       .when(F.col("no_text"), "pdf_specialist_required").alias("error_code"))
