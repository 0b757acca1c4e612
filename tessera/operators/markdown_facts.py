"""Facts of Markdown outputs: blocks of a text and their inlines in one pass over its lines.

Dialect: ATX and setext headings, paragraphs, nested lists, pipe tables, fences, indented code,
quotes, raw HTML blocks, rules, link reference definitions; inline rules are in
``functions.markdown``. Code, raw HTML blocks and definitions yield nothing by themselves.

Definitions and the pieces of text that name their labels are met while a text is read
(``markdown_blocks``). A piece then carries the definitions it names, not all of its document.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions.text import unix_newlines
from .markdown_blocks import ATX, DELIMITER, FENCE, ITEM, with_blocks  # noqa: F401 (the twins read them here)


def exploded(rows: DataFrame, name: str) -> DataFrame:
    """Explode a computed array column.

    Inside a generator an expression is interpreted; in the projection before it, it is compiled. ``coalesce``
    keeps the planner from inferring a filter on the bare column, which would compute the array twice.
    """
    every = F.coalesce(F.col(name), F.array().cast(rows.schema[name].dataType))
    return rows.select(*[c for c in rows.columns if c != name], F.explode(every).alias(name))


def _real_fences(lines: Column) -> Column:
    """Line numbers of fences that open or close a code block."""
    numbered = F.transform(lines, lambda t, i: F.struct(i.alias("no"), F.trim(t).alias("t")))
    fences = F.filter(numbered, lambda s: s["t"].rlike(FENCE))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<int>").alias("at"))

    def step(state, s):
        run = F.regexp_extract(s["t"], "^(`+|~+)", 1)
        closing = (state["open"] != "") & s["t"].rlike("^(`+|~+)$") & run.startswith(state["open"])
        grown = F.concat(state["at"], F.array(s["no"]))
        return (F.when(state["open"] == "", F.struct(run.alias("open"), grown.alias("at")))
                .when(closing, F.struct(F.lit("").alias("open"), grown.alias("at")))
                .otherwise(state))

    return F.when(F.exists(lines, lambda t: t.rlike(FENCE)), F.aggregate(fences, start, step)["at"])


def markdown_lines(arms: DataFrame) -> DataFrame:
    """Lines of ``arms(doc_id, arm, markdown)``, each marked when it is a real code fence."""
    text = F.col("markdown")
    lines = F.split(F.when(text.contains("\r"), unix_newlines(text)).otherwise(text), "\n")
    fenced = text.contains("```") | text.contains("~~~")
    rows = arms.select("doc_id", "arm", md.may_define(text).alias("defines"), fenced.alias("fenced"), lines.alias("lines"))
    rows = rows.select("doc_id", "arm", "defines", "lines", F.when(F.col("fenced"), _real_fences(F.col("lines"))).alias("fences"))
    # Exploded as an expression: of a bare column the planner would infer a filter, and render every text once more for it.
    every = F.coalesce("lines", F.array().cast("array<string>"))
    rows = rows.select("doc_id", "arm", "defines", "fences", F.posexplode(every).alias("no", "raw"))
    return rows.select("doc_id", "arm", "defines", "no", "raw",
                       F.coalesce(F.array_contains("fences", F.col("no")), F.lit(False)).alias("fence"))


def markdown_facts(arms: DataFrame) -> DataFrame:
    """Facts of every ``(doc_id, arm)`` in ``arms``; order is dense from 0 per output."""
    rows = with_blocks(arms, "p")
    for _ in ("blocks", "items or rows", "pieces", "facts"):
        rows = exploded(rows, "p")
    rows = rows.select("doc_id", "arm", "p.*").withColumns({c: F.col(c).cast("string") for c in ("text", "target", "title")})
    # Row numbers skip the delimiter line below the header.
    row = F.col("start") - F.col("tbl") - F.when(F.col("start") > F.col("tbl"), 1).otherwise(0)
    is_cell = F.col("kind") == "TABLE_CELL"
    rows = rows.select("*", row.alias("row"))
    table_id = F.concat(F.lit("table:"), F.col("nth"))
    s = lambda c: F.col(c).cast("string")
    prefix = F.create_map(*[F.lit(x) for k in ("HEADING", "TEXT_BLOCK", "LIST_ITEM", "LINK", "IMAGE") for x in (k, k.lower().replace("_", "-") + ":")])
    fact_id = (F.when(F.col("kind") == "TABLE", table_id)
               .when(is_cell, F.concat_ws(":", table_id, F.lit("cell"), F.col("row"), F.col("col")))
               .otherwise(F.concat(F.element_at(prefix, F.col("kind")), F.col("nth"))))
    present = lambda m: F.map_filter(m, lambda k, v: F.coalesce(v, F.lit("")) != "")
    attributes = (
        F.when(F.col("kind") == "HEADING", F.create_map(F.lit("level"), s("heading_level")))
        .when(F.col("kind") == "LIST_ITEM", F.create_map(
            F.lit("level"), s("level"), F.lit("ordered"), s("ordered")))
        .when(F.col("kind") == "TABLE", F.create_map(F.lit("rows"), s("n_rows"), F.lit("columns"), s("n_cols")))
        .when(is_cell, F.create_map(
            F.lit("tableId"), table_id, F.lit("row"), s("row"), F.lit("column"), s("col"),
            F.lit("columnSpan"), F.lit("1"), F.lit("rowSpan"), F.lit("1"),
            F.lit("header"), (F.col("row") == 0).cast("string")))
        .when(F.col("kind").isin("LINK", "IMAGE"), present(F.create_map(
            F.lit("target"), F.col("target"), F.lit("title"), F.col("title")))))
    return rows.select("doc_id", "arm", fact_id.alias("fact_id"), "kind", "text", "ord",
                       F.concat(F.lit("line:"), F.col("start") + 1).alias("location"),
                       attributes.alias("attributes"))
