"""Views that turn the given tables into the inputs of the operators.

Document ids of the pair corpus carry their format in the last two bits, so one BIGINT key
serves all of them: 0 text (documents), 1 HTML (pages), 2 extracted page text and 3 sheets
(both from conversations, one document each).
"""
import functools
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import url
from ..operators.facts import html_facts, txt_facts
from ..operators.markdown_facts import markdown_facts
from ..operators.mutations import BLOCK, mutated_arms
from ..operators.numbering import number_in_group
from ..operators.render import gfm_cell, gfm_table
from ..session import by_document, tune

# --- parameters of the derived inputs ----------------------------------------------------------
EXTENSIONS = [".txt", ".TXT", ".docx", ".DOCX", ".pdf", ".xlsx", ".pptx", ".csv", ".tsv", ".json",
              ".html", ".HTM", ".doc", ".xls", ".ppt", ".odt", ".ods", ".odp", ".epub", ".PNG",
              ".jpeg", ".zip", ".tar.gz", ".xyz", "", ".Md"]
SHEET_NAMES = ["Summary", "Sales:2026", "CON", "Trailing. ", "Données", "summary"]
ARMS = {
    "txt": ["clean", "empty", "short", "dup", "swap", "invent"],
    "html": ["clean", "empty", "short", "dup", "swap", "head", "list", "level", "link"],
    "pdf": ["clean"],
    "xlsx": ["clean", "empty", "table"],
}
# Formats whose sources state headings, list items, table cells or links. Plain text and page text are text
# blocks alone, by their fact operators, so nothing of these kinds can be missing from their outputs.
STRUCTURED = ("html", "xlsx")
ROOT, OUT = "/corpus", "/out"


_plans = weakref.WeakKeyDictionary()


def view(build):
    """Build a view once per session and folder.

    Most views are plans alone; those that checkpoint (comparable facts, wide rows, scores) hold the
    data of their first use. ``forget`` drops both after files in a folder have changed.
    """
    @functools.wraps(build)
    def cached(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
        of_session = _plans.setdefault(spark, {})
        key = (build.__name__, sf_dir, *more)
        if key not in of_session:
            of_session[key] = build(spark, sf_dir, *more)
        return of_session[key]
    return cached


def forget(spark: SparkSession) -> None:
    """Build all views of a session anew."""
    _plans.pop(spark, None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


@view
def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(relative_path, text)``: all documents under known extensions and odd names."""
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    folder = (F.when(n % 41 == 40, F.lit("_converted/")).when(n % 43 == 42, F.lit("../"))
              .otherwise(F.concat(F.col("source"), F.lit("/"))))
    name = F.concat(F.when(n % 37 == 36, F.lit("~$d")).when(n % 5 == 4, F.lit("D")).otherwise(F.lit("d")),
                    F.floor(n / len(EXTENSIONS)))
    return d.select(F.concat(folder, name, pick(EXTENSIONS, n % len(EXTENSIONS))).alias("relative_path"), "text")


@view
def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(relative_path, text)`` of all documents and pages."""
    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("web/p"), k, pick([".html", ".htm", ".HTML"], k % 3)).alias("relative_path"), F.col("html").alias("text"))
    return named_documents(spark, sf_dir).unionByName(pages)


@view
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows of all documents and pages."""
    return named_files(spark, sf_dir).select(
        F.concat(F.lit(ROOT + "/"), "relative_path").alias("source_path"), "relative_path",
        F.octet_length("text").cast("bigint").alias("size_bytes"), F.sha2(F.encode("text", "UTF-8"), 256).alias("content_sha256"))


@view
def worksheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array of sheets per workbook of the inventory; null where inspection was not done."""
    n = F.conv(F.substring("content_sha256", 1, 6), 16, 10).cast("bigint")
    f = files(spark, sf_dir).withColumn("n", n).filter(F.lower("relative_path").rlike(r"\.xlsx?$"))
    sheet = lambda i: F.struct(
        pick(SHEET_NAMES, (F.col("n") + i) % len(SHEET_NAMES)).alias("name"),
        (i + 1).cast("int").alias("index"),
        pick(["visible", "hidden", "veryHidden"], F.when((F.col("n") + i) % 4 == 0, 1 + i % 2).otherwise(0)).alias("visibility"),
        ((F.col("n") + i) % 5 == 0).alias("is_empty"))
    count = (F.col("n") % 4).cast("int")
    sheets = F.transform(F.filter(F.sequence(F.lit(0), F.lit(3)), lambda i: i < count), sheet)
    return f.select(
        "relative_path",
        F.when(F.col("n") % 11 == 0, "worksheet_inspection_failure").alias("inspection_error"),
        F.when(F.col("n") % 13 != 0, sheets).alias("worksheets"))


@view
def existing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result files that are already there: those of documents with a toxic label."""
    lab = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(lab, "doc_id")
    n = F.col("doc_id")
    return d.select(F.concat(
        F.lit(OUT + "/"), F.col("source"), F.lit("/D"), F.floor(n / len(EXTENSIONS)),
        pick([".md", ".MD", ".txt", ".xlsx"], n % 4)).alias("target_path")).distinct()


# --- the pair corpus ---------------------------------------------------------------------------
@view
def txt_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document(table(spark, sf_dir, "documents").select((F.col("doc_id") * 4).alias("doc_id"), "text"))


@view
def html_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_document(table(spark, sf_dir, "pages").select((F.col("page_id") * 4 + 1).alias("doc_id"), "html"))


def turns(spark: SparkSession, sf_dir: str, bits: int) -> DataFrame:
    """Turns of a conversation, which is one document however long it is."""
    c = table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 4 + bits).alias("doc_id"), F.col("turn").cast("int").alias("turn"), "role", "text")


@view
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred facts of extracted pages; long documents are numbered in ranges of pages."""
    rows = turns(spark, sf_dir, 2).withColumn("text", tx.collapse_ws(F.col("text"))).filter("text <> ''")
    rows = number_in_group(rows, ["doc_id"], "turn", "ord")
    return rows.select(
        "doc_id", F.concat(F.lit("text:"), F.col("ord") + 1).alias("fact_id"), F.lit("TEXT_BLOCK").alias("kind"),
        "text", F.col("ord").cast("bigint").alias("ord"),
        F.concat(F.lit("pdf/page["), F.col("turn") + 1, F.lit("]")).alias("location"),
        F.lit("INFERRED").alias("certainty"),
        F.create_map(F.lit("page"), (F.col("turn") + 1).cast("string")).alias("attributes"),
        F.lit(None).cast("map<string,string>").alias("property_certainty"))


SHEET_HEADER = ["turn", "role", "text"]


@view
def sheet_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per sheet document; in every third sheet the turn column is a cached formula."""
    t = turns(spark, sf_dir, 3)
    heads = t.groupBy("doc_id").agg((F.max("turn") + 1).alias("last"))
    values = F.array(F.col("turn").cast("string"), F.col("role"), F.col("text"))
    cell_type = "array<struct<row:int,col:int,text:string>>"
    t = number_in_group(t, ["doc_id"], "turn", "nth")
    cells = t.select("doc_id", (F.col("nth") * 3 + 4).alias("first"), F.explode(F.transform(values, lambda v, i: F.struct(
        (F.col("turn") + 1).alias("row"), i.alias("col"), v.alias("text"))).cast(cell_type)).alias("c"))
    header = heads.select("doc_id", F.lit(1).cast("bigint").alias("first"), F.explode(F.array(*[
        F.struct(F.lit(0).alias("row"), F.lit(i).alias("col"), F.lit(h).alias("text"))
        for i, h in enumerate(SHEET_HEADER)]).cast(cell_type)).alias("c"))
    marker = heads.select("doc_id", F.lit(1).cast("bigint").alias("first"), F.struct(
        F.lit(-1).alias("row"), F.lit(-1).alias("col"), F.lit(None).alias("text")).cast(cell_type[6:-1]).alias("c"))
    rows = cells.unionByName(header).unionByName(marker).select("doc_id", "first", "c.*").join(heads, "doc_id")
    rows = rows.withColumn("ord", F.col("first") + F.col("col"))           # the table itself comes before its cells
    is_table = F.col("row") == -1
    s = lambda c: F.col(c).cast("string")
    formula = (F.floor(F.col("doc_id") / 4) % 3 == 0) & (F.col("col") == 0) & (F.col("row") > 0)
    certainty = F.when(formula, "INFERRED").when((F.col("col") == 0) & (F.col("row") > 0), "DERIVED_EXACT").otherwise("SOURCE_EXACT")
    return rows.select(
        "doc_id", F.when(is_table, F.lit("table:1")).otherwise(F.concat_ws(":", F.lit("table:1:cell"), s("row"), s("col"))).alias("fact_id"),
        F.when(is_table, "TABLE").otherwise("TABLE_CELL").alias("kind"), "text",
        F.col("ord").cast("bigint").alias("ord"),
        F.when(is_table, F.lit("xl/sheet1")).otherwise(F.concat(F.lit("xl/sheet1/R"), s("row"), F.lit("C"), s("col"))).alias("location"),
        F.lit("SOURCE_EXACT").alias("certainty"),
        F.when(is_table, F.create_map(F.lit("rows"), (F.col("last") + 1).cast("string"), F.lit("columns"), F.lit("3")))
        .otherwise(F.create_map(F.lit("tableId"), F.lit("table:1"), F.lit("row"), s("row"), F.lit("column"), s("col"))).alias("attributes"),
        F.when(~is_table, F.create_map(F.lit("text"), certainty)).alias("property_certainty"))


@view
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (txt_facts(txt_corpus(spark, sf_dir))
            .unionByName(html_source_facts(spark, sf_dir))
            .unionByName(page_facts(spark, sf_dir))
            .unionByName(sheet_facts(spark, sf_dir)))


def page_blocks(facts: DataFrame) -> DataFrame:
    """Blocks of a page in order: headings, paragraphs and items with their links inlined.

    A link belongs to the block before it and replaces the next occurrence of its text there.
    """
    is_block = F.col("kind").isin("HEADING", "TEXT_BLOCK", "LIST_ITEM")
    read = W.partitionBy("doc_id").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    rows = facts.filter(is_block | (F.col("kind") == "LINK")).select(
        "doc_id", "ord", "kind", "text", F.element_at("attributes", "level").cast("int").alias("level"),
        F.element_at("attributes", "target").alias("target"),
        F.last(F.when(is_block, F.col("ord")), ignorenulls=True).over(read).alias("block")).filter("block is not null")
    link = F.struct("ord", F.col("text").alias("text"), F.col("target").alias("target"))
    grouped = rows.groupBy("doc_id", "block").agg(
        F.max(F.when(is_block, F.col("kind"))).alias("kind"),
        F.max(F.when(is_block, F.col("text"))).alias("text"),
        F.max(F.when(is_block, F.coalesce("level", F.lit(0)))).alias("level"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "LINK", link))).alias("links"))

    def inlined(suffix: str) -> Column:
        def step(state, l):
            at = F.instr(state["rest"], l["text"])
            found = (at > 0) & (l["text"] != "")
            before = F.when(found, F.substring(state["rest"], F.lit(1), at - 1)).otherwise("")
            rest = F.when(found, F.substring(state["rest"], at + F.length(l["text"]), F.length(state["rest"]))).otherwise(state["rest"])
            piece = F.concat(tx.escape_markdown(before), F.lit("["), tx.escape_markdown(l["text"]), F.lit("]("),
                             url.markdown_link_url(F.concat(l["target"], F.lit(suffix))), F.lit(")"))
            return F.struct(F.concat(state["done"], piece).alias("done"), rest.alias("rest"))
        start = F.struct(F.lit("").alias("done"), F.col("text").alias("rest"))
        whole = F.aggregate("links", start, step, lambda s: F.concat(s["done"], tx.escape_markdown(s["rest"])))
        return F.when(F.size("links") == 0, tx.escape_markdown(F.col("text"))).otherwise(whole)

    return grouped.select("doc_id", F.col("block").alias("ord"), "kind", "level", "text",
                          inlined("").alias("md"), inlined("/changed").alias("changed"))


@view
def pair_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, format, text, blocks)`` of the whole pair corpus."""
    none = F.lit(None).cast("string")
    block = lambda kind, md, changed=None: F.struct(
        F.lit(kind).alias("kind"), F.lit(0).alias("level"), md.alias("md"), (md if changed is None else changed).alias("changed")).cast(BLOCK)
    lines = F.filter(F.split(tx.unix_newlines(F.col("text")), "\n"), lambda t: F.length(t) > 0)
    txt = txt_corpus(spark, sf_dir).select(
        "doc_id", F.lit("txt").alias("format"), "text", F.transform(lines, lambda t: block("TEXT_BLOCK", t)).alias("blocks"))
    blocks = page_blocks(html_source_facts(spark, sf_dir)).groupBy("doc_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("ord", "kind", "level", "md", "changed"))),
                    lambda b: F.struct(b["kind"].alias("kind"), b["level"].alias("level"), b["md"].alias("md"),
                                       b["changed"].alias("changed")).cast(BLOCK)).alias("blocks"))
    html = html_corpus(spark, sf_dir).select("doc_id").join(blocks, "doc_id", "left").select(
        "doc_id", F.lit("html").alias("format"), none.alias("text"),
        F.coalesce("blocks", F.array().cast(f"array<{BLOCK}>")).alias("blocks"))
    ordered = lambda value: F.transform(F.sort_array(F.collect_list(F.struct("turn", value.alias("v")))), lambda r: r["v"])
    pdf = turns(spark, sf_dir, 2).groupBy("doc_id").agg(
        F.transform(ordered(tx.escape_markdown(F.col("text"))), lambda t: block("TEXT_BLOCK", t)).alias("blocks"))
    pdf = pdf.select("doc_id", F.lit("pdf").alias("format"), none.alias("text"), "blocks")
    row = F.array(F.col("turn").cast("string"), *[gfm_cell(tx.escape_markdown(F.col(c))) for c in ("role", "text")])
    header = F.array(F.array(*[F.lit(h) for h in SHEET_HEADER]))
    sheet = turns(spark, sf_dir, 3).groupBy("doc_id").agg(F.concat(header, ordered(row)).alias("rows"))
    xlsx = sheet.select("doc_id", F.lit("xlsx").alias("format"), none.alias("text"), F.array(block(
        "TABLE", gfm_table(F.col("rows"), F.lit(1)),
        gfm_table(F.slice(F.col("rows"), 1, F.size("rows") - 1), F.lit(1)))).alias("blocks"))
    return txt.unionByName(html).unionByName(pdf).unionByName(xlsx)


@view
def arms(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = None) -> DataFrame:
    """``(doc_id, format, arm, markdown, expected_code)``: every document under every arm, or under the named ones."""
    return mutated_arms(pair_documents(spark, sf_dir), named_arms(names))


@view
def html_source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_facts(html_corpus(spark, sf_dir))


@view
def documents_of_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, format)`` of the pair corpus, straight from the keys."""
    named = lambda df, fmt: df.select("doc_id", F.lit(fmt).alias("format"))
    return (named(txt_corpus(spark, sf_dir), "txt").unionByName(named(html_corpus(spark, sf_dir), "html"))
            .unionByName(named(turns(spark, sf_dir, 2).select("doc_id").distinct(), "pdf"))
            .unionByName(named(turns(spark, sf_dir, 3).select("doc_id").distinct(), "xlsx")))


def named_arms(names: tuple[str, ...] = None) -> dict[str, list[str]]:
    """The arms of each format, all or the named ones."""
    return {f: [a for a in own if names is None or a in names] for f, own in ARMS.items()}


@view
def pairs(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = None) -> DataFrame:
    """``(doc_id, format, arm)``: the driving table of all comparisons."""
    of_format = F.create_map(*[c for f, a in named_arms(names).items() for c in (F.lit(f), F.array(*map(F.lit, a)).cast("array<string>"))])
    return documents_of_pairs(spark, sf_dir).select("*", F.explode(F.element_at(of_format, F.col("format"))).alias("arm"))


@view
def output_facts(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = None) -> DataFrame:
    return markdown_facts(arms(spark, sf_dir, names))


@view
def structured_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output facts under all arms of the documents whose sources state more than text blocks."""
    docs = pair_documents(spark, sf_dir).filter(F.col("format").isin(*STRUCTURED))
    return markdown_facts(mutated_arms(docs, named_arms()))


@view
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the pages, numbered from 0 inside their page."""
    rows = html_source_facts(spark, sf_dir).filter("kind = 'LINK'")
    nth = (F.row_number().over(W.partitionBy("doc_id").orderBy("ord")) - 1).cast("int")
    return rows.select("doc_id", nth.alias("n"), "text", F.element_at("attributes", "target").alias("target"))


SITE = "https://www.example.org"


@view
def reference_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as Markdown of its links alone: full, collapsed and shortcut references and bare links.

    Definitions stand before and after their use; a second one of the same label must not count.
    """
    text, n = tx.escape_markdown(F.col("text")), F.col("n").cast("string")
    target = F.concat(F.lit("<"), F.col("target"), F.lit(">"))
    c = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    style = F.col("n") % 4
    own = (F.when(style == 0, c("[", text, "][Ref ", n, "]")).when(style == 1, c("[", text, " ", n, "][]"))
           .when(style == 2, c("[", n, " ", text, "]")).otherwise(c("see ", SITE, F.col("target"), " ok")))
    before = F.when(style == 1, c("[", text, "  ", n, "]: ", target, " 'early'")).otherwise("")
    after = (F.when(style == 0, c("[rEF\t", n, "]: ", target, "\n  \"late ", n, "\""))
             .when(style == 2, c("[", n, "  ", text, "]: ", target, "\n[", n, " ", text, "]: /second")).otherwise(""))
    parts = F.sort_array(F.collect_list(F.struct("n", own.alias("own"), before.alias("before"), after.alias("after"))))
    lines = lambda field: F.filter(F.transform(parts, lambda x: x[field]), lambda x: x != "")
    return page_links(spark, sf_dir).groupBy("doc_id").agg(F.concat(
        F.array_join(lines("before"), "\n"), F.lit("\n\n"), F.array_join(lines("own"), "\n\n"), F.lit("\n\n"), F.array_join(lines("after"), "\n")).alias("markdown")
    ).select("doc_id", F.lit("refs").alias("arm"), "markdown")


@view
def reference_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown_facts(reference_arms(spark, sf_dir))
