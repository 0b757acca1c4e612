"""Controlled mutations: output arms of a document with a known defect, next to a clean control.

A document comes as one array of blocks, so every arm is an array expression on one row.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .render import finish_document

# --- fixed values: arm -> finding or metric that must react -------------------------------------
EXPECTED = {
    "clean": None, "empty": "EMPTY_OUTPUT", "short": "text_recall", "dup": "EXTRA_OR_DUPLICATED_CONTENT",
    "head": "MISSING_HEADING", "list": "MISSING_LIST_ITEM", "table": "MISSING_TABLE_CELL",
    "swap": "pairwise_order_accuracy", "level": "heading_level_accuracy", "link": "MISSING_LINK_TARGET",
    "invent": "heading_precision",
}
BLOCK = "struct<kind:string,level:int,md:string,changed:string>"


def blocks_markdown(blocks: Column) -> Column:
    """Document text of ``array<BLOCK>``; a list ends with an empty line."""
    def one(b, i):
        after = F.try_element_at(blocks, i + 2)["kind"]
        return (F.when(b["kind"] == "HEADING", F.concat(
                    F.lit("\n"), F.repeat(F.lit("#"), F.least(b["level"], F.lit(6))), F.lit(" "), b["md"], F.lit("\n\n")))
                .when(b["kind"] == "LIST_ITEM", F.concat(
                    F.repeat(F.lit("  "), b["level"]), F.lit("* "), b["md"],
                    F.when(after.eqNullSafe("LIST_ITEM"), F.lit("\n")).otherwise(F.lit("\n\n"))))
                .when(b["kind"] == "TABLE", F.concat(b["md"], F.lit("\n")))
                .otherwise(F.concat(b["md"], F.lit("\n\n"))))
    return finish_document(F.array_join(F.transform(blocks, one), ""))


def _with(b, **fields):
    get = lambda name: fields.get(name, b[name])
    return F.struct(*[get(n).alias(n) for n in ("kind", "level", "md", "changed")])


def _short(blocks: Column) -> Column:
    return F.slice(blocks, 1, F.ceil(F.size(blocks) / 2).cast("int"))


def _swap(blocks: Column) -> Column:
    """Exchange the first block with the last one of another text."""
    first = F.try_element_at(blocks, F.lit(1))
    other = F.array_max(F.transform(blocks, lambda b, i: F.when(b["md"] != first["md"], i)))
    return tx.let(F.coalesce(other, F.lit(0)), lambda o: F.transform(blocks, lambda b, i: (
        F.when(i == 0, F.try_element_at(blocks, (o + 1).cast("int"))).when(i == o, first).otherwise(b))))


def _flatten_list(blocks: Column) -> Column:
    """All list items become one paragraph at the place of the first."""
    is_item = lambda b: b["kind"] == "LIST_ITEM"
    items = F.array_join(F.transform(F.filter(blocks, is_item), lambda b: b["md"]), " ")
    first = F.array_min(F.transform(blocks, lambda b, i: F.when(is_item(b), i)))
    rows = tx.let(F.struct(items.alias("md"), first.alias("at")), lambda run: F.transform(
        blocks, lambda b, i: F.when(i == run["at"], _with(
            b, kind=F.lit("TEXT_BLOCK"), level=F.lit(0), md=run["md"])).otherwise(b)))
    return F.filter(rows, lambda b: ~is_item(b))


def mutated_arms(docs: DataFrame, arms_of_format: dict[str, list[str]]) -> DataFrame:
    """All arms of ``docs(doc_id, format, text, blocks)``, one row per ``(doc_id, arm)``.

    The clean arm of plain text is the text itself; every other arm is rendered from the blocks.
    """
    arm_names = F.element_at(F.create_map(*[c for fmt, names in arms_of_format.items() for c in (
        F.lit(fmt), F.array(*[F.lit(a) for a in names]).cast("array<string>"))]), F.col("format"))
    blocks, arm = F.col("blocks"), F.col("arm")
    remake = lambda wanted, **new: F.transform(blocks, lambda b: F.when(
        wanted(b), _with(b, **{k: f(b) for k, f in new.items()})).otherwise(b))
    heading, is_table = (lambda b: b["kind"] == "HEADING"), (lambda b: b["kind"] == "TABLE")
    mutated = (F.when(arm == "short", _short(blocks))
               .when(arm == "dup", F.concat(blocks, F.slice(blocks, 1, 1)))
               .when(arm == "swap", _swap(blocks))
               .when(arm == "head", remake(heading, kind=lambda b: F.lit("TEXT_BLOCK")))
               .when(arm == "list", _flatten_list(blocks))
               .when(arm == "level", remake(heading, level=lambda b: b["level"] + 1))
               .when(arm == "link", remake(lambda b: ~is_table(b), md=lambda b: b["changed"]))
               .when(arm == "table", remake(is_table, md=lambda b: b["changed"]))
               .otherwise(blocks))
    verbatim = tx.unix_newlines(F.col("text"))
    expected = F.element_at(F.create_map(*[F.lit(v) for kv in EXPECTED.items() if kv[1] for v in kv]), arm)
    rows = docs.select("*", F.explode(arm_names).alias("arm"))
    rows = rows.select("doc_id", "format", "text", "arm", mutated.alias("blocks"))
    return rows.select(
        "doc_id", "format", "arm",
        F.when(arm == "empty", F.lit("")).when((arm == "clean") & F.col("text").isNotNull(), verbatim)
        .when(arm == "invent", F.concat(F.lit("# "), verbatim))
        .otherwise(blocks_markdown(blocks)).alias("markdown"),
        expected.alias("expected_code"))
