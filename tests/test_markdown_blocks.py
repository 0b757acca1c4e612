"""Outputs are read in one pass: no window, no sort of lines, and facts come numbered."""
from pyspark.sql import functions as F

from tessera.operators.markdown_blocks import facts_of
from tessera.operators.markdown_facts import markdown_facts
from tessera.session import by_document, tune


def flat(text, defines=True):
    return [tuple(f) for block in facts_of([(text, defines)]) for row in block for piece in row for f in piece]


def test_lines_and_facts_are_not_sorted(spark):
    rows = spark.createDataFrame([(1, "a", "# h\n\ntext")], "doc_id long, arm string, markdown string")
    plan = markdown_facts(by_document(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert "Generate" in plan and "ArrowEvalPython" in plan


def test_order_and_numbers_of_facts():
    found = flat("# a [l](/t)\n\n![i](/p \"t\") *b*\n\n| x | y |\n| - | - |\n| 1 | http://a.bc |\n\nend")
    assert [(f[2], f[3], f[4], f[5]) for f in found] == [
        ("HEADING", 0, 1, "a l"), ("LINK", 1, 1, "l"), ("TEXT_BLOCK", 2, 1, "i b"), ("IMAGE", 3, 1, "i"), ("TABLE", 4, 1, None), ("TABLE_CELL", 5, 1, "x"),
        ("TABLE_CELL", 6, 1, "y"), ("TABLE_CELL", 7, 1, "1"), ("TABLE_CELL", 8, 1, "http://a.bc"), ("LINK", 9, 2, "http://a.bc"), ("TEXT_BLOCK", 10, 2, "end")]
    assert [f[12:14] for f in found if f[2] == "TABLE"] == [(2, 2)] and found[3][6:8] == ("/p", "t")


def test_levels_fences_and_definitions():
    assert [f[9] for f in flat("- a\n  - b\n    - c\n- d\n\n1. x\n   1. y") if f[2] == "LIST_ITEM"] == [0, 1, 2, 0, 0, 1]
    assert [f[5] for f in flat("```\n# no\n```\nyes\n\n    code\n\n<div>\n# no\n\nlast")] == ["yes", "last"]
    assert [(f[2], f[5], f[6]) for f in flat("[A  b][] [q]\n\n[a B]: </u>\n[a b]: /second")] == [("TEXT_BLOCK", "A  b [q]", None), ("LINK", "A  b", "/u")]
    assert [f[5] for f in flat("a\x85\n # b\n　\nc")] == ["a\x85\n # b", "c"]


def test_rows_of_one_key_are_one_document(spark):
    rows = spark.createDataFrame([(1, "a", "# h\n\nx"), (1, "a", "# h\n\nx"), (None, "a", "y"), (2, "a", None), (3, "a", "")], "doc_id long, arm string, markdown string")
    found = sorted((r.doc_id or 0, r.ord, r.kind, r.text) for r in markdown_facts(rows).collect())
    assert found == [(0, 0, "TEXT_BLOCK", "y"), (1, 0, "HEADING", "h\nh"), (1, 1, "TEXT_BLOCK", "x\nx")]


def test_text_that_is_not_utf8_stays(spark):
    rows = spark.createDataFrame([(1, "a", bytearray(b"ok \xff\xfe end"))], "doc_id long, arm string, b binary")
    found = markdown_facts(rows.select("doc_id", "arm", F.col("b").cast("string").alias("markdown")))
    assert found.select(F.col("text").cast("binary").alias("t")).first().t == b"ok \xff\xfe end"


def test_batches_of_texts_are_bounded(spark):
    tune(spark)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    texts = spark.range(4500).select(F.col("id").alias("doc_id"), F.lit("a").alias("arm"), F.concat(F.lit("# h\n\n"), "id").alias("markdown"))
    assert markdown_facts(texts.coalesce(1)).filter("ord = 1 AND text = cast(doc_id AS string)").count() == 4500
