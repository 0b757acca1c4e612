"""Arrays are computed in projections, which are compiled, and not inside generators."""
from tessera.operators.markdown_facts import exploded, markdown_facts


def test_generators_take_computed_columns(spark):
    text = "# *h*\n\n* a\n  * b [l](/t)\n\n| x | y |\n| --- | --- |\n| 1 | [z] |\n\n[z]: /u\n\nend"
    facts = markdown_facts(spark.createDataFrame([(1, "a", text), (2, "a", None)], "doc_id long, arm string, markdown string"))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    made = [line for line in plan.split("\n") if "Generate " in line]
    assert len(made) >= 4 and not [line for line in made if "regexp" in line or "lambda" in line]
    kinds = [r.kind for r in facts.orderBy("ord").collect()]
    assert kinds == ["HEADING", "LIST_ITEM", "LIST_ITEM", "LINK", "TABLE"] + ["TABLE_CELL"] * 4 + ["LINK", "TEXT_BLOCK"]


def test_exploded_drops_empty_and_null_arrays(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "n long, v array<string>")
    assert sorted(map(tuple, exploded(rows, "v").collect())) == [(1, "a"), (1, "b")]
