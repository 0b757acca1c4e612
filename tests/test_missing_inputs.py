"""Missing facts read only outputs that can miss some."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics as mt
from tessera.operators.markdown_facts import markdown_facts
from tessera.plans import queries_scores, registry, views

registry.load()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    page = "<html><body><h1>Title {0}</h1><p>Some <a href='/a{0}'>link</a></p><ul><li>one</li><li>two</li></ul><table><tr><td>c</td></tr></table></body></html>"
    tables = {
        "documents": ([(i, "# first\n* item\n| a | b |\n[x](/y)" if i else None, "en", "web", 30) for i in range(3)] + [(1, "twice", "en", "web", 5), (None, "none", "en", "web", 4)],
                      "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "pages": ([(i, "https://www.example.org/x", page.format(i)) for i in (0, 1, 1)], "page_id bigint, url string, html string"),
        "conversations": ([(0, t, "user", f"turn {t}") for t in range(3)], "conv_id bigint, turn bigint, role string, text string"),
        "labels": ([(1, 1, 0)], "doc_id bigint, quality int, toxic int")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture
def parsed(spark, monkeypatch):
    views.forget(spark)
    seen = []
    monkeypatch.setattr(views, "markdown_facts", lambda arms: seen.append(arms) or markdown_facts(arms))
    yield seen
    views.forget(spark)


def test_missing_facts_parse_outputs_of_structured_sources_alone(spark, folder, parsed):
    rows = {name: sorted(registry.QUERIES[name](spark, folder).collect()) for name in ("missing_facts", "missing_link_targets")}
    assert {r.format for arms in parsed for r in arms.select("format").distinct().collect()} == set(views.STRUCTURED)
    whole = mt.missing_findings(views.pairs(spark, folder), queries_scores.source_once(spark, folder), queries_scores.output_once(spark, folder))
    whole = sorted(whole.select("doc_id", "arm", "code", "source_fact_id").collect())
    link = lambda r: r.code == "MISSING_LINK_TARGET"
    assert rows == {"missing_facts": [r for r in whole if not link(r)], "missing_link_targets": [r for r in whole if link(r)]}
    assert {r.code for r in whole} == {"MISSING_HEADING", "MISSING_LIST_ITEM", "MISSING_TABLE_CELL", "MISSING_LINK_TARGET"}


def test_other_sources_state_text_blocks_alone(spark, folder, parsed):
    formats = views.documents_of_pairs(spark, folder).filter(~F.col("format").isin(*views.STRUCTURED)).select("doc_id").distinct()
    kinds = views.source_facts(spark, folder).join(formats, "doc_id").select("kind").distinct()
    assert [r.kind for r in kinds.collect()] == ["TEXT_BLOCK"]
