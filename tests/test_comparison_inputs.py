"""What the queries of the comparison read, store and leave out."""
import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators import match
from tessera.operators import metrics as mt
from tessera.plans import queries_corpus, queries_scores, registry, views

registry.load()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    page = "<html><body><h1>Title {0}</h1><p>Some <a href='/a{0}'>link</a> here</p><ul><li>one</li><li>two</li></ul><table><tr><td>c</td></tr></table></body></html>"
    tables = {
        "documents": ([(i, f"first line {i}\nsecond line\n\nsecond line" if i else None, "en", "web", 30) for i in range(4)],
                      "doc_id bigint, text string, lang string, source string, n_chars bigint"),
        "pages": ([(i, "https://www.example.org/x", page.format(i)) for i in range(2)], "page_id bigint, url string, html string"),
        "conversations": ([(0, t, "user", f"turn {t}") for t in range(3)], "conv_id bigint, turn bigint, role string, text string"),
        "labels": ([(1, 1, 0)], "doc_id bigint, quality int, toxic int")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path


@pytest.fixture
def cuts(spark, monkeypatch):
    views.forget(spark)
    made = []
    for module in (mt, queries_scores, queries_corpus):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, real=real: made.append(df.columns) or real(df))
    yield made
    views.forget(spark)


@pytest.mark.parametrize("name", ["count_metrics", "match_text_fifo", "missing_facts"])
def test_facts_read_once_are_not_stored(spark, folder, cuts, name):
    registry.QUERIES[name](spark, folder)
    assert cuts == []


def test_output_read_once_is_not_stored(spark, folder, cuts):
    registry.QUERIES["attribute_agreement"](spark, folder)
    assert len(cuts) == 1 and "arm" not in cuts[0]


def test_opportunities_leave_the_outputs_alone(spark, folder, cuts, monkeypatch):
    monkeypatch.setattr(views, "markdown_facts", lambda arms: pytest.fail("outputs are read"))
    rows = registry.QUERIES["opportunities"](spark, folder)
    assert cuts == [] and rows.count() == 16 * (4 + 2 + 1 + 1)


def test_compared_corpora_take_their_two_arms(spark, folder, cuts, monkeypatch):
    class Seen(Exception):
        pass

    def stop(arms):
        raise Seen({r.arm for r in arms.select("arm").distinct().collect()})

    monkeypatch.setattr(views, "markdown_facts", stop)
    with pytest.raises(Seen) as seen:
        registry.QUERIES["unexpected_documents"](spark, folder)
    assert seen.value.args[0] == {"swap", "dup"}


def test_pairs_of_places_alone(spark):
    s = spark.createDataFrame([(1, k, "a", i, p, p is not None, True) for i, (k, p) in enumerate(
        [("HEADING", "1"), ("HEADING", None), ("HEADING", "2"), ("TEXT_BLOCK", None), ("LIST_ITEM", "0")])],
        "doc_id long, kind string, norm string, ord long, place string, x_place boolean, x_order boolean")
    o = spark.createDataFrame([(1, "x", k, "a", i, "1") for i, k in enumerate(["HEADING", "TEXT_BLOCK", "HEADING", "LIST_ITEM", "LIST_ITEM"])],
                              "doc_id long, arm string, kind string, norm string, ord long, place string")
    whole = match.place_and_order_pairs(s, o).filter(F.col("cls") == "place")
    alone = match.place_and_order_pairs(s, o, ["place"])
    assert sorted(alone.select(whole.columns).collect()) == sorted(whole.collect()) and alone.count() == 3
    assert not mt.reads_outputs(["order_anchor_coverage", "evaluation_coverage_exact"]) and mt.reads_outputs(["table_count_recall"])


def test_coverage_leaves_the_outputs_alone(spark, folder, cuts, monkeypatch):
    monkeypatch.setattr(views, "markdown_facts", lambda arms: pytest.fail("outputs are read"))
    rows = registry.QUERIES["coverage_metric"](spark, folder)
    assert cuts == [] and rows.count() == 4 * 6 + 2 * 9 + 1 + 3


def test_matched_facts_move_once_and_without_their_texts(spark):
    long, digest = "x" * 200, "#" + hashlib.sha256(b"x" * 200).hexdigest()
    rows = lambda texts: [(1, "TEXT_BLOCK", t, i, f"f{i}", None) for i, t in enumerate(texts)]
    types = "doc_id long, kind string, norm string, ord long, fact_id string, place string"
    s = spark.createDataFrame(rows([long, long + "y", "a", long, "", "b" * 64]), types)
    o = spark.createDataFrame(rows(["b" * 64, digest, long, "a", "a", long, long + "z", "", long]), types).withColumn("arm", F.lit("m"))
    pairs = match.match_text_fifo(s, o)
    assert sorted((r.source_ord, r.output_ord) for r in pairs.collect()) == [(0, 2), (2, 3), (3, 5), (5, 0)]
    with_join = match.match_text_fifo(s, o).hint("merge")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in with_join.split("\n") if "Exchange hashpartitioning" in line]
    assert moved and all("hashpartitioning(doc_id#" in line and line.count("#") == 1 + line.count("plan_id=#") for line in moved)
