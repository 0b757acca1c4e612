"""Compared items are computed once, and what has to meet its partner moves as a short key."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import match
from tessera.operators import metrics as mt
from tessera.plans import queries_scores, registry, views

registry.load()
LONG = "word " * 40


def facts(spark, texts, arm=None):
    rows = spark.createDataFrame([(1, "TEXT_BLOCK", t, i, f"f{i}") for i, t in enumerate(texts)], "doc_id long, kind string, norm string, ord long, fact_id string")
    rows = rows.select("*", F.lit(None).cast("array<string>").alias("lines"), F.lit(None).cast("string").alias("place"), F.lit(None).cast("string").alias("uri"))
    return rows.withColumn("arm", F.lit(arm)) if arm else rows.select("*", *[F.lit(True).alias(f"x_{p}") for p in ("text", "order", "target", "presence", "fact", "place")])


def test_rest_of_long_lines_meets_by_key(spark):
    s, o = facts(spark, [LONG + "a", LONG + "b", LONG + "b", "x y"]), facts(spark, [LONG + "a", LONG + "b", "x z"], "m")
    items = match.compared_items(s, o)
    codes = {r.key: r.code for r in items.collect()}
    assert codes["x z"] == "x z" and len(codes[LONG + "a"]) == 65
    # Two lines have partners, of 41 tokens each; of the rest, "x" of "x z" is in "x y".
    assert [r.matched for r in match.token_overlap(items, s).collect()] == [83]


@pytest.mark.parametrize("name, stores", [("token_multiset_overlap", 2), ("text_metrics", 2), ("ratio_metric", 2), ("order_metrics", 2)])
def test_outputs_move_once_and_are_not_stored(spark, tmp_path, monkeypatch, name, stores):
    path, made = str(tmp_path), []
    for table, rows, schema in (("documents", [(1, "a b\nc", "en", "web", 5)], "doc_id bigint, text string, lang string, source string, n_chars bigint"),
                                ("pages", [(1, "u", "<p>x</p>")], "page_id bigint, url string, html string"),
                                ("conversations", [(0, 0, "user", "t")], "conv_id bigint, turn bigint, role string, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{table}.parquet")
    views.forget(spark)
    for module in (mt, queries_scores):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, real=real: made.append(df) or real(df))
    registry.QUERIES[name](spark, path)
    views.forget(spark)
    assert len(made) == stores and not [df for df in made if {"arm", "fact_id"} <= set(df.columns)]
    plan = made[-1]._jdf.queryExecution().executedPlan().toString().split("\n")
    by_arm = [x for x in plan if "Exchange hashpartitioning" in x and "ENSURE_REQUIREMENTS" in x and "arm" in x]
    assert not by_arm
