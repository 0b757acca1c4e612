"""Texts of facts are normalised once a row, however many filters and columns read them."""
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import match

TEXTS = ["", "a b", " a  b\t", "café x", "a b", "l1\n\n  l2  x\n", "　", "\x1c a", "Å", "x\x85y", "日本 語", None]


def test_normal_lines_are_normalized_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    lines = F.filter(F.transform(F.split(tx.nfc(F.coalesce("t", F.lit(""))), "\n"), tx.collapse_ws), lambda t: t != "")
    got = df.select("i", tx.normal_lines(F.col("t")).alias("n"), tx.normalize_text(F.col("t")).alias("want"), lines.alias("lines")).select(
        F.col("n.norm").cast("string").alias("norm"), F.col("n.lines").cast("array<string>").alias("own"), "want", "lines", "i").collect()
    assert all(r.norm == r.want for r in got) and all(r.own == (r.lines if "\n" in (TEXTS[r.i] or "") else None) for r in got)


def test_a_side_is_normalized_once(spark):
    facts = spark.createDataFrame([(1, "f", "TEXT_BLOCK", "a  b", 0)], "doc_id long, fact_id string, kind string, text string, ord long").select(
        "*", F.lit("SOURCE_EXACT").alias("certainty"), F.lit(None).cast("map<string,string>").alias("attributes"), F.lit(None).cast("map<string,string>").alias("property_certainty"))
    pairs = match.match_text_fifo(match.comparable_source(facts), match.comparable_output(facts.withColumn("arm", F.lit("x"))), F.col("x_text"))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert len([x for x in plan.split("\n") if "ArrowEvalPython" in x]) == 2 and "regexp_replace" not in plan
    assert [(r.source_fact_id, r.output_fact_id) for r in pairs.collect()] == [("f", "f")]
