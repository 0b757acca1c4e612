"""Queries on corpora: plan checks, coverage, strata, formats, corpus scores, paired comparison.

Two corpora are compared: the outputs of the ``swap`` and of the ``dup`` arm. Byte-identical copies
count once, so copies in the ``labelled`` plan are missing from the scores; documents with table
rows are scored under a stratum of their own, which that plan does not know.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus as co
from ..session import stored
from . import views
from .oracle import cte, query
from .queries_scores import score_tables
from .registry import register
from .views import view

ARMS = ("swap", "dup")
_STRATUM = "source || '/' || lang"
cte("uniq", "", "SELECT d.* FROM documents d JOIN (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text) USING (doc_id)")
cte("plan", "uniq", f"""
SELECT 'labelled' AS plan_id, '1' AS plan_version, 'txt' AS format, {_STRATUM} AS stratum, doc_id * 4 AS doc_id FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'unique', '1', 'txt', {_STRATUM}, doc_id * 4 FROM uniq WHERE NOT contains(text, ' | ')
UNION ALL SELECT 'unique', '1', 'html', regexp_extract(url, 'example\\.([a-z]+)', 1), page_id * 4 + 1 FROM pages""")
cte("bad_plan", "", f"""
SELECT 'bad' AS plan_id, '1' AS plan_version, 'txt' AS format, CASE WHEN quality = 0 AND toxic = 1 THEN ' ' ELSE {_STRATUM} END AS stratum, doc_id FROM documents JOIN labels USING (doc_id)
UNION ALL SELECT 'bad', '1', 'txt', {_STRATUM}, doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1""")
cte("placed", "uniq", f"""SELECT doc_id * 4 AS doc_id, CASE WHEN contains(text, ' | ') THEN 'tables' ELSE {_STRATUM} END AS stratum FROM uniq
UNION ALL SELECT page_id * 4 + 1, regexp_extract(url, 'example\\.([a-z]+)', 1) FROM pages""")
cte("corpus_scores", "doc_scores placed", "SELECT d.*, p.stratum FROM doc_scores d JOIN placed p USING (doc_id) WHERE arm IN ('swap', 'dup')")
cte("covered", "plan corpus_scores", """
SELECT a.arm, p.*, CASE WHEN s.doc_id IS NULL THEN 'MISSING' WHEN s.format <> p.format OR s.stratum <> p.stratum THEN 'PLAN_MISMATCH' ELSE s.status END AS status, s.score,
  CASE WHEN s.doc_id IS NULL OR s.format <> p.format OR s.stratum <> p.stratum THEN 'NOT_ELIGIBLE' ELSE s.eligibility END AS eligibility, s.methodology_version, s.target_profile
FROM plan p CROSS JOIN (VALUES ('swap'), ('dup')) a(arm) LEFT JOIN corpus_scores s ON s.doc_id = p.doc_id AND s.arm = a.arm""")
_mean = "round_even(sum(score::DECIMAL(20, 10))::DOUBLE / count(score), 1)"
cte("strata", "covered", f"""
SELECT arm, plan_id, plan_version, format, stratum, CASE WHEN eligible = expected THEN 'ELIGIBLE' WHEN missing THEN 'NOT_ELIGIBLE_MISSING_DOCUMENT'
    WHEN mismatch THEN 'NOT_ELIGIBLE_PLAN_MISMATCH' ELSE 'NOT_ELIGIBLE_DOCUMENT_EVIDENCE' END AS status, CASE WHEN eligible = expected THEN mean END AS score,
  expected AS expected_documents, present AS present_documents, eligible AS eligible_documents
FROM (SELECT arm, plan_id, plan_version, format, stratum, count(*) AS expected, count(*) FILTER (status <> 'MISSING') AS present,
    count(*) FILTER (eligibility = 'ELIGIBLE_DOCUMENT_LEVEL' AND score IS NOT NULL) AS eligible, bool_or(status = 'MISSING') AS missing,
    bool_or(status = 'PLAN_MISMATCH') AS mismatch, {_mean} AS mean FROM covered GROUP BY ALL)""")
_up = lambda keys, src: f"""SELECT arm, {keys}, CASE WHEN ok THEN 'ELIGIBLE' ELSE 'NOT_ELIGIBLE' END AS status, CASE WHEN ok THEN mean END AS score, members
FROM (SELECT arm, {keys}, bool_and(status = 'ELIGIBLE' AND score IS NOT NULL) AS ok, {_mean} AS mean, count(*) AS members FROM {src} GROUP BY ALL)"""
cte("formats", "strata", _up("plan_id, plan_version, format", "strata"))
cte("corpus", "formats", _up("plan_id, plan_version", "formats"))
cte("both_arms", "covered", """SELECT l.plan_id, l.doc_id, l.score AS left_score, r.score AS right_score FROM covered l JOIN covered r USING (plan_id, doc_id) WHERE l.arm = 'swap' AND r.arm = 'dup'""")


def _unique_documents(spark, sf_dir) -> DataFrame:
    d = views.table(spark, sf_dir, "documents")
    first = d.groupBy(F.sha2(F.encode("text", "UTF-8"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).drop("h")
    return d.join(first, "doc_id")


def _KEY():
    return F.expr("concat(source, '/', lang)")


@view
def plan(spark, sf_dir) -> DataFrame:
    row = lambda df, name, fmt, stratum, doc: df.select(
        F.lit(name).alias("plan_id"), F.lit("1").alias("plan_version"), F.lit(fmt).alias("format"), stratum.alias("stratum"), F.expr(doc).alias("doc_id"))
    d, lab = views.table(spark, sf_dir, "documents"), views.table(spark, sf_dir, "labels")
    pages = views.table(spark, sf_dir, "pages")
    return (row(d.join(lab, "doc_id"), "labelled", "txt", _KEY(), "doc_id * 4")
            .unionByName(row(_unique_documents(spark, sf_dir).filter("NOT contains(text, ' | ')"), "unique", "txt", _KEY(), "doc_id * 4"))
            .unionByName(row(pages, "unique", "html", F.regexp_extract("url", r"example\.([a-z]+)", 1), "page_id * 4 + 1")))


@view
def bad_plan(spark, sf_dir) -> DataFrame:
    d = views.table(spark, sf_dir, "documents").join(views.table(spark, sf_dir, "labels"), "doc_id")
    row = lambda df, stratum: df.select(F.lit("bad").alias("plan_id"), F.lit("1").alias("plan_version"), F.lit("txt").alias("format"), stratum.alias("stratum"), "doc_id")
    return row(d, F.expr("CASE WHEN quality = 0 AND toxic = 1 THEN ' ' ELSE concat(source, '/', lang) END")).unionByName(row(d.filter("toxic = 1"), _KEY()))


@view
def scored(spark, sf_dir) -> DataFrame:
    u = _unique_documents(spark, sf_dir)
    placed = u.select((F.col("doc_id") * 4).alias("doc_id"), F.when(F.col("text").contains(" | "), "tables").otherwise(_KEY()).alias("stratum")).unionByName(
        views.table(spark, sf_dir, "pages").select((F.col("page_id") * 4 + 1).alias("doc_id"), F.regexp_extract("url", r"example\.([a-z]+)", 1).alias("stratum")))
    return stored(score_tables(spark, sf_dir, ARMS)[2].join(placed, "doc_id"))


@view
def projections(spark, sf_dir):
    return {arm: co.project_corpus(plan(spark, sf_dir), scored(spark, sf_dir).filter(F.col("arm") == arm)) for arm in ARMS}


def both(spark, sf_dir, level: int) -> DataFrame:
    p = projections(spark, sf_dir)
    tables = [p[a][level].select(F.lit(a).alias("arm"), "*") for a in ARMS]
    return tables[0].unionByName(tables[1])


def q(name, needs, sql):
    return register(name, query(needs, sql))


@q("plan_validation", "bad_plan", """SELECT plan_id, 'STRATUM_INCOMPLETE' AS violation, doc_id::VARCHAR AS subject, count(*) AS n FROM bad_plan WHERE trim(stratum) = '' GROUP BY ALL
UNION ALL SELECT plan_id, 'DUPLICATE_DOCUMENT', doc_id::VARCHAR, count(*) FROM bad_plan GROUP BY ALL HAVING count(*) > 1""")
def _(spark, sf_dir):
    return co.plan_violations(bad_plan(spark, sf_dir))


@q("duplicate_ids", "bad_plan", "SELECT 'document' AS what, doc_id::VARCHAR AS subject, count(*) AS n FROM bad_plan GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'stratum', format || '/' || stratum, count(*) FROM bad_plan GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf_dir):
    p = bad_plan(spark, sf_dir)
    docs = co.duplicate_documents(p).select(F.lit("document").alias("what"), F.col("doc_id").cast("string").alias("subject"), "n")
    strata = co.duplicate_strata(p).select(F.lit("stratum").alias("what"), F.concat("format", F.lit("/"), "stratum").alias("subject"), "n")
    return docs.unionByName(strata)


@q("plan_coverage_join", "covered", "SELECT arm, plan_id, format, stratum, doc_id, status, score, eligibility FROM covered")
def _(spark, sf_dir):
    return both(spark, sf_dir, 0).select("arm", "plan_id", "format", "stratum", "doc_id", "status", "score", "eligibility")


@q("unexpected_documents", "plan corpus_scores", "SELECT arm, doc_id FROM corpus_scores WHERE doc_id NOT IN (SELECT doc_id FROM plan WHERE plan_id = 'labelled')")
def _(spark, sf_dir):
    return co.unexpected_documents(plan(spark, sf_dir).filter("plan_id = 'labelled'"), scored(spark, sf_dir)).select("arm", "doc_id")


@q("paired_documents", "both_arms", "SELECT plan_id, doc_id, left_score, right_score, true AS in_both FROM both_arms")
def _(spark, sf_dir):
    p = projections(spark, sf_dir)
    return co.paired_documents(p["swap"][0], p["dup"][0])


_SUMMARY = """count(*) AS pairs, round_even(avg(delta), 2) AS mean_delta, round_even(median(delta), 2) AS median_delta, round_even(min(delta), 2) AS min_delta, round_even(max(delta), 2) AS max_delta,
  count(*) FILTER (delta > 0) AS positive, count(*) FILTER (delta = 0) AS equal, count(*) FILTER (delta < 0) AS negative"""


@q("paired_delta_summary", "both_arms", f"SELECT plan_id, {_SUMMARY} FROM (SELECT plan_id, left_score - right_score AS delta FROM both_arms WHERE left_score IS NOT NULL AND right_score IS NOT NULL) GROUP BY plan_id")
def _(spark, sf_dir):
    p = projections(spark, sf_dir)
    pairs = co.paired_documents(p["swap"][0], p["dup"][0]).withColumn("delta", F.col("left_score") - F.col("right_score"))
    return co.paired_delta_summary(pairs.filter("delta is not null"), ["plan_id"])


@q("stratum_scores", "strata", "SELECT * FROM strata")
def _(spark, sf_dir):
    return both(spark, sf_dir, 1)


@q("format_scores", "formats", "SELECT * FROM formats")
def _(spark, sf_dir):
    return both(spark, sf_dir, 2)


@q("corpus_score", "corpus covered", """SELECT arm, plan_id, plan_version, status, score, CASE WHEN status = 'ELIGIBLE' THEN 'ELIGIBLE_CORPUS_COMPARISON' ELSE 'NOT_ELIGIBLE_CORPUS_COMPARISON' END AS eligibility,
  (SELECT min(methodology_version) FROM covered) AS methodology_version, (SELECT min(target_profile) FROM covered) AS target_profile FROM corpus""")
def _(spark, sf_dir):
    return both(spark, sf_dir, 3)


@q("corpus_compare", "corpus both_arms covered", f"""
SELECT CASE WHEN ok THEN 'COMPARABLE' ELSE 'NOT_COMPARABLE' END AS status, plan_id, '1' AS plan_version, (SELECT min(methodology_version) FROM covered) AS methodology_version, ls AS left_score, rs AS right_score,
  CASE WHEN ok THEN round_even(ls - rs, 1) END AS corpus_delta, {", ".join(f"CASE WHEN ok THEN {c} END AS {c}" for c in ("pairs", "mean_delta", "median_delta", "min_delta", "max_delta", "positive", "equal", "negative"))}
FROM (SELECT l.plan_id, l.score AS ls, r.score AS rs, l.status = 'ELIGIBLE' AND r.status = 'ELIGIBLE' AS ok FROM corpus l JOIN corpus r USING (plan_id) WHERE l.arm = 'swap' AND r.arm = 'dup')
LEFT JOIN (SELECT plan_id, {_SUMMARY} FROM (SELECT plan_id, left_score - right_score AS delta FROM both_arms) GROUP BY plan_id) USING (plan_id)""")
def _(spark, sf_dir):
    p = projections(spark, sf_dir)
    return co.compare_corpora(p["swap"][0], p["swap"][3], p["dup"][0], p["dup"][3])
