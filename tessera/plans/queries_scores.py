"""Queries on matches, metrics, findings, scores and verdicts over the pair corpus."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import match
from ..operators import metrics as mt
from ..operators import scores as sc
from ..session import by_document, stored
from . import dims, views
from .oracle import lit, norm, query, uri
from .queries_facts import WRITTEN_LINKS
from .registry import register
from .views import view

METRIC_COLS = "doc_id, format, arm, name, status, value, numerator, denominator, method"
SUBSETS = {
    "text_metrics": ["text_recall", "text_precision"],
    "kind_metrics": ["heading_recall", "heading_precision", "list_item_recall", "list_item_precision", "table_cell_recall", "table_cell_precision"],
    "count_metrics": ["table_count_recall", "table_count_precision"],
    "link_metrics": ["link_target_recall", "link_target_precision", "link_anchor_text_recall"],
    "image_metrics": ["image_reference_count_recall", "image_reference_count_precision"],
    "attribute_agreement": ["heading_level_accuracy", "list_level_accuracy", "table_cell_position_accuracy"],
    "integrity_metrics": ["output_nonempty", "duplicate_or_extra_content_count", "content_token_length_ratio"],
    "order_metrics": ["order_anchor_coverage", "pairwise_order_accuracy"],
    "coverage_metric": ["evaluation_coverage_exact"],
}


@view
def comparable_source(spark, sf_dir) -> DataFrame:
    return mt.stored_source(views.source_facts(spark, sf_dir))


@view
def comparable_output(spark, sf_dir, arms=None) -> DataFrame:
    return mt.stored_output(views.output_facts(spark, sf_dir, arms))


def inputs(spark, sf_dir, arms=None):
    """The pairs and the comparable facts of both sides, under all arms or the named ones."""
    return views.pairs(spark, sf_dir, arms), comparable_source(spark, sf_dir), comparable_output(spark, sf_dir, arms)


def source_once(spark, sf_dir) -> DataFrame:
    """Comparable source facts for a query that reads them once: nothing is stored."""
    return match.comparable_source(views.source_facts(spark, sf_dir))


def output_once(spark, sf_dir) -> DataFrame:
    """Comparable output facts for a query that reads them once: nothing is stored."""
    return match.comparable_output(views.output_facts(spark, sf_dir))


def output_moved(spark, sf_dir) -> DataFrame:
    """The same, hashed by document before items are counted or matched: these follow without a further exchange."""
    return by_document(output_once(spark, sf_dir))


@view
def wide(spark, sf_dir, arms=None) -> DataFrame:
    """One row per pair; all scores read it, so it is stored too."""
    return stored(mt.comparison_row(*inputs(spark, sf_dir, arms)))


@view
def all_metrics(spark, sf_dir, arms=None) -> DataFrame:
    return mt.metrics_of(wide(spark, sf_dir, arms))


@view
def score_tables(spark, sf_dir, arms=None):
    """Wide rows are hashed by document before they become a row per metric and family, so those don't move."""
    rows = by_document(wide(spark, sf_dir, arms))
    return sc.score_tables(rows, mt.metrics_of(rows))


# Branches of these read the facts of a side once, or not at all.
SOURCE_ONCE = {"count_metrics", "image_metrics", "coverage_metric"}
OUTPUT_ONCE = {"text_metrics", "attribute_agreement", "order_metrics"} | SOURCE_ONCE
# No formula of these takes anything from the outputs: their plan, the largest one, is not even built.
SOURCE_ALONE = {"coverage_metric"}


def _subset(name, names):
    @register(name, query("metrics", f"SELECT {METRIC_COLS} FROM metrics WHERE name IN ({', '.join(map(lit, names))})"))
    def run(spark, sf_dir):
        return of_names(spark, sf_dir, name)


def of_names(spark, sf_dir, subset) -> DataFrame:
    read = output_once if subset in SOURCE_ONCE else output_moved if subset in OUTPUT_ONCE else comparable_output
    o = None if subset in SOURCE_ALONE else read(spark, sf_dir)
    s = (source_once if subset in SOURCE_ONCE else comparable_source)(spark, sf_dir)
    return mt.metrics(views.pairs(spark, sf_dir), s, o, names=SUBSETS[subset])


for _name, _names in SUBSETS.items():
    _subset(_name, _names)


@register("link_metrics_references", query("html_s", f"""
SELECT * FROM (WITH src AS (SELECT doc_id, {norm('text')} AS t, {uri('target')} AS u FROM html_s WHERE kind = 'LINK'),
out AS (SELECT doc_id, {norm('text')} AS t, {uri('target')} AS u FROM ({WRITTEN_LINKS})),
sizes AS (SELECT doc_id, count(*) FILTER (u <> '') AS targets, count(*) AS links, count(*) FILTER (t <> '') AS said FROM src GROUP BY doc_id),
made AS (SELECT doc_id, count(*) FILTER (u <> '') AS targets FROM out GROUP BY doc_id),
uris AS (SELECT doc_id, sum(least(a.n, b.n)) AS m FROM (SELECT doc_id, u, count(*) AS n FROM src WHERE u <> '' GROUP BY ALL) a JOIN (SELECT doc_id, u, count(*) AS n FROM out GROUP BY ALL) b USING (doc_id, u) GROUP BY doc_id),
texts AS (SELECT doc_id, sum(least(a.n, b.n)) AS m FROM (SELECT doc_id, t, count(*) AS n FROM src WHERE t <> '' GROUP BY ALL) a JOIN (SELECT doc_id, t, count(*) AS n FROM out GROUP BY ALL) b USING (doc_id, t) GROUP BY doc_id),
long AS (
  SELECT p.doc_id, unnest(['link_target_recall', 'link_target_precision', 'link_anchor_text_recall']) AS name,
    unnest([coalesce(uris.m, 0), coalesce(uris.m, 0), coalesce(texts.m, 0)]) AS num, unnest([coalesce(sizes.targets, 0), coalesce(made.targets, 0), coalesce(sizes.said, 0)]) AS den
  FROM (SELECT page_id * 4 + 1 AS doc_id FROM pages) p LEFT JOIN sizes USING (doc_id) LEFT JOIN made USING (doc_id) LEFT JOIN uris USING (doc_id) LEFT JOIN texts USING (doc_id))
SELECT doc_id, name, CASE WHEN den = 0 THEN 'NOT_APPLICABLE' ELSE 'EVALUATED' END AS status, CASE WHEN den > 0 THEN CAST(num AS DOUBLE) / den END AS value,
  CAST(num AS BIGINT) AS numerator, CAST(den AS BIGINT) AS denominator FROM long)"""))
def q_link_metrics_references(spark, sf_dir):
    """Link metrics where the output names its links by reference or writes them bare."""
    s, o = mt.comparable(views.html_source_facts(spark, sf_dir), views.reference_facts(spark, sf_dir))
    pairs = views.html_corpus(spark, sf_dir).select("doc_id", F.lit("html").alias("format"), F.lit("refs").alias("arm"))
    return mt.metrics(pairs, s, o, names=SUBSETS["link_metrics"]).select("doc_id", "name", "status", "value", "numerator", "denominator")


@register("all_metrics", query("metrics", f"SELECT {METRIC_COLS} FROM metrics"))
def q_all_metrics(spark, sf_dir):
    return all_metrics(spark, sf_dir)


@register("ratio_metric", query("wide", """
SELECT doc_id, arm, m_token AS numerator, src_tokens AS denominator, CASE WHEN src_tokens = 0 THEN 'NOT_APPLICABLE' ELSE 'EVALUATED' END AS status,
  CASE WHEN src_tokens > 0 THEN m_token::DOUBLE / src_tokens END AS value FROM wide"""))
def q_ratio_metric(spark, sf_dir):
    pairs, s, o = views.pairs(spark, sf_dir), comparable_source(spark, sf_dir), output_moved(spark, sf_dir)
    w = mt.comparison_row(pairs, s, o, places=False, order=False, outputs=False)
    status, num, den, value = mt._ratio("m_token", "src_tokens")
    return w.select("doc_id", "arm", F.expr(num).alias("numerator"), F.expr(den).alias("denominator"),
                    F.expr(status).alias("status"), F.expr(value).alias("value"))


@register("token_multiset_overlap", query("overlap co", "SELECT doc_id, arm, coalesce(matched, 0) AS matched FROM (SELECT doc_id, arm FROM co WHERE norm <> '' AND kind IN ('TEXT_BLOCK', 'HEADING', 'LIST_ITEM', 'TABLE_CELL') GROUP BY ALL) LEFT JOIN (SELECT * FROM overlap WHERE cls = 'token') USING (doc_id, arm)"))
def q_token_multiset_overlap(spark, sf_dir):
    s, o = comparable_source(spark, sf_dir), output_moved(spark, sf_dir)
    return match.token_overlap(mt.stored_items(s, o), s)


@register("match_text_fifo", query("cs fifo_o", """
SELECT o.doc_id, o.arm, o.kind, s.fact_id AS source_fact_id, o.fact_id AS output_fact_id
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, norm ORDER BY ord) AS rn FROM cs WHERE norm <> '' AND x_text) s
JOIN fifo_o o ON s.doc_id = o.doc_id AND s.kind = o.kind AND s.norm = o.norm AND s.rn = o.rn"""))
def q_match_text_fifo(spark, sf_dir):
    s, o = source_once(spark, sf_dir), output_once(spark, sf_dir)
    pairs = match.match_text_fifo(s, o, F.col("x_text"))
    return pairs.select("doc_id", "arm", "kind", "source_fact_id", "output_fact_id")


@register("match_kind_text_fifo", query("anchors", "SELECT doc_id, arm, kind, so AS source_ord, oo AS output_ord FROM anchors"))
def q_match_kind_text_fifo(spark, sf_dir):
    return anchors(source_once(spark, sf_dir), output_once(spark, sf_dir))


def anchors(s, o) -> DataFrame:
    content = F.col("kind").isin(dims.CONTENT_KINDS)
    pairs = match.match_text_fifo(s, o.filter(content), content & F.col("x_order"))
    return pairs.select("doc_id", "arm", "kind", "source_ord", "output_ord")


@register("inversion_count", query("anchors inv", """
SELECT a.doc_id, a.arm, total - coalesce(inversions, 0) AS concordant, total
FROM (SELECT doc_id, arm, count(*) * (count(*) - 1) // 2 AS total FROM anchors GROUP BY ALL) a LEFT JOIN inv i ON a.doc_id = i.doc_id AND a.arm = i.arm"""))
def q_inversion_count(spark, sf_dir):
    rows = stored(q_match_kind_text_fifo(spark, sf_dir))
    total = rows.groupBy("doc_id", "arm").agg(F.expr("count(*) * (count(*) - 1) DIV 2").alias("total"))
    rows = total.join(match.inversions(rows), ["doc_id", "arm"], "left")
    return rows.select("doc_id", "arm", F.expr("total - coalesce(inversions, 0)").alias("concordant"), "total")


def missing(spark, sf_dir) -> DataFrame:
    """Missing facts and links. The join takes only documents whose source states some: outputs of others are not parsed for it."""
    o = match.comparable_output(views.structured_facts(spark, sf_dir))
    return mt.missing_findings(views.pairs(spark, sf_dir), source_once(spark, sf_dir), o)


@register("missing_facts", query("findings", "SELECT doc_id, arm, code, source_fact_id FROM findings WHERE code IN ('MISSING_HEADING', 'MISSING_LIST_ITEM', 'MISSING_TABLE_CELL')"))
def q_missing_facts(spark, sf_dir):
    rows = missing(spark, sf_dir).filter("code <> 'MISSING_LINK_TARGET'")
    return rows.select("doc_id", "arm", "code", "source_fact_id")


@register("missing_link_targets", query("findings", "SELECT doc_id, arm, code, source_fact_id FROM findings WHERE code = 'MISSING_LINK_TARGET'"))
def q_missing_link_targets(spark, sf_dir):
    rows = missing(spark, sf_dir).filter("code = 'MISSING_LINK_TARGET'")
    return rows.select("doc_id", "arm", "code", "source_fact_id")


@register("quality_findings", query("findings", "SELECT doc_id, format, arm, code, severity, source_fact_id FROM findings"))
def q_findings(spark, sf_dir):
    return mt.findings(*inputs(spark, sf_dir))


_EXPERIMENTAL = """
SELECT doc_id, format, arm, dimension, CASE WHEN ev = 0 THEN 'NOT_EVALUATED' WHEN dimension = 'overall' THEN 'EXPERIMENTAL' ELSE 'EVALUATED' END AS status,
  CASE WHEN ev > 0 THEN round_even(total / ev * 100, 1) END AS score, ev AS evaluated_metrics, el AS eligible_metrics,
  CASE WHEN el = 0 THEN 0 ELSE round_even(ev::DOUBLE / el * 100, 1) END AS coverage
FROM (SELECT f.*, coalesce(count(value) FILTER (status = 'EVALUATED' AND value BETWEEN 0 AND 1), 0) AS ev, count(name) AS el,
        sum(value) FILTER (status = 'EVALUATED' AND value BETWEEN 0 AND 1) AS total
  FROM (SELECT *, unnest(['content', 'structure', 'order', 'integrity', 'noise', 'overall']) AS dimension FROM pairs) f
  LEFT JOIN (SELECT m.*, d.dimension FROM metrics m JOIN dim_metric_dimensions d USING (name) WHERE status <> 'NOT_APPLICABLE'
             UNION ALL SELECT m.*, 'overall' FROM metrics m JOIN dim_metric_dimensions d USING (name) WHERE status <> 'NOT_APPLICABLE') x
  USING (doc_id, format, arm, dimension) GROUP BY doc_id, format, arm, dimension)"""


@register("experimental_score", query("pairs metrics dim_metric_dimensions", _EXPERIMENTAL))
def q_experimental_score(spark, sf_dir):
    return sc.experimental_score(all_metrics(spark, sf_dir))


@register("opportunities", query("opportunities", """
SELECT DISTINCT doc_id, format, dimension, family, CASE WHEN source_opportunities = 0 THEN 'NOT_APPLICABLE' WHEN evaluable_opportunities = 0 THEN 'NOT_EVALUATED' ELSE 'APPLICABLE' END AS status,
  source_opportunities, evaluable_opportunities FROM opportunities"""))
def q_opportunities(spark, sf_dir):
    return sc.opportunities(views.documents_of_pairs(spark, sf_dir), source_once(spark, sf_dir)).drop("primary_metric")


@register("family_scores", query("families", """
SELECT doc_id, format, arm, dimension, family, status, round(score, 6) AS score, round(coverage, 6) AS coverage, primary_metric, source_opportunities, evaluable_opportunities FROM families"""))
def q_family_scores(spark, sf_dir):
    return score_tables(spark, sf_dir)[0].withColumn("score", F.round("score", 6)).withColumn("coverage", F.round("coverage", 6))


@register("dimension_scores", query("dimensions", """
SELECT doc_id, format, arm, dimension, status, score, round(coverage, 6) AS coverage, applicable_families, evaluated_families FROM dimensions"""))
def q_dimension_scores(spark, sf_dir):
    return score_tables(spark, sf_dir)[1].withColumn("coverage", F.round("coverage", 6))


@register("document_score", query("doc_scores", """
SELECT doc_id, format, arm, base_quality, integrity, score, status, eligibility, methodology_version, target_profile FROM doc_scores"""))
def q_document_score(spark, sf_dir):
    return score_tables(spark, sf_dir)[2]


_ASSESSED = """
SELECT p.doc_id, p.format, p.arm, CASE WHEN qualification_status IN ('QUALIFIED_BOUNDED', 'COVERAGE_ONLY') THEN qualification_status ELSE 'NOT_QUALIFIED' END AS qualification_status,
  coalesce(n_metrics, 0) AS n_metrics, coalesce(n_findings, 0) AS n_findings,
  CASE WHEN qualification_status = 'QUALIFIED_BOUNDED' THEN d.status END AS projection_status,
  CASE WHEN qualification_status = 'QUALIFIED_BOUNDED' THEN d.score END AS fidelity_score,
  CASE WHEN qualification_status = 'QUALIFIED_BOUNDED' THEN coalesce(cov, 0) END AS evaluation_coverage
FROM pairs p LEFT JOIN dim_profile_status USING (format) LEFT JOIN doc_scores d USING (doc_id, format, arm)
LEFT JOIN (SELECT doc_id, arm, round_even(avg(coverage), 1) AS cov FROM dimensions WHERE status <> 'NOT_APPLICABLE' GROUP BY ALL) c USING (doc_id, arm)
LEFT JOIN (SELECT doc_id, arm, count(*) AS n_metrics FROM metrics m JOIN dim_profile_rules r ON r.format = m.format AND r.rule_name = m.name AND r.rule_type = 'metric' GROUP BY ALL) m USING (doc_id, arm)
LEFT JOIN (SELECT doc_id, arm, count(*) AS n_findings FROM findings f JOIN dim_profile_rules r ON r.format = f.format AND r.rule_name = f.code AND r.rule_type = 'finding' GROUP BY ALL) f USING (doc_id, arm)"""
_ASSESSED_NEEDS = "pairs dim_profile_status doc_scores dimensions metrics findings dim_profile_rules"


@view
def assessed(spark, sf_dir) -> DataFrame:
    _, dimensions, docs = score_tables(spark, sf_dir)
    pairs, s, o = inputs(spark, sf_dir)
    found = mt.row_findings(wide(spark, sf_dir)).unionByName(mt.missing_findings(pairs, s, o))
    return sc.assessments(pairs, all_metrics(spark, sf_dir), found, dimensions, docs)


@register("qualified_view", query(_ASSESSED_NEEDS, _ASSESSED))
def q_qualified_view(spark, sf_dir):
    return assessed(spark, sf_dir)


@register("presentation_verdict", query(_ASSESSED_NEEDS, f"""
SELECT doc_id, format, arm, qualification_status, fidelity_score, evaluation_coverage,
  CASE WHEN qualification_status = 'COVERAGE_ONLY' THEN 'PARTIAL' WHEN coalesce(projection_status, 'NOT_EVALUATED') = 'NOT_EVALUATED' OR fidelity_score IS NULL THEN 'NOT_EVALUATED'
       WHEN projection_status <> 'SCORED' OR evaluation_coverage < 90 THEN 'REVIEW' WHEN fidelity_score >= 90 THEN 'OK' WHEN fidelity_score >= 70 THEN 'REVIEW' ELSE 'FAIL' END AS verdict
FROM ({_ASSESSED})"""))
def q_presentation_verdict(spark, sf_dir):
    rows = sc.presentation_verdicts(assessed(spark, sf_dir))
    return rows.select("doc_id", "format", "arm", "qualification_status", "fidelity_score", "evaluation_coverage", "verdict")


_FLAGSHIP = """
SELECT format, arm, count(*) AS documents, count(*) FILTER (recall < 1) AS lost_text, count(*) FILTER (precise < 1) AS gained_text,
  count(*) FILTER (recall IS NULL AND precise IS NULL) AS not_evaluated
FROM (SELECT doc_id, format, arm, max(value) FILTER (name = 'text_recall') AS recall, max(value) FILTER (name = 'text_precision') AS precise
      FROM metrics WHERE name IN ('text_recall', 'text_precision') GROUP BY ALL) GROUP BY ALL"""


@register("text_loss_by_arm", query("metrics", _FLAGSHIP))
def q_text_loss_by_arm(spark, sf_dir):
    """Flagship: how many converted documents lost or gained text, per format and arm."""
    m = q_metrics_of_text(spark, sf_dir)
    per_pair = m.groupBy("doc_id", "format", "arm").agg(
        F.expr("max(value) FILTER (WHERE name = 'text_recall')").alias("recall"),
        F.expr("max(value) FILTER (WHERE name = 'text_precision')").alias("precise"))
    return per_pair.groupBy("format", "arm").agg(
        F.count("*").alias("documents"), F.expr("count_if(recall < 1)").alias("lost_text"),
        F.expr("count_if(precise < 1)").alias("gained_text"),
        F.expr("count_if(recall IS NULL AND precise IS NULL)").alias("not_evaluated"))


def q_metrics_of_text(spark, sf_dir):
    return of_names(spark, sf_dir, "text_metrics")
