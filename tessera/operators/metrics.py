"""The 24 fidelity metrics and their findings.

Facts of both sides are reduced to one wide row per ``(doc_id, arm)``; the metrics are formulas on
that row. Every result starts from the list of pairs, so an output without facts still scores 0.
"""
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.dims import CONTENT_KINDS, METRICS
from ..session import by_document, stored
from . import match

SOURCE_CERTAINTY = "NOT_EVALUATED_SOURCE_CERTAINTY"
CONTENT = f"kind IN {tuple(CONTENT_KINDS)}"
PREFIXES = {"HEADING": "h", "LIST_ITEM": "l", "TABLE_CELL": "c"}

SOURCE_COUNTS = {
    "s_all": "true", "s_fact": "x_fact", "s_presence": "x_presence",
    "t_all": CONTENT, "t_exact": f"{CONTENT} AND x_text",
    "t_said": f"{CONTENT} AND norm <> ''", "t_said_exact": f"{CONTENT} AND norm <> '' AND x_text",
    "o_exact": f"{CONTENT} AND norm <> '' AND x_order",
    **{f"{p}_all": f"kind = '{k}'" for k, p in PREFIXES.items()},
    **{f"{p}_exact": f"kind = '{k}' AND x_text" for k, p in PREFIXES.items()},
    **{f"{p}_place": f"kind = '{k}' AND x_place" for k, p in PREFIXES.items()},
    "tab_all": "kind = 'TABLE'", "tab_exact": "kind = 'TABLE' AND x_presence",
    "img_all": "kind = 'IMAGE'", "img_exact": "kind = 'IMAGE' AND x_presence",
    "lnk_all": "kind = 'LINK'", "lnk_exact": "kind = 'LINK' AND x_target",
    "uri_exact": "kind = 'LINK' AND x_target AND uri <> ''",
    "anc_all": "kind = 'LINK' AND norm <> ''", "anc_exact": "kind = 'LINK' AND norm <> '' AND x_text",
}
OUTPUT_COUNTS = {
    "out_all": "true", "out_tab": "kind = 'TABLE'", "out_img": "kind = 'IMAGE'",
    "out_uri": "kind = 'LINK' AND uri <> ''",
    **{f"out_{p}": f"kind = '{k}'" for k, p in PREFIXES.items()},
}
OVERLAPS = {"m_uri": "uri", "m_anchor": "LINK",
            **{f"m_{p}": k for k, p in PREFIXES.items()}}


def _count(name: str, condition: str):
    return F.expr(f"count_if({condition})").alias(name)


def source_counts(source: DataFrame) -> DataFrame:
    """One row of counts per source document."""
    return source.groupBy("doc_id").agg(*[_count(n, c) for n, c in SOURCE_COUNTS.items()])


def output_counts(output: DataFrame) -> DataFrame:
    return output.groupBy("doc_id", "arm").agg(*[_count(n, c) for n, c in OUTPUT_COUNTS.items()])


def stored_items(s: DataFrame, o: DataFrame) -> DataFrame:
    """The compared items, computed once: each reader moves the columns it reads."""
    return by_document(stored(match.compared_items(s, o)))


def text_counts(s: DataFrame, o: DataFrame) -> DataFrame:
    """Token totals and multiset overlaps per ``(doc_id, arm)``; the compared items are read three times and computed once."""
    items = stored_items(s, o)
    sums = items.groupBy("doc_id", "arm").agg(
        F.sum(F.col("n_output") * F.col("size")).alias("out_tokens"),
        F.sum(F.col("matched") * F.col("size")).alias("whole"),
        *[F.sum(F.when(F.col("cls") == cls, F.col("matched"))).alias(n) for n, cls in OVERLAPS.items()])
    rows = sums.join(match.rest_overlap(items, s), ["doc_id", "arm"], "left")
    return rows.withColumn("m_token", F.col("whole") + F.coalesce("rest", F.lit(0))).drop("whole", "rest")


def comparison_row(pairs: DataFrame, s: DataFrame, o: DataFrame,
                   overlap: bool = True, places: bool = True, order: bool = True, outputs: bool = True) -> DataFrame:
    """One wide row of counts per pair, from the comparable facts of both sides.

    Branches nobody asks for are left out of the plan. The branches read both sides several
    times, see ``comparable``.
    """
    wide = pairs.join(source_counts(s), "doc_id", "left")
    names = [*SOURCE_COUNTS]
    if outputs:
        wide = wide.join(output_counts(o), ["doc_id", "arm"], "left")
        names += OUTPUT_COUNTS
    if overlap:
        source_tokens = match.source_items(s).groupBy("doc_id").agg(F.sum(F.col("n_source") * F.col("source_size")).alias("src_tokens"))
        wide = wide.join(source_tokens, "doc_id", "left").join(text_counts(s, o), ["doc_id", "arm"], "left")
        names += ["src_tokens", "out_tokens", "m_token", *OVERLAPS]
    if places or order:
        matched = match.place_and_order_pairs(s, o, [c for c, on in (("place", places), ("order", order)) if on])
        if order:        # the counts and the inversions read them
            matched = by_document(stored(matched.select("doc_id", "arm", "kind", "cls", "source_ord", "output_ord", "source_place", "output_place")))
        agree = matched.groupBy("doc_id", "arm").agg(
            *[_count(f"p_{p}", f"cls = 'place' AND kind = '{k}'") for k, p in PREFIXES.items()],
            *[_count(f"e_{p}", f"cls = 'place' AND kind = '{k}' AND source_place <=> output_place") for k, p in PREFIXES.items()],
            _count("anchors", "cls = 'order'"))
        wide = wide.join(agree, ["doc_id", "arm"], "left")
        names += [f"{x}_{p}" for x in "pe" for p in PREFIXES.values()] + ["anchors"]
        if order:
            wide = wide.join(match.inversions(matched.filter("cls = 'order'")), ["doc_id", "arm"], "left")
            names.append("inversions")
    return wide.select(*pairs.columns, *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names])


def comparable(source_facts: DataFrame, output_facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides in comparable form, stored and hashed by document.

    Every branch of the comparison reads them, so they are computed once; the cut also keeps the
    plans of the scores small. A branch moves only the columns it reads. How many partitions there
    are is left to the adaptive plan.
    """
    return stored_source(source_facts), stored_output(output_facts)


def stored_source(facts: DataFrame) -> DataFrame:
    return by_document(stored(match.comparable_source(facts)))


def stored_output(facts: DataFrame) -> DataFrame:
    return by_document(stored(match.comparable_output(facts)))


def _ratio(num: str, den: str, *guards: tuple[str, str]) -> tuple[str, str, str, str]:
    """(status, numerator, denominator, value) of a ratio; the first guard that holds wins."""
    whens = " ".join(f"WHEN {c} THEN '{s}'" for c, s in guards)
    status = f"CASE {whens} WHEN {den} = 0 THEN 'NOT_APPLICABLE' ELSE 'EVALUATED' END"
    blocked = " OR ".join(f"({c})" for c, _ in guards) or "false"
    keep = lambda e: f"CASE WHEN {blocked} THEN 0L ELSE {e} END"
    value = f"CASE WHEN {blocked} OR {den} = 0 THEN NULL ELSE CAST({num} AS DOUBLE) / {den} END"
    return status, keep(num), keep(den), value


def metric_formulas() -> dict[str, tuple[str, str, str, str]]:
    f = {"evaluation_coverage_exact": _ratio("s_fact", "s_all")}
    no_text, some_text = ("t_all > 0 AND t_exact = 0", SOURCE_CERTAINTY), ("t_exact < t_all", SOURCE_CERTAINTY)
    f["text_recall"] = _ratio("m_token", "src_tokens", no_text)
    f["text_precision"] = _ratio("m_token", "out_tokens", no_text, some_text)
    for metric, place, p in (("heading", "heading_level", "h"), ("list_item", "list_level", "l"),
                             ("table_cell", "table_cell_position", "c")):
        none = (f"{p}_all > 0 AND {p}_exact = 0", SOURCE_CERTAINTY)
        f[metric + "_recall"] = _ratio(f"m_{p}", f"{p}_exact", none)
        f[metric + "_precision"] = _ratio(f"m_{p}", f"out_{p}", none, (f"{p}_exact < {p}_all", SOURCE_CERTAINTY))
        f[place + "_accuracy"] = _ratio(
            f"e_{p}", f"p_{p}", (f"{p}_all = 0", "NOT_APPLICABLE"),
            (f"{p}_place = 0", "NOT_EVALUATED_SOURCE_EVIDENCE"), (f"p_{p} = 0", "NOT_EVALUATED_NO_MATCHED_FACTS"))
    for metric, p in (("table_count", "tab"), ("image_reference_count", "img")):
        none, both = (f"{p}_all > 0 AND {p}_exact = 0", SOURCE_CERTAINTY), f"least({p}_exact, out_{p})"
        f[metric + "_recall"] = _ratio(both, f"{p}_exact", none)
        f[metric + "_precision"] = _ratio(both, f"out_{p}", none, (f"{p}_exact < {p}_all", SOURCE_CERTAINTY))
    none = ("lnk_all > 0 AND lnk_exact = 0", SOURCE_CERTAINTY)
    f["link_target_recall"] = _ratio("m_uri", "uri_exact", none)
    f["link_target_precision"] = _ratio("m_uri", "out_uri", none, ("lnk_exact < lnk_all", SOURCE_CERTAINTY))
    f["link_anchor_text_recall"] = _ratio("m_anchor", "anc_exact", ("anc_all > 0 AND anc_exact = 0", SOURCE_CERTAINTY))
    f["output_nonempty"] = _ratio("CAST(out_all > 0 AS BIGINT)", "1L", ("s_all = 0", "NOT_APPLICABLE"),
                                  ("s_presence = 0", SOURCE_CERTAINTY))
    unsure = "t_said_exact < t_said"
    f["duplicate_or_extra_content_count"] = (
        f"CASE WHEN {unsure} THEN '{SOURCE_CERTAINTY}' ELSE 'EVALUATED' END",
        f"CASE WHEN {unsure} THEN 0L ELSE out_tokens - m_token END", f"CASE WHEN {unsure} THEN 0L ELSE out_tokens END",
        f"CASE WHEN {unsure} THEN NULL ELSE CAST(out_tokens - m_token AS DOUBLE) END")
    f["content_token_length_ratio"] = _ratio("out_tokens", "src_tokens", (unsure, SOURCE_CERTAINTY))
    f["order_anchor_coverage"] = _ratio("anchors", "o_exact", ("t_said = 0", "NOT_APPLICABLE"),
                                        ("o_exact = 0", SOURCE_CERTAINTY))
    pairs = "(anchors * (anchors - 1) DIV 2)"
    f["pairwise_order_accuracy"] = _ratio(
        f"({pairs} - inversions)", pairs, ("t_said < 2", "NOT_APPLICABLE"), ("o_exact < 2", SOURCE_CERTAINTY),
        ("anchors < 2", "NOT_EVALUATED_INSUFFICIENT_ANCHORS"))
    return f


FORMULAS = metric_formulas()
METHOD = dict(METRICS)


def metrics_of(wide: DataFrame, names: list[str] = None) -> DataFrame:
    """Metrics as a long table, computed from the wide row in one pass."""
    rows = ", ".join(
        "named_struct('name', '{}', 'status', {}, 'value', {}, 'numerator', {}, 'denominator', {}, 'method', '{}')".format(
            n, FORMULAS[n][0], FORMULAS[n][3], FORMULAS[n][1], FORMULAS[n][2], METHOD[n])
        for n, _ in METRICS if names is None or n in names)
    return wide.select("doc_id", "format", "arm", F.expr(f"inline(array({rows}))"))


def reads_outputs(names: list[str]) -> bool:
    """Whether a formula of the named metrics takes a count of output facts."""
    taken = {word for n in names for part in FORMULAS[n] for word in re.findall(r"\w+", part)}
    return not taken.isdisjoint(OUTPUT_COUNTS)


def metrics(pairs: DataFrame, s: DataFrame, o: DataFrame, names: list[str] = None) -> DataFrame:
    """The named metrics (all by default) of comparable facts."""
    wanted = set(names or METHOD)
    needs = lambda *parts: any(p in m for m in wanted for p in parts)
    wide = comparison_row(
        pairs, s, o, outputs=reads_outputs(wanted),
        overlap=needs("text", "heading_recall", "heading_precision", "list_item", "cell_recall", "cell_precision", "link", "content"),
        places=needs("level_accuracy", "position_accuracy"), order=needs("order"))
    return metrics_of(wide, names)


def row_findings(wide: DataFrame) -> DataFrame:
    """Findings about a whole output: empty, extra content, missing images."""
    return wide.select("doc_id", "format", "arm", F.explode(F.expr("""filter(array(
        CASE WHEN s_presence > 0 AND out_all = 0 THEN struct('EMPTY_OUTPUT' AS code, 'error' AS severity) END,
        CASE WHEN t_said_exact = t_said AND out_tokens > m_token
             THEN struct('EXTRA_OR_DUPLICATED_CONTENT' AS code, 'warning' AS severity) END,
        CASE WHEN img_exact > out_img THEN struct('MISSING_IMAGE_REFERENCE' AS code, 'warning' AS severity) END),
        x -> x IS NOT NULL)""")).alias("f")).select(
        "doc_id", "format", "arm", "f.code", "f.severity", F.lit(None).cast("string").alias("source_fact_id"))


def missing_findings(pairs: DataFrame, s: DataFrame, o: DataFrame) -> DataFrame:
    """Exact source facts and links without partner: the k-th occurrence with fewer than k outputs."""
    text = F.col("kind").isin(*PREFIXES) & F.col("x_text")
    link = (F.col("kind") == "LINK") & F.col("x_target") & (F.col("uri") != "")
    s = s.select("doc_id", "fact_id", "ord", F.when(text, F.col("kind")).when(link, "uri").alias("cls"),
                 F.when(text, F.col("norm")).when(link, F.col("uri")).alias("key")).filter("cls is not null")
    s = match.occurrence(s, ["doc_id", "cls", "key"], "rn", F.lit(True))
    o = o.select("doc_id", "arm", F.expr("CASE WHEN kind = 'LINK' THEN 'uri' ELSE kind END").alias("cls"),
                 F.expr("CASE WHEN kind = 'LINK' THEN uri ELSE norm END").alias("key"))
    o = o.filter(F.col("cls").isin("uri", *PREFIXES) & (F.col("key") != "")).groupBy("doc_id", "arm", "cls", "key").agg(
        F.count("*").alias("n"))
    rows = pairs.join(s, "doc_id").join(o, ["doc_id", "arm", "cls", "key"], "left")
    rows = rows.filter(F.col("rn") > F.coalesce("n", F.lit(0)))
    code = F.when(F.col("cls") == "uri", F.lit("MISSING_LINK_TARGET")).otherwise(F.concat(F.lit("MISSING_"), F.col("cls")))
    return rows.select("doc_id", "format", "arm", code.alias("code"), F.lit("warning").alias("severity"),
                       F.col("fact_id").alias("source_fact_id"))


def findings(pairs: DataFrame, s: DataFrame, o: DataFrame) -> DataFrame:
    wide = comparison_row(pairs, s, o, places=False, order=False)
    return row_findings(wide).unionByName(missing_findings(pairs, s, o))
