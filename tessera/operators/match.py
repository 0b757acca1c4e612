"""Matching primitives: exactness, one-to-one matches, token overlap, order inversions.

The k-th occurrence on one side meets the k-th on the other, so a match is an equi-join on the
running occurrence number, and the number of matches is the smaller of two counts.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, normal_lines, tokens
from ..functions.url import canonical_uri
from ..plans.dims import CONTENT_KINDS, EXACT
from ..session import by_document

KINDS_WITH_ATTRIBUTES = {"HEADING": "level", "LIST_ITEM": "level", "TABLE_CELL": "position"}


def certainty_of(prop: str) -> Column:
    return F.coalesce(F.element_at("property_certainty", prop), F.col("certainty"))


def fact_is_exact(prop: str) -> Column:
    """The fact's certainty for a property is the override if present, else its own."""
    return F.coalesce(certainty_of(prop).isin(EXACT), F.lit(False))


def has_attributes(attributes: Column, keys: list[str]) -> Column:
    return F.coalesce(F.forall(F.array(*[F.lit(k) for k in keys]),
                               lambda k: ~is_blank(F.element_at(attributes, k))), F.lit(False))


def _comparable(facts: DataFrame) -> DataFrame:
    """Add normalised text, its lines, the place attributes and the canonical target."""
    attr = lambda k: F.element_at("attributes", k)
    kind = F.col("kind")
    place = (F.when(kind.isin("HEADING", "LIST_ITEM"), attr("level"))
             .when(kind == "TABLE_CELL", F.concat(attr("row"), F.lit(","), attr("column"))))
    facts = facts.withColumn("_normal", normal_lines(F.col("text")))
    return facts.select(
        "*", F.col("_normal.norm").cast("string").alias("norm"), F.when(kind.isin(CONTENT_KINDS), F.col("_normal.lines").cast("array<string>")).alias("lines"),
        place.alias("place"), F.when(kind == "LINK", canonical_uri(attr("target"))).alias("uri"))


def comparable_source(facts: DataFrame) -> DataFrame:
    """Source facts with normalised text, canonical target and exactness per property."""
    usable = (F.when(F.col("kind") == "TABLE_CELL", fact_is_exact("position") & has_attributes(F.col("attributes"), ["row", "column"]))
              .when(F.col("kind").isin("HEADING", "LIST_ITEM"), fact_is_exact("level") & has_attributes(F.col("attributes"), ["level"]))
              .otherwise(F.lit(False)))
    return _comparable(facts).select(
        "doc_id", "fact_id", "kind", "ord", "norm", "lines", "place", "uri",
        F.coalesce(F.col("certainty").isin(EXACT), F.lit(False)).alias("x_fact"),
        *[fact_is_exact(p).alias("x_" + p) for p in ("text", "order", "target", "presence")],
        usable.alias("x_place"))


def comparable_output(facts: DataFrame) -> DataFrame:
    return _comparable(facts).select("doc_id", "arm", "fact_id", "kind", "ord", "norm", "lines", "place", "uri")


def _items(df: DataFrame, keys: list[str], text_ok: str, target_ok: str, count: str) -> DataFrame:
    """What the facts contribute to the multisets, counted: lines, texts per kind, link targets."""
    line_ok = f"kind IN {tuple(CONTENT_KINDS)} AND {text_ok} AND norm <> ''"
    items = F.expr(f"""concat(
        CASE WHEN {line_ok} THEN transform(coalesce(lines, array(norm)), t -> struct('line' AS cls, t AS key)) ELSE array() END,
        CASE WHEN kind IN ('HEADING', 'LIST_ITEM', 'TABLE_CELL', 'LINK') AND {text_ok} AND norm <> ''
             THEN array(struct(kind AS cls, norm AS key)) ELSE array() END,
        CASE WHEN kind = 'LINK' AND {target_ok} AND uri <> '' THEN array(struct('uri' AS cls, uri AS key)) ELSE array() END)""")
    rows = df.select(*keys, F.explode(items).alias("i")).select(*keys, "i.*")
    return rows.groupBy(*keys, "cls", "key").agg(F.count("*").alias(count))


def source_items(source: DataFrame) -> DataFrame:
    """Counted items of the source; each distinct line is tokenised once, whatever the arms."""
    size = F.when(F.col("cls") == "line", F.size(tokens(F.col("key")))).otherwise(0)
    return _items(source, ["doc_id"], "x_text", "x_target", "n_source").withColumn("source_size", size)


def output_items(output: DataFrame) -> DataFrame:
    return _items(output, ["doc_id", "arm"], "true", "true", "n_output")


def compared_items(source: DataFrame, output: DataFrame) -> DataFrame:
    """Output items beside the source item of the same key; only unknown lines are tokenised. ``code`` stands for the key where it moves."""
    both = output_items(output).join(source_items(source), ["doc_id", "cls", "key"], "left")
    size = F.coalesce("source_size", F.when(F.col("cls") == "line", F.size(tokens(F.col("key")))).otherwise(0))
    return both.select("doc_id", "arm", "cls", "key", text_key(F.col("key")).alias("code"), "n_output", "n_source", size.alias("size"),
                       F.least("n_output", F.coalesce("n_source", F.lit(0))).alias("matched"))


def multiset_overlap(items: DataFrame) -> DataFrame:
    """Size of the multiset intersection per ``(doc_id, arm, cls)`` of ``compared_items``."""
    return items.filter("matched > 0").groupBy("doc_id", "arm", "cls").agg(F.sum("matched").alias("matched"))


def rest_overlap(items: DataFrame, source: DataFrame) -> DataFrame:
    """Token overlap of the lines that have no partner, per ``(doc_id, arm)``.

    Taking the same lines out of both sides takes the same tokens out of both, so the overlap is
    the tokens of the matched lines plus the overlap of the rest. Tokens are only exploded for
    outputs that hold lines unknown to their source.
    """
    lines = items.filter("cls = 'line'")
    left_over = lines.filter("n_output > matched").select(
        "doc_id", "arm", "key", (F.col("n_output") - F.col("matched")).alias("n"))
    source_lines = source_items(source).filter("cls = 'line'").select("doc_id", "key", text_key(F.col("key")).alias("code"), "n_source")
    touched = left_over.select("doc_id", "arm").distinct()
    partner = lines.select("doc_id", "arm", "code", "n_output")
    missing = (touched.join(source_lines, "doc_id").join(partner, ["doc_id", "arm", "code"], "left")
               .select("doc_id", "arm", "key", (F.col("n_source") - F.coalesce("n_output", F.lit(0))).alias("n")).filter("n > 0"))
    side = lambda df, s, o: df.select("doc_id", "arm", F.explode(tokens(F.col("key"))).alias("token"),
                                      (F.col("n") * s).alias("s"), (F.col("n") * o).alias("o"))
    both = side(missing, 1, 0).unionByName(side(left_over, 0, 1)).groupBy("doc_id", "arm", "token").agg(
        F.sum("s").alias("s"), F.sum("o").alias("o"))
    return both.groupBy("doc_id", "arm").agg(F.sum(F.least("s", "o")).alias("rest"))


def token_overlap(items: DataFrame, source: DataFrame) -> DataFrame:
    """Token multiset overlap per ``(doc_id, arm)``: matched lines and the overlap of the rest."""
    whole = items.filter("cls = 'line' AND matched > 0").groupBy("doc_id", "arm").agg(
        F.sum(F.col("matched") * F.col("size")).alias("whole"))
    return whole.join(rest_overlap(items, source), ["doc_id", "arm"], "full_outer").select(
        "doc_id", "arm", (F.coalesce("whole", F.lit(0)) + F.coalesce("rest", F.lit(0))).cast("bigint").alias("matched"))


def occurrence(df: DataFrame, keys: list[str], name: str, counted: Column) -> DataFrame:
    """Running number of the counted rows among equal keys, in fact order."""
    w = W.partitionBy(*keys).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.when(counted, F.sum(counted.cast("int")).over(w)))


def text_key(text: Column, longest: int = 64) -> Column:
    """A key that is equal where the texts are: a short text itself, else its SHA-256.

    The digest has a character more than any text that stands for itself, so the two never meet.
    """
    return F.when(F.length(text) > longest, F.concat(F.lit("#"), F.sha2(text, 256))).otherwise(text)


def match_text_fifo(source: DataFrame, output: DataFrame, source_ok: Column = None) -> DataFrame:
    """Pairs of facts of one kind with equal normalised text; blank text never matches.

    Both sides are hashed by document once, with the key of a text in place of the text; the
    occurrence numbers and the join reuse that layout.
    """
    def side(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
        rows = by_document(df.filter("norm <> ''").select(*keys, text_key(F.col("norm")).alias("key"), "ord", "fact_id", "place"))
        return occurrence(rows, [*keys, "key"], "rn", F.lit(True)).select(
            *keys, "key", "rn", F.col("fact_id").alias(name + "_fact_id"), F.col("ord").alias(name + "_ord"), F.col("place").alias(name + "_place"))

    s = side(source if source_ok is None else source.filter(source_ok), "source", ["doc_id", "kind"])
    o = side(output, "output", ["doc_id", "arm", "kind"])
    return o.join(s, ["doc_id", "kind", "key", "rn"])


def place_and_order_pairs(source: DataFrame, output: DataFrame, uses: list[str] = ("place", "order")) -> DataFrame:
    """Matched pairs for the named uses in one join.

    Agreement of places and reading order filter the source differently before they match, so
    each fact carries one occurrence number per use and is joined once under each. Only kinds with
    a place have pairs of the first use.
    """
    kinds = CONTENT_KINDS if "order" in uses else [k for k in CONTENT_KINDS if k in KINDS_WITH_ATTRIBUTES]
    content = F.col("kind").isin(list(kinds)) & (F.col("norm") != "")
    keys = ["doc_id", "kind", "norm"]
    s = source.filter(content)
    for use in uses:
        s = occurrence(s, keys, "rn_" + use, F.col("x_" + use))
    numbers = ", ".join(f"struct('{use}' AS cls, rn_{use} AS rn)" for use in uses)
    s = s.select(*keys, "ord", "place", F.explode(F.expr(f"filter(array({numbers}), x -> x.rn IS NOT NULL)")).alias("u")).select(
        *keys, "u.cls", "u.rn", F.col("ord").alias("source_ord"), F.col("place").alias("source_place"))
    o = occurrence(output.filter(content), ["doc_id", "arm", "kind", "norm"], "rn", F.lit(True)).select(
        *keys, "arm", "rn", F.col("ord").alias("output_ord"), F.col("place").alias("output_place"))
    return o.join(s, [*keys, "rn"])


def inversions(anchors: DataFrame) -> DataFrame:
    """Inverted pairs per ``(doc_id, arm)`` of ``anchors(source_ord, output_ord)``.

    The permutation is first cut where all earlier anchors also come earlier in the output; pairs
    across a cut are in order. Inside a piece longer than one, ranks are compared bit by bit: at
    each level, a row with bit 0 is inverted against the earlier rows of its prefix with bit 1.
    That is O(n log n) and never pairs rows with each other.
    """
    doc = ["doc_id", "arm"]
    by_source = W.partitionBy(*doc).orderBy("source_ord")
    ranked = anchors.select(
        *doc, "source_ord", (F.row_number().over(W.partitionBy(*doc).orderBy("output_ord")) - 1).alias("r"))
    ranked = ranked.select("*", (F.row_number().over(by_source) - 1).alias("i"),
                           F.max("r").over(by_source.rowsBetween(W.unboundedPreceding, 0)).alias("top"))
    before = F.lag("top", 1, -1).over(by_source)
    ranked = ranked.withColumn("starts", before == F.col("i") - 1)
    ranked = ranked.withColumn("piece", F.last(F.when(F.col("starts"), F.col("i")), ignorenulls=True).over(
        by_source.rowsBetween(W.unboundedPreceding, 0)))
    moved = ranked.filter(~(F.col("starts") & (F.col("r") == F.col("i"))))
    size = F.max("i").over(W.partitionBy(*doc, "piece")) - F.col("piece") + 1
    moved = moved.select(*doc, "piece", "i", (F.col("r") - F.col("piece")).alias("r"), size.alias("size"))
    levels = F.expr("sequence(0, length(bin(size - 1)) - 1)")
    bits = moved.select(*doc, "piece", "i", "r", F.explode(levels).alias("k"))
    bits = bits.select(*doc, "piece", "i", "k", F.expr("shiftright(r, k + 1)").alias("prefix"),
                       F.expr("shiftright(r, k) & 1").alias("bit"))
    group = W.partitionBy(*doc, "piece", "k", "prefix").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("bit").over(group), F.lit(0))
    return bits.withColumn("n", F.when(F.col("bit") == 0, ahead).otherwise(0)).groupBy(*doc).agg(
        F.sum("n").cast("bigint").alias("inversions"))
