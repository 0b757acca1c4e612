"""Filter interaction audit: what five filters remove in every order they can be applied in.

A document fails A with under 100 words, B with under 80 distinct words in a hundred, C with over 10
letters A-Z in a hundred code points, D if it holds any of ``#$%&*|``, E if a smaller ``doc_id`` has
the same text. A to D come from one pass over the texts. E is an existential self-join: rows whose
text hash occurs more than once are left-semi joined, on hash, exact text and smaller key, with the
first row of each text. Its keys are united with the other failures, and everything after that works
on counts of bit combinations, 32 at most for each part.

``clean[S]``, the documents of a part that fail no filter of the set S, answers every question: a
step after the filters P removes ``clean[P] - clean[P + f]``.

Defined results: a null text is empty, a null ``lang`` and an empty one are the part ``""``. A row
without ``doc_id`` has no smaller one and never fails E, and has no labels. Rows of equal key and text
are documents of their own; neither is smaller. Of several labels of one key any 1 counts. Columns
other than those named are ignored; an empty table has no parts and no rows.
"""
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, whole_text

LETTERS = "ABCDE"
GAP, CAPITALS, MARKS = r"[\x20\x09-\x0D]+", "[^A-Z]+", r"[#$%&*|]"
WORDS, DISTINCT, UPPER = 100, 80, 10
SETS = 1 << len(LETTERS)
KEY = ["id", "part", "h1", "h2"]


def hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")


def text_failures(text: Column) -> Column:
    """Bits of A to D that hold for a text."""
    words = F.array_remove(F.split(text, GAP), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, CAPITALS, ""))
    fails = [n < WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > UPPER * F.length(text), text.rlike(MARKS)]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))


def later_copies(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Keys of the rows whose text a row of smaller id holds as well.

    Texts move only where their hash occurs twice. The right side of the join has one row for each
    text, so a group of copies meets one row however large it is.
    """
    shared = facts.groupBy("h1", "h2").agg(F.min("id").alias("_low"), F.max("id").alias("_high")).filter("_low < _high")
    among = rows.join(keep(shared.select("h1", "h2")), ["h1", "h2"], "left_semi")
    first = among.groupBy("h1", "h2", "text").agg(F.min("id").alias("id"))
    a, b = among.alias("a"), keep(first).alias("b")
    same = (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")) & (F.col("a.text") == F.col("b.text"))
    return a.join(b, same & (F.col("b.id") < F.col("a.id")), "left_semi").select(*KEY)


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, bits, n, good, toxic): documents of each combination of failures."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), *hashes(text), text.alias("text"))
    facts = keep(rows.select(*KEY, text_failures(F.col("text")).alias("bits")))
    late = later_copies(rows, facts).select(*KEY, F.lit(1 << LETTERS.index("E")).alias("bits"), F.lit(0).alias("n"))
    marked = facts.withColumn("n", F.lit(1)).unionByName(late).groupBy(*KEY).agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_q"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_t"))
    counts = (F.sum("n").alias("n"), F.sum(F.coalesce(F.col("n") * F.col("_q"), F.lit(0))).alias("good"), F.sum(F.coalesce(F.col("n") * F.col("_t"), F.lit(0))).alias("toxic"))
    return marked.join(known, "id", "left").groupBy("part", "bits").agg(*counts)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    def clean(count: str) -> Column:
        return F.array(*(F.sum(F.when(F.col("bits").bitwiseAND(s) == 0, F.col(count)).otherwise(0)) for s in range(SETS)))

    parts = combinations(docs, labels).groupBy("part").agg(*(clean(c).alias(c) for c in ("n", "good", "toxic")))

    def without(s: int) -> Column:
        return F.col("n")[s]

    # Before a filter stand exactly the filters of S in |S|! (4 - |S|)! of the orders.
    shares = [sum((factorial(s.bit_count()) * factorial(len(LETTERS) - 1 - s.bit_count()) * (without(s) - without(s | 1 << f))
                   for s in range(SETS) if not s >> f & 1), F.lit(0)) for f in range(len(LETTERS))]
    orders = F.array(*(F.lit("".join(p)) for p in permutations(LETTERS)))
    steps = (parts.withColumn("_shares", F.array(*shares)).withColumn("filter_order", F.explode(orders))
             .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS))))))
    places = F.transform(F.split("filter_order", ""), lambda x: F.ascii(x) - ord(LETTERS[0]))
    before = F.aggregate(F.slice(places, 1, F.col("step") - 1), F.lit(0), lambda s, k: s.bitwiseOR(F.call_function("shiftleft", F.lit(1), k)))
    steps = steps.withColumn("_f", F.element_at(places, F.col("step"))).withColumn("_p", before)
    steps = steps.withColumn("_bit", F.call_function("shiftleft", F.lit(1), F.col("_f"))).withColumn("_q", F.col("_p").bitwiseOR(F.col("_bit")))

    def lost(count: str) -> Column:
        return F.col(count)[F.col("_p")] - F.col(count)[F.col("_q")]

    n, last = F.col("n"), F.lit(SETS - 1)
    return steps.select("part", "filter_order", "step", n[F.col("_q")].alias("kept"), lost("n").alias("removed"),
                        (n[0] - n[F.col("_bit")] - lost("n")).alias("redundant"), (n[last - F.col("_bit")] - n[last]).alias("unique_fails"),
                        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.col("_shares")[F.col("_f")].alias("shapley"))


# The same report row by row: every document against every order and step.
SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM docs),
judged AS (
  SELECT s.doc_id, s.part, list_filter([
      CASE WHEN len(ws) < 100 THEN 'A' END,
      CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
      CASE WHEN EXISTS (SELECT 1 FROM docs o WHERE o.t = s.t AND o.doc_id < s.doc_id) THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM split s),
marked AS (
  SELECT j.*, coalesce(l.q, false) AS good, coalesce(l.x, false) AS bad
  FROM judged j LEFT JOIN (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS q, bool_or(coalesce(toxic = 1, false)) AS x FROM labels GROUP BY doc_id) l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, CAST(s AS INTEGER) AS step, o[s] AS f, o[1:s - 1] AS earlier FROM orders, range(1, 6) r(s)),
report AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, f,
    count(*) FILTER (NOT list_has_any(fails, earlier) AND NOT list_contains(fails, f)) AS kept,
    count(*) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, f)) AS removed,
    count(*) FILTER (list_has_any(fails, earlier) AND list_contains(fails, f)) AS redundant,
    count(*) FILTER (fails = [f]) AS unique_fails,
    count(*) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, f) AND good) AS good_lost,
    count(*) FILTER (NOT list_has_any(fails, earlier) AND list_contains(fails, f) AND bad) AS toxic_lost
  FROM marked, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM report
"""
