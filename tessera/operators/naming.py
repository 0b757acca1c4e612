"""Next free names: what every claimant of a target is called when names are given out in plan order.

A family is all claimants of one target. Its first one gets the plain name, each later one the least
number from 2 on whose name is free. A numbered name may be the plain name of another family, its
child: ``a-2.md`` is child 2 of ``a.md``. So the numbers of a family depend on when its children first
claim their plain names, and on whether its own plain name was taken by its parent before.

Both cases of the second question are answered for all families at once, by one merge of a family's
claimants with its children in the order of numbers: a child keeps its name if it comes before the
claimant that reaches its number, and that claimant goes on. Which case holds follows from root to
leaf; the two answers of a family are a function of one bit, and composing them by pointer jumping
takes as many rounds as the logarithm of the depth of names like ``a-2-2-2.md``. Nothing depends on
how many claimants there are.
"""
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .numbering import number_rows

FOLD = "family string, flag int, child string, at bigint, value bigint"


def child_of(base: str, longest: int) -> dict:
    """Parent and number of a lower-case plain name, null where no family can number it so."""
    base = F.col(base)
    folder, name = F.regexp_extract(base, r"^(.*/)?[^/]*$", 1), F.regexp_extract(base, r"([^/]*)$", 1)
    ext = F.regexp_extract(name, r"(\.[^./\\]*)$", 1)
    stem = F.substring(name, F.lit(1), F.length(name) - F.length(ext))
    numbered = r"(?s)^(.*?[^ .]|)-([2-9]|[1-9][0-9]{1,8})$"
    ok = stem.rlike(numbered) & (F.length(name) <= longest)     # a name cut to length belongs to no single family
    return {"parent": F.when(ok, F.concat(folder, F.regexp_extract(stem, numbered, 1), ext)), "number": F.when(ok, F.regexp_extract(stem, numbered, 2).cast("bigint"))}


class Family:
    """The merge of one family, for both cases: flag 0 has its plain name, flag 1 has lost it."""

    def __init__(self, name: str):
        self.name, self.times, self.dropped = name, array("q"), 0
        self.taken, self.next = [0, 0], [1, 1]       # numbers left to children so far; next claimant to be numbered

    def numbers(self, flag: int, end: int) -> list[tuple]:
        """Rows of the claimants before ``end``: numbered in turn, behind what was left to children."""
        rows = [(self.name, flag, None, i - flag, i + 1 + self.taken[flag]) for i in range(self.next[flag], end)]
        self.next[flag] = max(end, self.next[flag])
        return rows

    def child(self, child: str, number: int, time: int) -> list[tuple]:
        rows = []
        for flag in (0, 1):
            i = number - 1 - self.taken[flag]
            at = i - flag
            lost = 0
            if at < self.dropped + len(self.times):
                rows += self.numbers(flag, i)
                lost = int(self.times[at - self.dropped] < time)
                self.taken[flag] += 1 - lost
            rows.append((self.name, flag, child, number, lost))
        done = min(self.next[0], self.next[1] - 1) - self.dropped
        if done > 1 << 16:                           # claimants that both cases have passed
            del self.times[:done]
            self.dropped += done
        return rows

    def end(self) -> list[tuple]:
        size = self.dropped + len(self.times)
        return [(self.name, 0, None, 0, 1), *self.numbers(0, size), *self.numbers(1, size + 1)]


def _merge(batches):
    """Events (family, pos, child, time) sorted by family and pos, claimants before children."""
    family, rows = None, []

    def batch():
        columns = list(zip(*rows)) or [()] * 5
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                                          names=["family", "flag", "child", "at", "value"])

    for events in batches:
        for name, pos, child, time in zip(*(events.column(c).to_pylist() for c in ("family", "pos", "child", "time"))):
            if family is None or family.name != name:
                rows += family.end() if family else []
                family = Family(name)
            if child is None:
                family.times.append(time)
            else:
                rows += family.child(child, pos, time)
            if len(rows) > 20_000:
                yield batch()
    rows += family.end() if family else []
    yield batch()


def lost_names(kids: DataFrame) -> DataFrame:
    """(child, lost): whether a parent took a family's plain name, from both answers of every family."""
    rows = cut_lineage(kids.groupBy("child", "family").agg(F.max(F.when(F.col("flag") == 0, F.col("value"))).alias("a"), F.max(F.when(F.col("flag") == 1, F.col("value"))).alias("b")))
    while True:
        above = rows.select(F.col("child").alias("_child"), F.col("family").alias("_family"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        if rows.join(above, F.col("family") == F.col("_child"), "left_semi").isEmpty():
            return rows.select("child", (F.col("a") == 1).alias("lost"))
        both = rows.join(above, F.col("family") == F.col("_child"), "left")
        through = lambda bit: F.when(F.col(bit) == 1, F.col("b")).otherwise(F.col("a"))
        known = F.col("_child").isNotNull()
        rows = cut_lineage(both.select("child", F.when(known, F.col("_family")).otherwise(F.col("family")).alias("family"),
                                       F.when(known, through("_a")).otherwise(F.col("a")).alias("a"), F.when(known, through("_b")).otherwise(F.col("b")).alias("b")))


def free_indexes(claims: DataFrame, order: list[str], longest: int) -> DataFrame:
    """``claims(_base, _i, ...)`` with ``_i``, the place in its family, made the place of its name: 0 is plain, k is ``-(k + 1)``.

    ``order`` are the columns of the plan order.
    """
    families = claims.groupBy("_base").agg(F.count("*").alias("size"))
    kids = families.select(F.col("_base").alias("child"), *[c.alias(n) for n, c in child_of("_base", longest).items()]).filter("parent IS NOT NULL")
    pairs = cut_lineage(kids.join(families.select(F.col("_base").alias("parent"), "size"), "parent"))
    many = pairs.groupBy("parent").agg(F.count("*").alias("kids"))
    # A number beyond all claimants and children is never reached.
    pairs = cut_lineage(pairs.join(many, "parent").filter(F.col("number") <= F.col("size") + F.col("kids") + 1).select("parent", "child", "number"))
    if pairs.isEmpty():
        return claims
    none = F.lit(None).cast("string")
    mine = claims.join(pairs.select(F.col("parent").alias("_base")).distinct(), "_base", "left_semi")
    events = mine.select(F.col("_base").alias("family"), (F.col("_i") + 1).cast("bigint").alias("pos"), none.alias("child"), *order)
    firsts = claims.filter("_i = 0").join(pairs, F.col("_base") == F.col("child"))
    events = events.unionByName(firsts.select(F.col("parent").alias("family"), F.col("number").alias("pos"), "child", *order))
    timed = number_rows(events, [F.col(c) for c in order], "time").withColumn("_late", F.col("child").isNotNull())
    # One family streams through one task, as small rows in constant memory; only families with children do.
    merged = cut_lineage(timed.repartition("family").sortWithinPartitions("family", "pos", "_late").select("family", "pos", "child", "time").mapInArrow(_merge, FOLD))
    lost = lost_names(merged.filter("child IS NOT NULL")).select(F.col("child").alias("_base"), "lost")
    numbers = merged.filter("child IS NULL").select(F.col("family").alias("_base"), "flag", F.col("at").alias("_i"), (F.col("value") - 1).alias("_index"))
    rows = claims.join(cut_lineage(lost), "_base", "left").withColumn("flag", F.coalesce(F.col("lost"), F.lit(False)).cast("int"))
    rows = rows.join(numbers, ["_base", "flag", "_i"], "left")
    return rows.withColumn("_i", F.coalesce("_index", F.col("_i") + F.col("flag"))).drop("_index", "flag", "lost")
