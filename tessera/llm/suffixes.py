"""Exact substring deduplication by longest previous factors.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts somewhere else (or, to keep
the first copy, that starts at an earlier place). A string's longest previous factor reaches LENGTH
exactly if the places of its first LENGTH bytes have a smaller one among them, so places are put in
classes by these bytes, and the least place of a class answers for all. Strings are not taken one by one:

1. Every string of LENGTH bytes has one anchor: the first place whose GRAM-byte hash is least in the
   string. Equal strings have equal anchors, and an anchor's strings begin ``lo`` to ``hi`` bytes before it.
2. An anchor's context is all bytes that its own strings cover. Contexts that occur twice are
   matches as a whole. An anchor hash with several contexts needs a closer look at one of each.
3. The strings of such a context are compared by ranges of beginnings. Strings of a range share their
   common bytes; a range whose common bytes no other context has is left, one whose bytes another
   context has altogether is a match as a whole, any other one is halved, down to single strings.

Rows meet only in counts and least places by hash, aggregated before the shuffle, whatever the size of
a group: there is one path for all sizes, and no group is ever gathered in one task.

Null texts count as empty; texts shorter than LENGTH lose nothing. Rows of equal key and text are
one copy when the first is kept. Extra columns are carried along; columns named ``_id``, ``_sig``,
``_text``, ``_spans`` or ``_cut`` are replaced. Hashes have 128 bits.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, whole_text

LENGTH, GRAM = 200, 32
LEFT = LENGTH - GRAM                # bytes before an anchor that strings around it reach
SPAN = LENGTH - GRAM + 1            # places in a string where its anchor may be
BLOCK = 1 << 20                     # bytes of a text worked on at once
NONE = -(1 << 63)                   # stands for a null key

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)      # odd multipliers of the byte hashes


# Anchors ---------------------------------------------------------------------------------------

def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    u = data.astype(np.uint64)
    for s in (1, 2, 4):
        u = u[:-s] | u[s:] << np.uint64(8 * s)
    n = len(data) - GRAM + 1
    h = u[:n] * _A
    for k in range(8, GRAM, 8):
        h ^= h >> np.uint64(31)
        h *= _B
        h += u[k:k + n] * _A
    h ^= h >> np.uint64(29)
    h *= _A
    return h ^ h >> np.uint64(32)


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    n = 1
    while n * 2 <= width:
        a = pick(a[:-n], a[n:])
        n *= 2
    return pick(a[:len(a) - (width - n)], a[width - n:]) if width > n else a


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all strings of LENGTH bytes: places, hashes, and how far before them strings begin, least and most."""
    strings, found = len(data) - LENGTH + 1, []
    for start in range(0, strings, BLOCK):
        count = min(BLOCK, strings - start)
        h = gram_hashes(data[start:start + count - 1 + LENGTH])
        least = sliding(h, SPAN, np.minimum)
        edge = np.zeros(SPAN - 1, np.uint64)
        places = np.nonzero(sliding(np.concatenate((edge, least, edge)), SPAN, np.maximum) == h)[0]
        pick = np.searchsorted(places, np.arange(count))           # a string's anchor: its first place with the least hash
        todo = np.nonzero(h[places[pick]] != least)[0]
        while len(todo):
            pick[todo] += 1
            todo = todo[h[places[pick[todo]]] != least[todo]]
        first = np.nonzero(np.concatenate(([True], pick[1:] != pick[:-1])))[0]
        last = np.append(first[1:], count) - 1
        p = places[pick[first]]
        found.append(np.stack((p + start, h[p].view(np.int64), p - last, p - first)))
    at, h, lo, hi = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    first = np.nonzero(np.concatenate(([True], at[1:] != at[:-1])))[0] if len(at) else np.zeros(0, np.int64)   # blocks share anchors
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return at[first], h[first], lo[last], hi[first]


RUN = ["at", "second", "last", "n", "h", "context", "lo", "hi"]


def anchor_runs(data: bytes) -> list[np.ndarray]:
    """Anchors of a text as the columns RUN.

    Anchors of one context that lie no further apart than LENGTH are one run, as in texts that
    repeat themselves; the contexts of a run cover its bytes without a gap.
    """
    from xxhash import xxh3_64_intdigest
    at, h, lo, hi = anchors(np.frombuffer(data, np.uint8))
    context = np.array([xxh3_64_intdigest(data[p - b:p - a + LENGTH], b) for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist())], np.uint64).view(np.int64)
    order = np.lexsort((at, context, h))
    at, h, context, lo, hi = (x[order] for x in (at, h, context, lo, hi))
    new = np.ones(len(at), bool)
    new[1:] = (h[1:] != h[:-1]) | (context[1:] != context[:-1]) | (np.diff(at) > LENGTH)
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return [at[first], at[np.minimum(first + 1, last)], at[last], last - first + 1, h[first], context[first], lo[first], hi[first]]


def _anchor_rows(batches):
    for batch in batches:
        runs = [anchor_runs(text.encode()) for text in batch.column(2).to_pylist()]
        which = pa.array(np.repeat(np.arange(len(runs)), [len(r[0]) for r in runs]))
        columns = [pa.array(np.concatenate([r[k] for r in runs]) if runs else [], pa.int64()) for k in range(len(RUN))]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(which), batch.column(1).take(which), *columns], names=["_id", "_sig", *RUN])


# Strings in contexts -----------------------------------------------------------------------------

CELLS = [(0, LEFT // 2), (LEFT // 2 + 1, LEFT)]        # ranges of beginnings to start from


def _context_rows(batches):
    """Bytes that strings of an anchor cover, for each range of CELLS with such strings."""
    names = ["_id", "_sig", "h", "at", "lo", "hi", "before", "bytes"]
    for batch in batches:
        out = {n: [] for n in names}
        for i, sig, text, looks in zip(*(batch.column(k).to_pylist() for k in range(4))):
            data = text.encode()
            for x in looks:
                for lo, hi in CELLS:
                    a, b, p = max(lo, x["lo"]), min(hi, x["hi"]), x["at"]
                    if a <= b:
                        for n, v in zip(names, (i, sig, x["h"], p, lo, hi, b, data[p - b:p - a + LENGTH])):
                            out[n].append(v)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([*((n, pa.int64()) for n in names[:-1]), ("bytes", pa.binary())]))


def _partial_spans(rows: DataFrame, first_stays: bool) -> DataFrame:
    """Spans of strings that different contexts of one anchor hash share.

    A row is a context's strings that begin ``lo`` to ``hi`` bytes before the anchor; ``bytes`` covers
    them all and has the anchor at ``before``. Ranges are halved from level to level; a row leaves
    when it shares its common bytes with no other one. Of rows with one cover only the first goes on,
    as it stands for all of them. Levels are as many as halvings of LENGTH.
    """
    def named(prefix: str, *data):
        return {f"{prefix}0": F.xxhash64("h", "lo", *data), f"{prefix}1": F.xxhash64(*data, "hi", "h")}

    lo, hi, before, place = F.col("lo"), F.col("hi"), F.col("before"), F.struct("_id", "_sig", "at")
    last = before + LENGTH - F.length("bytes")                     # how far before the anchor the last string begins
    common = F.substring("bytes", (before - lo + 1).cast("int"), (LENGTH - hi + lo).cast("int"))
    middle = F.floor((lo + hi) / 2)
    halves = F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), hi.alias("hi")))
    found = None
    while found is None or not rows.isEmpty():
        level = rows.withColumns(named("s", common) | named("c", "before", "bytes"))
        covers = keep(level.groupBy("c0", "c1").agg(F.count("*").alias("n"), F.min(place).alias("c_first"), F.min("s0").alias("s0"), F.min("s1").alias("s1")))
        shared = covers.groupBy("s0", "s1").agg(F.sum("n").alias("rows")).filter("rows > 1").select("s0", "s1")
        covers = covers.join(shared, ["s0", "s1"]).select("c0", "c1", "c_first", (F.col("n") > 1).alias("copied"))
        later = F.col("copied") & (place != F.col("c_first"))
        level = level.drop("s0", "s1").join(covers, ["c0", "c1"]).withColumns({"matched": later if first_stays else F.col("copied"), "more": ~later & (lo < hi), "last": last})
        level = keep(level.filter("matched or more").withColumn("bytes", F.when(F.col("more"), F.col("bytes"))).drop("c0", "c1", "c_first", "copied"))
        spans = level.filter("matched").select("_id", "_sig", (F.col("at") - before).alias("start"), (F.col("at") - F.col("last") + LENGTH).alias("end"))
        found = spans if found is None else found.unionByName(spans)
        rows = level.filter("more").withColumn("_cell", F.explode(halves)).withColumns({"lo": F.col("_cell.lo"), "hi": F.col("_cell.hi")}).drop("_cell")
        a, b = F.greatest(lo, F.col("last")), F.least(hi, before)         # of the half's strings, those of this anchor
        rows = rows.withColumns({"_a": a, "_b": b}).filter("_a <= _b")
        rows = rows.withColumns({"bytes": F.substring("bytes", (before - F.col("_b") + 1).cast("int"), (F.col("_b") - F.col("_a") + LENGTH).cast("int")), "before": F.col("_b")}).drop("_a", "_b", "matched", "more", "last")
    return found


# The operator ------------------------------------------------------------------------------------

def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``_id`` and ``_sig``, which name a row by key and text, and the whole ``_text``."""
    return docs.withColumns({"_id": F.coalesce(F.col(key).cast("bigint"), F.lit(NONE)), "_sig": F.xxhash64(whole_text(text)), "_text": whole_text(text)})


def repeated_spans(named: DataFrame, first_stays: bool = False) -> DataFrame:
    """(_id, _sig, start, end): byte spans, possibly overlapping, that repeat; ``named`` comes from ``keyed``."""
    texts = named.select("_id", "_sig", "_text")
    found = keep(texts.mapInArrow(_anchor_rows, ", ".join(f"{c} bigint" for c in ["_id", "_sig", *RUN])))
    repeated = found.groupBy("h").agg(F.sum("n").alias("copies"), (F.min("context") < F.max("context")).alias("mixed")).filter("copies > 1")
    some = keep(found.join(repeated.select("h", "mixed"), "h"))

    place = F.struct("_id", "_sig", "at")
    groups = some.groupBy("h", "context").agg(F.sum("n").alias("copies"), F.min(place).alias("first"), *(F.min(c).alias(c) for c in ("lo", "hi", "mixed")))
    groups = keep(groups.filter("copies > 1 or mixed"))
    matched = some.join(groups.filter("copies > 1").select("h", "context", "first"), ["h", "context"])
    begin = F.col("at")
    if first_stays:                                # of the first run, the anchors after its first
        first = place == F.col("first")
        matched, begin = matched.filter(~first | (F.col("n") > 1)), F.when(first, F.col("second")).otherwise(begin)
    whole = matched.select("_id", "_sig", (begin - F.col("hi")).alias("start"), (F.col("last") - F.col("lo") + LENGTH).alias("end"))

    look = groups.filter("mixed").select("first._id", "first._sig", F.struct("first.at", "h", "lo", "hi").alias("look"))
    per_text = look.groupBy("_id", "_sig").agg(F.collect_list("look").alias("looks"))          # bounded by the text
    one_each = texts.join(per_text, ["_id", "_sig"]).select("_id", "_sig", "_text", "looks")
    contexts = keep(one_each.mapInArrow(_context_rows, "_id bigint, _sig bigint, h bigint, at bigint, lo bigint, hi bigint, before bigint, bytes binary"))
    return whole.unionByName(_partial_spans(contexts, first_stays))


def cut(named: DataFrame, spans: DataFrame, as_text: bool = False) -> DataFrame:
    """Adds ``_cut``, a struct of the remaining bytes, n_removed and n_spans, to rows of ``keyed``.

    As text, the rest of a character whose bytes were removed in part is left out.
    """
    per_text = spans.groupBy("_id", "_sig").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))         # bounded by the text
    kind = T.StructType([T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType())])

    @F.arrow_udf(kind)
    def remaining(texts: pa.Array, spans: pa.Array) -> pa.Array:
        kept, removed, runs = [], [], []
        for text, own in zip(texts.to_pylist(), spans.to_pylist()):
            data = text.encode()
            depth = np.zeros(len(data) + 1, np.int64)
            for s in own or ():
                depth[s["start"]] += 1
                depth[min(s["end"], len(data))] -= 1
            gone = np.cumsum(depth)[:-1] > 0
            rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
            kept.append(rest.decode("utf-8", "ignore") if as_text else rest)
            removed.append(int(gone.sum()))
            runs.append(int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum()))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64())], names=kind.names)

    return named.join(per_text, ["_id", "_sig"], "left").withColumn("_cut", remaining(F.col("_text"), F.col("_spans")))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", first_stays: bool = False, as_text: bool = False) -> DataFrame:
    """Rows of ``docs`` with ``_id``, ``_text`` and ``_cut``: repeated bytes removed everywhere, or all but their first copy."""
    named = keyed(docs, key, text)
    return cut(named, repeated_spans(named, first_stays), as_text)
