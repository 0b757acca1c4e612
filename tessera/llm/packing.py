"""Packing by minimum bin slack.

A document's ids, with the end id, are cut into windows of the full capacity and one remainder, so
pieces fall into at most ``capacity`` length classes. The plan works on the histogram of classes
alone: for each window a bitset subset sum, begun with the longest class left, finds the multiset of
lengths that fills the window best; backtracking gives its counts, and the same pattern is used as
often as the classes allow. The plan's size depends on the capacity, not on the data. Pieces are
numbered inside their class, in hash buckets, and look up their place.

Null and empty texts are the end id alone; repeated rows are packed one by one.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocab
from .common import keep, whole_text

CAPACITY = 2048
END = 1
BUCKETS, BUCKET_ROWS = 64, 4096


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str = None) -> DataFrame:
    """(key, start, length, doc_tokens, ids): windows of each document, ids as little-endian unsigned 32-bit bytes."""
    path = path or vocab.default_path()
    rows = docs.select(F.col(key), whole_text(text).alias("_text"))

    def run(batches):
        for batch in batches:
            at, start, length, total, ids = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                x = np.append(vocab.encode_ids(t, path), END).astype("<u4")
                for s in range(0, len(x), capacity):
                    cut = x[s:s + capacity]
                    at.append(i)
                    start.append(s)
                    length.append(len(cut))
                    total.append(len(x))
                    ids.append(cut.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, total)), pa.array(ids, pa.binary())],
                names=[key, "start", "length", "doc_tokens", "ids"])

    long = [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")]
    return rows.mapInArrow(run, T.StructType([rows.schema[0], *long, T.StructField("ids", T.BinaryType())]))


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths whose sum is closest to ``room`` from below."""
    reach, full = 1, (1 << room + 1) - 1
    history = []                                   # (length, copies, sums reachable before)
    for length in sorted(counts, reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:                                # copies in powers of two reach every count
            k = min(k, left)
            history.append((length, k, reach))
            reach |= reach << length * k & full
            left -= k
            k *= 2
        if reach >> room:
            break
    best, used = reach.bit_length() - 1, {}
    for length, k, before in reversed(history):
        if not before >> best & 1:
            best -= length * k
            used[length] = used.get(length, 0) + k
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, count, sequence, each, offset): pieces first to first + count - 1 of a length
    class fill ``each`` places, from ``offset`` on, of consecutive sequences."""
    counts = {k: n for k, n in histogram.items() if n > 0}
    taken, rows, sequence = dict.fromkeys(counts, 0), [], 0
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        need = best_fill({k: n for k, n in counts.items() if n}, capacity - longest)
        counts[longest] += 1
        need[longest] = need.get(longest, 0) + 1
        times, offset = min(counts[k] // n for k, n in need.items()), 0
        for length in sorted(need, reverse=True):
            n = need[length]
            rows.append((length, taken[length], n * times, sequence, n, offset))
            offset += n * length
            taken[length] += n * times
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
        sequence += times
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to kept pieces; no sequence exceeds the capacity."""
    spark = cut.sparkSession
    buckets = max(BUCKETS, -(-cut.count() // BUCKET_ROWS))
    spread = cut.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key).cast("string"), "start"), F.lit(buckets)))
    sizes = keep(spread.groupBy("length", "_bucket").agg(F.count("*").alias("_n")))
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}   # at most capacity rows
    places = spark.createDataFrame(plan(histogram, capacity), "_length bigint, _first bigint, _count bigint, _sequence bigint, _each bigint, _offset bigint")
    before = F.sum("_n").over(W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("length", "_bucket").orderBy(key, "start")) - 1
    ranked = spread.withColumn("_rank", rank).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    inside = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_count"))
    step = F.col("_rank") - F.col("_first")
    placed = ranked.join(F.broadcast(places), inside)       # bounded by the capacity
    return placed.select(*cut.columns,
                         (F.col("_sequence") + F.floor(step / F.col("_each"))).cast("bigint").alias("sequence_id"),
                         (F.col("_offset") + step % F.col("_each") * F.col("length")).cast("bigint").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, tokens, ids) of packed pieces that carry ``ids``; a sequence holds at most ``capacity`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("tokens"), F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
