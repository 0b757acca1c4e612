"""Document fingerprints from SpotSigs.

Anchors are the corpus' most common words, by the share of documents that hold them. A signature is
an anchor followed by its chain: the next CHAIN content words after it. A fingerprint is the sorted
set of a document's signature hashes, eight hexadecimal digits each. A text without chains has
chains of all its words if it has LONG or more, and is hashed as a whole otherwise. Likeness is the Jaccard index of two sets; it is not worked out where
their sizes alone keep it below a threshold. ``similar`` partitions fingerprints by set length.

Null and empty texts have the empty fingerprint; two empty ones are alike. Repeated rows are
fingerprinted one by one; neighbours follow each other by descending key, then by text hash; null
keys come last.
"""
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, whole_text

SHARE, CHAIN = 0.05, 2                   # share of documents that hold an anchor, content words in a chain
LONG = 20                                # words from which a text without chains has chains of all its words
WIDTH = 512                              # keys in a bucket of neighbours
COUNTS = 1 << 19                         # distinct words a task holds before it passes its counts on


def _word_hash(word: str) -> int:
    from xxhash import xxh64_intdigest
    h = xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def _document_counts(batches):
    """(h, n): documents that hold a word, by its hash, which is shorter than the word in a shuffle."""
    from collections import Counter
    seen: Counter = Counter()

    def out():
        rows = pa.RecordBatch.from_arrays([pa.array([_word_hash(w) for w in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["h", "n"])
        seen.clear()
        return rows

    for batch in batches:
        for text in batch.column(0).to_pylist():
            seen.update(set(text.lower().split()))
        if len(seen) > COUNTS:
            yield out()
    yield out()


def _words_of(hashes: frozenset):
    """The words behind hashes; a task stops looking when it has met them all."""
    def run(batches):
        left, found = set(hashes), []
        for batch in batches:
            for text in batch.column(0).to_pylist() if left else ():
                for w in set(text.lower().split()):
                    h = _word_hash(w)
                    if h in left:
                        left.discard(h)
                        found.append(w)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])
    return run


def common_words(docs: DataFrame, text: str = "text", share: float = SHARE) -> frozenset:
    """All words of at least ``share`` of the documents that have text."""
    texts = docs.select(whole_text(text).alias("t")).filter("t <> ''")
    least = share * texts.count()
    counts = texts.mapInArrow(_document_counts, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    top = frozenset(r.h for r in counts.filter(F.col("n") >= least).collect())
    return frozenset(r.word for r in texts.mapInArrow(_words_of(top), "word string").distinct().collect()) if top else top


def signatures(text: str, anchors: frozenset, chain: int = CHAIN) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the chains."""
    from xxhash import xxh32_intdigest
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    common = [w in anchors for w in words]
    content = [w for w, c in zip(words, common) if not c]
    spots, seen = set(), 0
    for w, c in zip(words, common):
        if not c:
            seen += 1
        elif seen + chain <= len(content):
            spots.add(f"{w}\0" + " ".join(content[seen:seen + chain]))
    if not spots and len(words) >= LONG:
        spots = {" ".join(words[k:k + chain + 1]) for k in range(len(words) - chain)}
    spots = spots or {" ".join(words)}
    return np.unique(np.fromiter((xxh32_intdigest(s, 0) for s in spots), np.uint32, len(spots)))


def as_text(signs: np.ndarray) -> str:
    return signs.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Likeness of two sorted sets; 0 where their lengths rule ``least`` out."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, anchors: frozenset, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of every whole text."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([as_text(signatures(t, anchors)) for t in texts.to_pylist()], pa.string())
    return docs.select(key, run(whole_text(text)).alias("fingerprint"))


def similar(prints: DataFrame, threshold: float = 0.8, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, likeness) of distinct fingerprints' smallest keys, and membership (key, a).

    Sets fall into partitions by length, each a factor of 1 / threshold wide, so a partner is in the
    same partition or the next. Inside, sets that are alike share one of their rarest signatures: all
    but ceil(threshold * length) - 1 of them are looked up. Lengths prune, then the sets are compared.
    """
    classes = keep(prints.groupBy("fingerprint").agg(F.min(key).alias("a")))
    members = prints.join(classes, "fingerprint").select(key, "a")
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length("fingerprint") / 8).cast("int") - 1), lambda i: F.substring("fingerprint", i * 8 + 1, F.lit(8)))
    sets = classes.filter("fingerprint <> ''").select("a", cut.alias("signs")).withColumn("n", F.size("signs"))
    rows = sets.select("a", "n", F.explode("signs").alias("s"))
    rare = rows.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1")
    order = F.array_sort(F.collect_list(F.struct("df", "s")))                       # one document's signatures
    # Signatures of one set only can't be shared; they come first in the order and need no row.
    led = rows.join(rare, "s").groupBy("a", "n").agg(order.alias("o"))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("o"))
    part = F.floor(F.log(F.col("n")) / -math.log(threshold) + 1e-9).cast("int")
    led = led.filter(prefix > 0).select("a", "n", part.alias("part"), F.explode(F.slice("o", 1, prefix.cast("int"))).alias("o")).select("a", "n", "part", "o.s")
    left = led.select(F.col("a").alias("x"), F.col("n").alias("xn"), "part", "s")
    right = led.select(F.col("a").alias("y"), F.col("n").alias("yn"), F.explode(F.array("part", F.col("part") - 1)).alias("part"), "s")
    met = left.join(right, ["s", "part"]).filter((F.col("xn") < F.col("yn")) | ((F.col("xn") == F.col("yn")) & (F.col("x") < F.col("y"))))
    met = met.filter(F.col("xn") >= F.col("yn") * threshold - 1e-9).select("x", "y").distinct()
    full = sets.select("a", "signs")
    both = F.size(F.array_intersect("xs", "ys"))
    likeness = both / (F.size("xs") + F.size("ys") - both)
    pairs = met.join(full.select(F.col("a").alias("x"), F.col("signs").alias("xs")), "x").join(full.select(F.col("a").alias("y"), F.col("signs").alias("ys")), "y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), likeness.alias("likeness")).filter(F.col("likeness") >= threshold - 1e-9)
    return pairs, members


def edited(text: str, other: str) -> str:
    """``text`` with its second half replaced by as many first characters of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def with_neighbours(docs: DataFrame, anchors: frozenset, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) by descending key.

    Keys are cut into buckets of neighbouring values; each bucket is one sorted run and also gets
    the first row of the bucket below it, so every row meets the one after it without a global
    order of texts. Only bucket ends, one in WIDTH rows, are ordered as a whole.
    """
    rows = docs.select(F.col(key).cast("bigint").alias("id"), whole_text(text).alias("t")).withColumn("sig", F.xxhash64("t"))
    span = rows.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n")).first()
    low, width = span.low or 0, max(WIDTH, -(-((span.high or 0) - (span.low or 0) + 1) // max(1, span.n)) * WIDTH)
    rows = rows.withColumn("bucket", F.coalesce(F.floor((F.col("id") - F.lit(low)) / width), F.lit(-1)).cast("bigint"))
    order = F.struct(F.coalesce("id", F.lit(-(1 << 63))).alias("id"), "sig")
    heads = keep(rows.groupBy("bucket").agg(F.max(order).alias("top")))
    # A bucket's first row goes to the bucket before it in descending order; the first one's to the last.
    above = F.lead("bucket").over(W.orderBy("bucket"))
    lowest = F.min("bucket").over(W.orderBy("bucket"))
    ends = keep(heads.select(F.coalesce(above, lowest).alias("to"), "bucket", "top.id", "top.sig"))
    ghosts = rows.withColumn("_id", F.coalesce("id", F.lit(-(1 << 63)))).join(
        ends.select("to", F.col("bucket").alias("_b"), F.col("id").alias("_i"), F.col("sig").alias("_s")),
        (F.col("bucket") == F.col("_b")) & (F.col("_id") == F.col("_i")) & (F.col("sig") == F.col("_s"))).dropDuplicates(["to"])
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts.select("id", "t", "sig", F.col("to").alias("bucket"), F.lit(True).alias("ghost")))
    placed = both.repartition("bucket").sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("id"), F.desc("sig"))

    def run(batches):
        last = None                                # row that waits for the one after it

        def signs(t):
            return signatures(t, anchors)

        for batch in batches:
            out = [[] for _ in range(7)]
            for i, t, bucket, ghost in zip(*(batch.column(k).to_pylist() for k in ("id", "t", "bucket", "ghost"))):
                own = signs(t)
                if last is not None and last[2] == bucket:
                    new = edited(last[1], t)
                    changed = signs(new)
                    for o, v in zip(out, (last[0], len(last[1]), hashlib.sha256(new.encode()).hexdigest(), as_text(last[3]), as_text(changed),
                                          jaccard(last[3], changed), jaccard(last[3], own))):
                        o.append(v)
                last = None if ghost else (i, t, bucket, own)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)],
                                             names=[key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    schema = f"{key} bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return placed.select("id", "t", "bucket", "ghost").mapInArrow(run, schema)
