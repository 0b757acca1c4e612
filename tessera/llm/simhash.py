"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's bit is set if it is set in more than half of the hashes of the document's word
shingles. 64 bits are cut into blocks; fingerprints within ``distance`` bits agree in at least
``blocks - distance`` of them, so every choice of that many blocks is a join key. Equal fingerprints
count once. A bucket is compared in one task and yields a star per linked group, never its pairs; a
bucket that holds more than ``BUCKET`` fingerprints is cut into a grid of chunk pairs, so that any
two still meet.

``one_of_each`` takes near copies as texts whose sets of five-word shingles have a Jaccard index of
0.8 or more. Candidates are texts whose fingerprints link, as above, or that share one of BANDS bands
of least hashes, as most pairs at 0.8 differ in more bits; both are then compared by whole sets.

Null, empty and wordless texts have fingerprint zero and link like any other; null keys are kept.
"""
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, keep, whole_text

WORDS, DISTANCE, BLOCKS, BUCKET, SEED = 4, 4, 6, 1024, 42
SHINGLE, LIKE = 5, (4, 5)            # words of a shingle, likeness (as a fraction) of near copies
ROWS, BANDS, CHUNK = 8, 32, 512      # hashes in a band, bands, texts in a chunk of a grid


def all_shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included; a text with fewer words is one shingle, one without words none."""
    from xxhash import xxh64_intdigest
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    line = memoryview(b" ".join(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(words, len(parts)) - 1:].tolist()
    return np.array([xxh64_intdigest(line[s:e], seed) for s, e in zip(starts.tolist(), last)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of shingle hashes; zero for none."""
    ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def simhash(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint; words are runs without ASCII white space, A-Z lowered."""
    return majority(all_shingle_hashes(text, words, seed))


def fingerprint(text: Column, words: int = WORDS, seed: int = SEED) -> Column:
    """The fingerprint as a signed long."""
    @F.arrow_udf(T.LongType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([simhash(t, words, seed) for t in texts.to_pylist()], np.uint64).view(np.int64))
    return run(text)


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One signed 64-bit mask for every choice of blocks - distance blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def stars(group: np.ndarray, distance: int):
    """(u, v) links from each member of a linked set to its first member; ``group`` holds distinct values."""
    left = np.sort(group)
    us, vs = [], []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= distance
            if near.any():
                found = left[near]
                left = left[~near]
                front.extend(found)
                us.append(found)
                vs.append(np.full(len(found), root))
    return us, vs


def _linked(distance: int):
    def run(batches):
        held, rows = [], 0

        def out(table: pa.Table):
            key = np.stack([table.column(i).to_numpy() for i in range(4)], 1)
            value = table.column(4).to_numpy().view(np.uint64)
            cuts = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1
            begins, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(value)]))
            us, vs = [], []
            two = ends - begins == 2
            a, b = value[begins[two]], value[begins[two] + 1]
            near = np.bitwise_count(a ^ b) <= distance
            us.append(a[near])
            vs.append(b[near])
            for s, e in zip(begins[ends - begins > 2], ends[ends - begins > 2]):
                u, v = stars(np.unique(value[s:e]), distance)
                us += u
                vs += v
            u, v = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 14:
                table = pa.Table.from_batches(held)
                key = np.stack([table.column(i).to_numpy() for i in range(4)], 1)
                change = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0]
                if len(change):                    # all but the last bucket are whole
                    cut = int(change[-1]) + 1
                    yield out(table.slice(0, cut))
                    table = table.slice(cut)
                held, rows = table.to_batches(), table.num_rows
        if rows:
            yield out(pa.Table.from_batches(held))
    return run


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(u, v) of distinct fingerprints ``fp``: joins exactly those that links of ``distance`` bits join."""
    masks = F.array(*(F.lit(m) for m in block_masks(blocks, distance)))
    rows = prints.select("fp", F.posexplode(masks).alias("_table", "_mask"))
    rows = rows.select("fp", "_table", F.col("fp").bitwiseAND(F.col("_mask")).alias("_key"))
    chunks = F.ceil(F.col("count") / BUCKET).alias("_chunks")
    hot = keep(rows.groupBy("_table", "_key").count().filter(F.col("count") > BUCKET).select("_table", "_key", chunks))
    n = F.coalesce("_chunks", F.lit(1))
    rows = rows.join(hot, ["_table", "_key"], "left").withColumn("_own", F.pmod(F.xxhash64("fp"), n))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), n - 1)))
    cell = ["_table", "_key", "_low", "_high"]
    rows = rows.select("_table", "_key", F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), "fp")
    rows = rows.select(*(F.col(c).cast("bigint") for c in rows.columns))
    return rows.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_linked(distance), "u bigint, v bigint")


def groups(prints: DataFrame) -> DataFrame:
    """(fp, group): the group of each distinct fingerprint of ``prints``, named by its smallest one."""
    classes = keep(prints.select("fp").distinct())
    roots = components(links(classes))
    return keep(classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("group")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): the smallest key reachable over links of at most DISTANCE bits."""
    prints = keep(docs.select(F.col(key), fingerprint(whole_text(text)).alias("fp")))
    found = groups(prints)
    least = keep(prints.groupBy("fp").agg(F.min(key).alias("_first")).join(found, "fp").groupBy("group").agg(F.min("_first").alias("component_id")))
    names = keep(found.join(least, "group").select("fp", "component_id"))
    return prints.join(names, "fp").select(key, "fp", "component_id")


# Near copies by shingle sets -----------------------------------------------------------------------

def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a text with fewer words is one shingle."""
    return np.unique(all_shingle_hashes(text, words))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key of each band of ROWS least hashes; sets of likeness s share one with 1 - (1 - s^ROWS)^BANDS."""
    from xxhash import xxh64_intdigest
    if not len(hashes):
        return []
    rng = np.random.default_rng(SEED)
    mix, odd = (rng.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        np.minimum(least, ((hashes[at:at + 512, None] ^ mix) * odd).min(axis=0), out=least)
    keys = [xxh64_intdigest(least[k * ROWS:(k + 1) * ROWS].tobytes(), k) for k in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketch(text: Column) -> Column:
    """A hash of the whole shingle set, zero for none, the fingerprint of the shingles and the set's band keys."""
    @F.arrow_udf("struct<fp:bigint,print:bigint,bands:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        from xxhash import xxh64_intdigest
        fps, prints, bands = [], [], []
        for text in texts.to_pylist():
            hashes = all_shingle_hashes(text, SHINGLE)
            own = np.unique(hashes)
            fps.append(xxh64_intdigest(own.tobytes()) if len(own) else 0)
            prints.append(majority(hashes))
            bands.append(band_keys(own))
        signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
        return pa.StructArray.from_arrays([signed(fps), signed(prints), pa.array(bands, pa.list_(pa.int64()))], names=["fp", "print", "bands"])
    return run(text)


def linked_prints(prints: DataFrame) -> DataFrame:
    """(u, v) of shingle sets whose fingerprints link: those of one fingerprint, and the least set of each linked one."""
    rows = prints.select("fp", "print").distinct()
    least = keep(rows.groupBy("print").agg(F.min("fp").alias("least")))
    same = rows.join(least, "print").filter("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))
    end = lambda name: least.select(F.col("print").alias(name), F.col("least").alias(f"_{name}"))
    apart = links(least.select(F.col("print").alias("fp"))).join(end("u"), "u").join(end("v"), "v")
    return same.unionByName(apart.select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def alike(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links from each member of a linked group to its first member; two sets link at Jaccard 0.8 or more."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    held = np.zeros(codes.max() + 1, bool)
    left, found = np.arange(len(sets)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            k = front.pop()
            own = codes[begin[k]:begin[k] + sizes[k]]
            held[own] = True
            both = np.add.reduceat(held[codes].astype(np.int64), begin)[left]
            held[own] = False
            near = both * (LIKE[0] + LIKE[1]) >= LIKE[0] * (sizes[k] + sizes[left])
            found += [(int(x), int(root)) for x in left[near]]
            front.extend(left[near])
            left = left[~near]
    return found


def _verified(batches):
    """(u, v) of sets that are alike, from texts sorted by cell."""
    cell, members = None, {}

    def out():
        fps = list(members)
        pairs = alike([members[f] for f in fps]) if len(fps) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([fps[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for *key, fp, text in zip(*(c.to_pylist() for c in batch.columns)):
            if key != cell:
                yield out()
                cell, members = key, {}
            if fp not in members:
                members[fp] = shingle_hashes(text)
    yield out()


def similar_groups(docs: DataFrame, prints: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(fp, group): sets linked by Jaccard 0.8 or more; ``prints`` has the sketch of each row of ``docs``.

    Sets that share a band are candidates, and those that the links ``near(u, v)`` join. Texts of a linked set of candidates meet, in a grid of
    chunk pairs where there are many, and are compared by their whole sets.
    """
    place = ["_near_id", "_near_sig"]
    classes = keep(prints.groupBy("fp").agg(F.first("bands").alias("bands"), F.min(F.struct(*place)).alias("first")))
    rows = classes.select("fp", F.explode("bands").alias("_key"))
    shared = keep(rows.groupBy("_key").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).filter("low < high").select("_key", "low"))
    banded = rows.join(shared, "_key").filter("fp <> low").select(F.col("fp").alias("u"), F.col("low").alias("v"))
    roots = components(banded if near is None else near.unionByName(banded))
    members = keep(roots.select(F.col("node").alias("fp"), "root").unionByName(roots.select(F.col("root").alias("fp"), "root").distinct()))
    sizes = keep(members.groupBy("root").agg(F.ceil(F.count("*") / CHUNK).alias("n")))
    places = keep(members.join(sizes, "root").join(classes.select("fp", "first"), "fp").select("root", "n", "fp", *(f"first.{c}" for c in place)))
    texts = docs.select(*place, "_near_text").join(places, place).withColumn("_own", F.pmod(F.xxhash64("fp"), F.col("n")))
    texts = texts.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cell = ["root", "_low", "_high"]
    texts = texts.select("root", F.least("_own", "_other").cast("bigint").alias("_low"), F.greatest("_own", "_other").cast("bigint").alias("_high"), "fp", "_near_text")
    found = texts.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_verified, "u bigint, v bigint")
    linked = components(found).withColumnRenamed("node", "fp")
    return keep(classes.select("fp").join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("group")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near copies the one with the smallest key, then text hash."""
    names = {"_near_id": F.coalesce(F.col(key).cast("bigint"), F.lit((1 << 63) - 1)), "_near_sig": F.xxhash64(whole_text(text))}
    named = docs.withColumns(names)
    prints = keep(named.select("_near_id", "_near_sig", sketch(whole_text(text)).alias("s")).select("_near_id", "_near_sig", "s.*"))
    found = similar_groups(named.withColumn("_near_text", whole_text(text)), prints, linked_prints(prints))
    best = prints.join(found, "fp").groupBy("group").agg(F.min(F.struct("_near_id", "_near_sig")).alias("b"))
    best = keep(best.select("b._near_id", "b._near_sig"))
    return named.join(best, ["_near_id", "_near_sig"], "left_semi").dropDuplicates(["_near_id", "_near_sig"]).select(*docs.columns)
