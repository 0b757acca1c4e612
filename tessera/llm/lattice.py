"""Embedding near-duplicates by lattice hashing.

Unit vectors are projected to eight dimensions, several times, and decoded to the nearest point of
the E8 lattice: that is a vector's home cell. It also probes the neighbouring cells whose centres
lie nearest. Vectors of one label meet where one's probed or home cell is the other's home, and are
linked if their cosine in double precision reaches the threshold.

Equal vectors form one class with a count. A cell's vectors are compared in one task, which returns
sums of links and one star per linked set, never pairs; a pair that meets in several cells is
counted in the first. Cells beyond ``CELL`` vectors are cut into a grid, so any two still meet.

A vector that is null, empty, zero or holds null or non-finite components, and one without label or
key, links with nothing and is its own component. Rows that repeat a key are separate vectors of
one component node. Vectors of different length are not linked.
"""
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, keep

COSINE, TABLES, PROBES, SCALE, CELL, SEED = 0.93, 4, 6, 0.8, 1024, 11
TILE = 256               # rows of a cell compared at once


def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, as rows."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def nearest_even(y: np.ndarray) -> np.ndarray:
    """Nearest integer point of even sum: rounding, with the worst coordinate rounded the other way if odd."""
    f = np.rint(y)
    odd = np.nonzero(f.sum(1) % 2)[0]
    error = y[odd] - f[odd]
    worst = np.abs(error).argmax(1)
    f[odd, worst] += np.where(error[np.arange(len(odd)), worst] >= 0, 1, -1)
    return f


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point: the better of the even points and of those shifted by one half."""
    a, b = nearest_even(y), nearest_even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1))[:, None], a, b)


def cell_codes(points: np.ndarray) -> np.ndarray:
    """A 32-bit hash of lattice points; points that share one only meet once more."""
    h = np.zeros(len(points), np.uint64)
    for c in np.rint(2 * points).astype(np.int64).T:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def cells(unit: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = SEED) -> np.ndarray:
    """(rows, tables, 1 + probes): the home cell's code, then those of the nearest neighbours."""
    rng, around = np.random.default_rng(seed + unit.shape[1]), neighbours()
    out = np.empty((len(unit), tables, 1 + probes), np.int32)
    for t in range(tables):
        y = unit @ rng.normal(0, scale, (unit.shape[1], 8)) + rng.uniform(0, 1, 8)
        home = decode(y)
        gap = (around**2).sum(1) - 2 * (y - home) @ around.T
        near = np.argsort(gap, axis=1, kind="stable")[:, :probes]
        out[:, t, 0] = cell_codes(home)
        for k in range(probes):
            out[:, t, 1 + k] = cell_codes(home + around[near[:, k]])
    return out


def _hashed(tables: int, probes: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column(3)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begin, codes = np.cumsum(sizes) - sizes, np.zeros((len(sizes), tables, 1 + probes), np.int32)
            for d in np.unique(sizes):
                own = np.nonzero(sizes == d)[0]
                x = flat[begin[own][:, None] + np.arange(d)]
                codes[own] = cells(x / np.linalg.norm(x, axis=1, keepdims=True), tables, probes)
            width = tables * (1 + probes)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * width), pa.array(codes.reshape(-1)))
            raw = [flat[b:b + d].tobytes() for b, d in zip(begin, sizes)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 1, 2, 4)), pa.array(raw, pa.binary()), listed], names=["label", "sig", "id", "n", "raw", "codes"])
    return run


def compare(table: int, query: dict, index: dict, threshold: float):
    """Links and stars of one cell: ``query`` rows probe it, ``index`` rows live in it.

    A row holds id, sig, n, unit vector and codes. Returns counted links of (query, index) rows and,
    for both, the smallest id reachable inside the cell.
    """
    q, i = query, index
    q_links, i_links = np.zeros(len(q["id"]), np.int64), np.zeros(len(i["id"]), np.int64)
    q_low, i_low = q["id"].copy(), i["id"].copy()
    near = np.zeros((len(q["id"]), len(i["id"])), bool)
    for a in range(0, len(near), TILE):
        part = q["unit"][a:a + TILE] @ i["unit"].T >= threshold
        same = (q["id"][a:a + TILE, None] == i["id"]) & (q["sig"][a:a + TILE, None] == i["sig"])
        near[a:a + TILE] = part & ~same
        x, y = np.nonzero(near[a:a + TILE])
        x += a
        first = np.ones(len(x), bool)
        for t in range(table):                     # an earlier table has counted the pair already
            first &= ~((q["codes"][x, t] == i["codes"][y, t, :1]).any(1) | (i["codes"][y, t] == q["codes"][x, t, :1]).any(1))
        both = (i["codes"][y, table] == q["codes"][x, table, :1]).any(1)
        smaller = (q["id"][x] < i["id"][y]) | ((q["id"][x] == i["id"][y]) & (q["sig"][x] < i["sig"][y]))
        first &= ~both | smaller                   # each probes the other's cell: once is enough
        np.add.at(q_links, x[first], i["n"][y[first]])
        np.add.at(i_links, y[first], q["n"][x[first]])
    while near.any():
        low_q = np.minimum(q_low, np.where(near, i_low, np.iinfo(np.int64).max).min(1))
        low_i = np.minimum(i_low, np.where(near, low_q[:, None], np.iinfo(np.int64).max).min(0))
        done = (low_q == q_low).all() and (low_i == i_low).all()
        q_low, i_low = low_q, low_i
        if done:
            break
    return q_links, i_links, q_low, i_low


def _compared(tables: int, probes: int, threshold: float):
    keys = ["label", "table", "cell", "x", "y"]

    def one(rows: pa.Table):
        codes = rows.column("codes").combine_chunks().flatten().to_numpy().reshape(-1, tables, 1 + probes)
        ids, sigs, n = (rows.column(c).to_numpy() for c in ("id", "sig", "n"))
        home, raw = rows.column("home").to_numpy(zero_copy_only=False).astype(bool), rows.column("raw").to_pylist()
        table, sizes = int(rows.column("table")[0].as_py()), np.array([len(r) for r in raw])
        for d in np.unique(sizes):
            sides = []
            for side in (~home, home):
                own = np.nonzero(side & (sizes == d))[0]
                x = np.frombuffer(b"".join(raw[k] for k in own)).reshape(len(own), d // 8)
                sides.append({"id": ids[own], "sig": sigs[own], "n": n[own], "unit": x / np.linalg.norm(x, axis=1, keepdims=True), "codes": codes[own]})
            if not len(sides[0]["id"]) or not len(sides[1]["id"]):
                continue
            q_links, i_links, q_low, i_low = compare(table, *sides, threshold)
            for s, links, low in ((sides[0], q_links, q_low), (sides[1], i_links, i_low)):
                some = (links > 0) | (low != s["id"])
                yield pa.RecordBatch.from_arrays([pa.array(v[some]) for v in (s["id"], s["sig"], links, low)], names=["id", "sig", "links", "low"])

    def run(batches):
        held, n = [], 0

        def groups(table: pa.Table):
            key = np.stack([table.column(k).to_numpy().astype(np.int64) for k in keys], 1)
            cuts = np.concatenate(([0], np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1, [len(key)]))
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    yield from one(table.slice(a, b - a))

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < 4 * CELL:
                continue
            table = pa.Table.from_batches(held)
            key = np.stack([table.column(k).to_numpy().astype(np.int64) for k in keys], 1)
            change = np.nonzero((key[1:] != key[:-1]).any(axis=1))[0]
            if len(change):                        # all but the last cell are whole
                yield from groups(table.slice(0, int(change[-1]) + 1))
                table = table.slice(int(change[-1]) + 1)
            held, n = table.to_batches(), table.num_rows
        if n:
            yield from groups(pa.Table.from_batches(held))
    return run


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = COSINE, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    ok = F.coalesce(finite & F.col(label).isNotNull() & F.col(key).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("_name"), F.when(ok, x).alias("v"), ok.alias("ok"))
    rows = keep(rows.withColumn("label", F.xxhash64("_name")).withColumn("sig", F.xxhash64("_name", "v")))
    classes = rows.filter("ok").groupBy("label", "sig", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    hashed = keep(classes.select("label", "sig", "id", "v", "n")
                  .mapInArrow(_hashed(tables, probes), "label bigint, sig bigint, id bigint, n bigint, raw binary, codes array<int>"))

    width = 1 + probes
    place = F.explode(F.sequence(F.lit(0), F.lit(tables * width - 1)))
    # The home cell is indexed and probed as well: two vectors of one cell meet there.
    spread = hashed.select("*", place.alias("_k")).withColumn("table", F.floor(F.col("_k") / width).cast("int")).withColumn("cell", F.element_at("codes", (F.col("_k") + 1).cast("int")))
    spread = spread.withColumn("_homes", F.when(F.col("_k") % width == 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False))))
    spread = spread.withColumn("home", F.explode("_homes")).drop("_k", "_homes")
    cell = ["label", "table", "cell"]
    sizes = keep(spread.groupBy(*cell).agg(F.sum(F.col("home").cast("int")).alias("_h"), F.sum((~F.col("home")).cast("int")).alias("_p")))
    # Cells that hold no one, or only their own vector, need no meeting; large ones become a grid.
    useful = keep(sizes.filter("_h > 0 and _p > 1").select(*cell, F.ceil(F.col("_p") / CELL).alias("_qs"), F.ceil(F.col("_h") / CELL).alias("_is")))
    spread = spread.join(useful, cell)
    own = F.pmod(F.xxhash64("id", "sig"), F.when(F.col("home"), F.col("_is")).otherwise(F.col("_qs")))
    spread = spread.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("_qs")).otherwise(F.col("_is")) - 1)))
    spread = spread.withColumn("x", F.when(F.col("home"), F.col("_other")).otherwise(F.col("_own"))).withColumn("y", F.when(F.col("home"), F.col("_own")).otherwise(F.col("_other")))
    grid = ["label", "table", "cell", "x", "y"]
    met = spread.select(*(F.col(c).cast("bigint") for c in grid), "home", "id", "sig", "n", "raw", "codes")
    found = keep(met.repartition(*grid).sortWithinPartitions(*grid).mapInArrow(_compared(tables, probes, threshold), "id bigint, sig bigint, links bigint, low bigint"))

    roots = components(found.select(F.col("id").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("id", "sig").agg(F.sum("links").alias("_links"))
    per_class = (hashed.select("label", "sig", "id", "n").join(links, ["id", "sig"], "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
                 .select("label", "sig", (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("root", "id").alias("_root")))
    named = rows.join(keep(per_class), ["label", "sig"], "left")
    linked = F.col("ok") & F.col("_root").isNotNull()
    return named.select(F.col("id").alias(key), F.when(linked, F.col("_links")).otherwise(0).cast("bigint").alias("n_links"),
                        F.when(linked, F.col("_root")).otherwise(F.col("id")).alias("component_id")).withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
