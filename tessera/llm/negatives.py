"""Hard-negative mining by angular triangle filtering.

Vectors are scaled and floored to integers; a score is their inner product, an integer. Every vector
stores its norm and its angles to a few reference directions. For an anchor at angle s and a row at
angle t to one reference, the angle between both lies in ``[|s - t|, min(s + t, 2 pi - s - t)]``. The
narrowest interval over all references, its cosine and the norms, moved outward by more than any
rounding, bound the score. Only rows whose bounds overlap the wanted window get integer scoring:

1. Positives: the rows of the anchor's label with the highest upper bounds are scored first; their
   last place is the threshold that other rows' upper bounds must reach.
2. Negatives: rows of other labels whose bounds overlap ``[low % of the least positive, the best]``.

Rows lie in blocks of one nearest reference, sorted by the angle to it, so the window is a range of
the block before any other reference is read. Blocks and anchor blocks hold a fixed number of
components and meet in a grid, one task for a cell; a cell returns a few rows for each anchor, and
Spark keeps the best of all cells. Every row is indexed and every anchor meets every block.

References are a farthest-first choice among a bounded sample (``SAMPLE`` rows, by hashed key); they
change the work, never the result. Vectors of a length that the sample lacks have no bounds, and all
their rows are scored.

Defined results: rows with null key, null label, null vector or a component that is null or not
finite (before or after scaling) take no part. Rows that repeat key, label and vector count once;
other rows of one key are rows of their own, ordered by a hash after the key. An anchor's key is no
positive of itself. Vectors of different length have no score. Zero vectors score 0. Scores beyond
the range of a long are cut to plus or minus its greatest value. Columns other than the three named are ignored.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import first_by_hash, keep

SCALE, EVERY, POSITIVES, NEGATIVES, LOW = 256, 100, 5, 5, 80
REFERENCES, SAMPLE, BLOCK = 12, 512, 1 << 18         # BLOCK: components of a block of rows or anchors
SLACK = 1e-6                                         # radians: stored angles are 32-bit
EXACT = 2.0**53                                      # products below this are exact in double precision
LONG = np.iinfo(np.int64).max


def pick_references(units: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Rows of ``units`` that lie far from each other: each is the farthest from those before it."""
    picked = [0]
    near = units @ units[0]
    while len(picked) < min(n, len(units)):
        far = int(near.argmin())
        if near[far] > 1 - 1e-9:
            break
        picked.append(far)
        near = np.maximum(near, units @ units[far])
    return units[picked]


def packed(q: np.ndarray) -> bytes:
    """Integer components in the smallest of three types."""
    most = np.abs(q).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return bytes(kind[1:], "ascii") + q.astype(kind).tobytes()


def unpacked(raw: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(raw), d))
    for k, r in enumerate(raw):
        out[k] = np.frombuffer(r, "<" + r[:2].decode("ascii"), offset=2)
    return out


def norms(q: np.ndarray) -> np.ndarray:
    """Lengths without overflow of the squares."""
    most = np.abs(q).max(axis=1, initial=0)
    return most * np.sqrt(((q / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1))


def angles(q: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    unit = q / np.where(norm > 0, norm, 1)[:, None]
    return np.arccos(np.clip(unit @ references.T, -1, 1)).astype(np.float32)


def _indexed(references: dict[int, np.ndarray], scale: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column(3)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False))
            begin = np.cumsum(sizes) - sizes
            q, norm, angle, home = [b""] * len(sizes), np.zeros(len(sizes)), [b""] * len(sizes), np.zeros(len(sizes), np.int32)
            for d in np.unique(sizes):
                own = np.nonzero(sizes == d)[0]
                x = flat[begin[own][:, None] + np.arange(d)]
                norm[own] = norms(x)
                a = angles(x, norm[own], references[d]) if d in references else np.zeros((len(x), 0), np.float32)
                home[own] = a.argmin(axis=1) if a.shape[1] else 0
                for k, i in enumerate(own):
                    q[i], angle[i] = packed(x[k]), a[k].tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sizes, pa.int32()), pa.array(home), pa.array(norm), pa.array(angle, pa.binary()), pa.array(q, pa.binary())],
                                             names=["id", "label", "sig", "d", "home", "norm", "angles", "q"])
    return run


class Side:
    """Rows of one side of a cell as arrays."""

    def __init__(self, rows: pa.Table, order: bool):
        self.d = int(rows.column("d")[0].as_py())
        self.id, self.label, self.sig, self.norm = (rows.column(c).to_numpy() for c in ("id", "label", "sig", "norm"))
        self.angles = np.frombuffer(b"".join(rows.column("angles").to_pylist()), np.float32).reshape(len(self.id), -1).astype(np.float64)
        self.q = unpacked(rows.column("q").to_pylist(), self.d)
        home = int(rows.column("home")[0].as_py())
        if order and self.angles.shape[1]:
            by = np.argsort(self.angles[:, home], kind="stable")
            self.id, self.label, self.sig, self.norm, self.angles, self.q = (x[by] for x in (self.id, self.label, self.sig, self.norm, self.angles, self.q))
        self.home = self.angles[:, home] if self.angles.shape[1] else None


def bounds(norm: float, angle: np.ndarray, norms: np.ndarray, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of one vector with each row, inside the range of a long."""
    with np.errstate(over="ignore"):
        size = norm * norms
    if not angles.shape[1]:
        return np.full(len(norms), -np.inf), np.full(len(norms), np.inf)
    both = angles + angle
    near = np.abs(angles - angle).max(axis=1) - SLACK
    far = np.minimum(both, 2 * np.pi - both).min(axis=1) + SLACK
    room = 1 + 1e-9 * size
    with np.errstate(invalid="ignore"):
        low, high = size * np.cos(np.minimum(far, np.pi)) - room, size * np.cos(np.maximum(near, 0)) + room
    whole = np.isfinite(size)
    return np.where(whole, np.minimum(low, LONG), -np.inf), np.where(whole, np.maximum(high, -LONG), np.inf)


def scores(a: np.ndarray, norm: float, q: np.ndarray, norms: np.ndarray):
    """Exact integer scores: in doubles where no partial sum can round, else in Python's integers."""
    if float(norm) * float(norms.max(initial=0)) < EXACT:
        return (q @ a).astype(np.int64)
    left = [int(x) for x in a]
    return np.array([max(-LONG, min(LONG, sum(x * int(y) for x, y in zip(left, row)))) for row in q], np.int64)


def best(score: np.ndarray, rows: Side, at: np.ndarray, n: int) -> np.ndarray:
    """Places in ``at`` of the first ``n`` by falling score, then key, then hash."""
    if len(at) > 8 * n:                              # sort only what reaches the last place
        some = np.nonzero(score >= np.partition(score, len(score) - n)[-n])[0]
    else:
        some = np.arange(len(at))
    return some[np.lexsort((rows.sig[at[some]], rows.id[at[some]], -score[some]))[:n]]


def positives_of(k: int, a: Side, rows: Side, n: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.nonzero((rows.label == a.label[k]) & (rows.id != a.id[k]))[0]
    if not len(at):
        return at, at
    high = bounds(a.norm[k], a.angles[k], rows.norm[at], rows.angles[at])[1]
    if len(at) > n:
        first = at[np.argpartition(-high, n - 1)[:n]]
        at = at[high >= scores(a.q[k], a.norm[k], rows.q[first], rows.norm[first]).min()]
    score = scores(a.q[k], a.norm[k], rows.q[at], rows.norm[at])
    some = best(score, rows, at, n)
    return at[some], score[some]


def in_window(k: int, a: Side, rows: Side, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of other labels that can score from ``least`` to ``most``, with their scores."""
    begin, end = 0, len(rows.id)
    if rows.home is not None:
        size = float(a.norm[k]) * float(rows.norm.max())
        if 0 < size < np.inf:                        # the angle to the anchor, and so to the block's reference, is bounded
            width = np.arccos(np.clip((least - 1) / size - 1e-9, -1, 1)) + SLACK
            at = a.home[k]
            begin, end = np.searchsorted(rows.home, [at - width, at + width + 1e-12])
    low, high = bounds(a.norm[k], a.angles[k], rows.norm[begin:end], rows.angles[begin:end])
    at = begin + np.nonzero((rows.label[begin:end] != a.label[k]) & (high >= least) & (low <= most))[0]
    return at, scores(a.q[k], a.norm[k], rows.q[at], rows.norm[at])


def _cell_positives(n: int, names: list[str]):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            a, r = Side(anchors, False), Side(rows, True)
            for k in range(len(a.id)):
                at, score = positives_of(k, a, r, n)
                out.append((np.full(len(at), a.id[k]), np.full(len(at), a.sig[k]), r.id[at], r.sig[at], score))
        return _table(out, names)
    return run


def _cell_negatives(n: int, low: int, names: list[str]):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if anchors.num_rows and rows.num_rows:
            a, r = Side(anchors, False), Side(rows, True)
            for k, wanted in enumerate(anchors.column("positives").to_pylist()):
                wanted = [w for w in wanted if w["score"] >= 0]     # below 0 the window is empty
                if not wanted:
                    continue
                least, most = min(-(-low * w["score"] // 100) for w in wanted), max(w["score"] for w in wanted)
                at, score = in_window(k, a, r, least, most)
                for w in wanted:
                    fit = np.nonzero((score >= -(-low * w["score"] // 100)) & (score <= w["score"]))[0]
                    some = fit[best(score[fit], r, at[fit], n)]
                    same = [np.full(len(some), v, np.int64) for v in (a.id[k], a.sig[k], w["id"], w["sig"], w["score"])]
                    out.append((*same, r.id[at[some]], r.sig[at[some]], score[some]))
        return _table(out, names)
    return run


def _table(out: list[tuple], names: list[str]) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * len(names)
    return pa.table([pa.array(c.astype(np.int64)) for c in columns], names=names)


def index(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """Kept table of (id, label, sig, d, home, norm, angles, q) for (id, label, v)."""
    rows = keep(rows.distinct().select("id", "label", F.xxhash64("label", "v").alias("sig"), "v"))
    sample: dict[int, list] = {}
    for r in first_by_hash(rows, "id", SAMPLE).select("v").collect():
        sample.setdefault(len(r.v), []).append(r.v)
    references = {}
    for d, vectors in sample.items():
        q = np.floor(scale * np.array(vectors, float)).reshape(len(vectors), d)
        size = norms(q)
        if (size > 0).any():
            references[d] = pick_references(q[size > 0] / size[size > 0][:, None])
    return keep(rows.mapInArrow(_indexed(references, scale), "id bigint, label bigint, sig bigint, d int, home int, norm double, angles binary, q binary"))


def grid(anchors: DataFrame, rows: DataFrame, block: int = BLOCK):
    """Both sides grouped by cell: every block of anchors with every block of rows of the same length."""
    parts = F.ceil(F.count("*") * F.col("d") / block)
    homes = rows.groupBy("d", "home").agg(F.greatest(parts, F.lit(1)).alias("_n"))      # one row for each reference
    lists = anchors.groupBy("d").agg(F.greatest(parts, F.lit(1)).alias("_a"))
    homes = keep(homes.join(lists, "d"))
    shape = homes.groupBy("d", "_a").agg(F.collect_list(F.struct("home", F.col("_n").alias("n"))).alias("_homes"))
    own = F.xxhash64("id", "sig")
    left = anchors.drop("home").join(shape, "d").withColumn("y", F.pmod(own, "_a")).withColumn("_h", F.explode("_homes"))
    left = left.withColumn("home", F.col("_h.home")).withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_h.n") - 1)))
    right = rows.join(homes, ["d", "home"]).withColumn("x", F.pmod(own, "_n")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_a") - 1)))
    cell = ["d", "home", "x", "y"]
    left = left.drop("_a", "_homes", "_h")
    left = left.select(*(F.col(c).alias(c) for c in left.columns))     # columns of their own: both sides stem from one table
    return left.groupBy(*cell).cogroup(right.drop("_a", "_n").groupBy(*cell))


def first(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` of each group, ranked; tasks pass on no more than ``n`` of a group."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, every: int = EVERY, scale: int = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are the keys divisible by ``every``.

    ``label`` is an integer expression, the column ``label`` if not given.
    """
    x = F.col(vector).cast("array<double>")
    finite = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) != float("inf")))
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), (F.col("label") if label is None else label).cast("bigint").alias("label"), x.alias("v"))
    rows = index(rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite), scale)
    anchors = rows.filter(F.col("id") % every == 0)

    names = ["a_id", "a_sig", "id", "sig", "score"]
    found = grid(anchors, rows, block).applyInArrow(_cell_positives(positives, names), ", ".join(f"{c} bigint" for c in names))
    order = [F.desc("score"), F.asc("id"), F.asc("sig")]
    chosen = keep(first(found, ["a_id", "a_sig"], order, positives))
    each = chosen.groupBy("a_id", "a_sig").agg(F.collect_list(F.struct("id", "sig", "score")).alias("positives"))
    ready = anchors.join(each, (F.col("id") == F.col("a_id")) & (F.col("sig") == F.col("a_sig"))).drop("a_id", "a_sig")

    names = ["a_id", "a_sig", "p_id", "p_sig", "p_score", "id", "sig", "score"]
    found = grid(keep(ready), rows, block).applyInArrow(_cell_negatives(negatives, low, names), ", ".join(f"{c} bigint" for c in names))
    return first(found, names[:4], order, negatives).select(F.col("a_id").alias("anchor_id"), F.col("p_id").alias("positive_id"), "rank",
                                                           F.col("id").alias("negative_id"), F.col("p_score").alias("positive_score"), F.col("score").alias("negative_score"))


# The same by scoring every anchor with every row.
SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS row_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM q a JOIN q r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, row_id) <= 5)
SELECT p.anchor_id, p.row_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.row_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.row_id ORDER BY n.score DESC, n.row_id)
QUALIFY row_number() OVER w <= 5
"""
