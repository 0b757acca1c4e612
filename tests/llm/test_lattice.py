"""Lattice hashing against all pairs."""
import numpy as np
import pytest

from tessera.llm import lattice
from tessera.llm.common import tune


def brute(rows, threshold=lattice.COSINE):
    good = [k for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    unit = {k: np.array(rows[k][1], float) / np.linalg.norm(np.array(rows[k][1], float)) for k in good}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least = {}
    for k in good:
        least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return [(rows[k][0], links[k], least[find(k)] if k in set(good) else rows[k][0]) for k in range(len(rows))]


@pytest.mark.parametrize("cell", [1024, 6])
def test_equals_all_pairs(spark, monkeypatch, cell):
    monkeypatch.setattr(lattice, "CELL", cell)      # small: cells become grids
    rng = np.random.default_rng(1)
    rows, centres = [], rng.normal(size=(12, 32))
    for i in range(260):
        noise = rng.normal(size=32) * (0.06 if i % 2 else 1.0)
        rows.append((i, [float(x) for x in np.float32(centres[i % 12] + noise)], i % 2 + i % 3 // 2))
    rows += [(1000 + k, rows[k % 3][1], rows[k % 3][2]) for k in range(20)]                      # exact copies
    rows += [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 32, 1), (2003, [float("nan")] * 32, 1), (2004, [None] * 32, 1), (2005, rows[0][1], None),
             (2006, [1.0, 2.0], 1), (2007, [1.0, 2.0], 1), (None, rows[0][1], rows[0][2])]
    df = tune(spark).createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, kept string")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(df).collect())
    want = sorted((i if i is not None else -1, n, c, i == c) for i, n, c in brute(rows))
    assert got == want


def test_empty_table(spark):
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_decoding_finds_the_nearest_point():
    rng, around = np.random.default_rng(2), lattice.neighbours()
    y = rng.normal(0, 3, (500, 8))
    c = lattice.decode(y)
    twice = np.rint(2 * c).astype(int)
    assert ((twice % 2).min(1) == (twice % 2).max(1)).all() and (c.sum(1) % 2 == 0).all()
    gap = ((y[:, None] - (c[:, None] + around[None])) ** 2).sum(2).min(1)
    assert (((y - c) ** 2).sum(1) <= gap + 1e-9).all() and len(around) == 240


def test_recall_on_the_given_table(spark):
    import pyarrow.parquet as pq
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in pq.read_table(f"{sf}/embeddings.parquet").to_pylist()]
    unit = np.array([r[1] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    labels = np.array([r[2] for r in rows])
    true = ((unit @ unit.T >= lattice.COSINE) & (labels[:, None] == labels)).sum(1) - 1
    got = {r.vec_id: r.n_links for r in lattice.near_duplicates(tune(spark).read.parquet(f"{sf}/embeddings.parquet")).collect()}
    found = np.array([got[r[0]] for r in rows])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum()
