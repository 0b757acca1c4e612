"""Hard negatives against plain Python over all rows."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives
from tessera.llm.common import tune

SCHEMA = "vec_id bigint, embedding array<double>, label int, rank int"


def brute(rows, every=100, scale=256):
    good, seen = [], set()
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (i, lab, tuple(v)) in seen:
            continue
        seen.add((i, lab, tuple(v)))
        good.append((i, lab, [math.floor(scale * x) for x in v]))
    out = []
    for i, lab, v in good:
        if i % every:
            continue
        scored = sorted((-max(-2**63 + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j, other) for j, other, w in good if j != i and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == lab][:5]:
            fit = [(n, j) for n, j, other in scored if other != lab and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(i, pid, r + 1, j, -p, -n) for r, (n, j) in enumerate(fit)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in negatives.mine(df, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("block", [1 << 18, 400])
def test_equals_scoring_all_rows(spark, block):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=12) * (0.1 + i % 3)], i * 7 % 4) for i in range(300)]
    rows += [(1000 + i, [float(x) for x in centres[0]], i % 2) for i in range(130)]                         # ties
    rows += rows[:5]                                                                                       # repeated rows
    rows += [(600, [0.0] * 12, 1), (601, [-0.0] * 12, 2), (700, [], 1), (701, [], 2), (800, [1.0, 2.0], 1), (801, [1.0, 1.9], 2), (802, [1.1, 2.0], 1)]
    rows += [(900, [1e9] * 12, 1), (901, [1.1e9] * 12, 1), (902, [1e9] * 11 + [9.9e8], 2), (2100, [3e160] * 12, 1), (2101, [2e160] * 12, 1), (2102, [2e160] * 12, 3)]
    rows += [(2000, None, 1), (2200, [None] * 12, 1), (2300, [float("nan")] * 12, 1), (2400, [float("inf")] * 12, 1), (2500, rows[0][1], None), (None, rows[0][1], 1)]
    df = tune(spark).createDataFrame([(*r, 9) for r in rows], SCHEMA)
    got = mined(df, block=block)
    assert got == brute(rows) and len(got) > 60


def test_bounds_hold_and_prune(spark):
    rng = np.random.default_rng(4)
    q = np.floor(256 * np.concatenate([rng.normal(size=(200, 8)), np.repeat(rng.normal(size=(1, 8)), 20, 0), -rng.normal(size=(1, 8)).repeat(5, 0), np.eye(8)]))
    size = negatives.norms(q)
    angle = negatives.angles(q, size, negatives.pick_references(q / size[:, None])).astype(float)
    outside = 0
    for k in range(len(q)):
        low, high = negatives.bounds(size[k], angle[k], size, angle)
        true = q @ q[k]
        assert (low <= true).all() and (true <= high).all()
        outside += (high < 0.8 * true.max()).sum()
    assert outside > len(q) * len(q) // 4


def test_empty_and_anchorless_tables(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(1, [1.0], 1, 0), (2, [1.0], 2, 0)], SCHEMA)) == []
    assert mined(spark.createDataFrame([(100, [1.0], 1, 0), (2, [1.0], 2, 0)], SCHEMA)) == []            # no positive


def test_given_table_equals_plain_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = [(r.vec_id, r.embedding, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10) for r in df.collect()]
    got = mined(df, label=label)
    assert got == brute(rows) and got
