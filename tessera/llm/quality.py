"""Quality by positive-unlabelled learning.

Trusted positives are labelled documents of good quality; everything else is unlabelled web text.
An additive logistic model over quantile bins of text statistics minimises the non-negative unbiased
risk  prior E_p[l(g)] + max(0, E_u[l(-g)] - prior E_p[l(-g)]).  The class prior is estimated: a
plain positive-against-unlabelled model is fitted on one half, and on the other half the smallest
ratio of unlabelled to positive rows above a threshold bounds the share of positives.

Null and empty texts are scored like any other. Without trusted positives every score is 1.
"""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import quantile_edges, sigmoid, to_bins
from .common import first_by_hash, fold, texts_of, whole_text
from .toxicity import labelled

SAMPLE = 6000            # positives, and as many unlabelled documents, used for fitting
PARTS, HELD_OUT = 5, 0
BINS, STEPS, RATE, DECAY = 16, 600, 0.05, 1e-5


def features(text: str) -> list[float]:
    data = text.encode()
    raw = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, upper, lower = max(1, len(data)), int(raw[65:91].sum()), int(raw[97:123].sum())
    symbols = int(raw[35:39].sum() + raw[42:44].sum() + raw[60:63].sum() + raw[[64, 92, 94, 95, 96, 123, 125, 126]].sum())
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    sentences = [s for s in text.replace("\n", ".").split(".") if s.strip()]
    pairs = list(zip(words, words[1:]))
    return [float(np.log1p(len(data))), upper / max(1, upper + lower), symbols / size, raw[124] / n, raw[33] / n, raw[48:58].sum() / size,
            raw[[44, 46]].sum() / n, raw[10] / n, len(set(words)) / n**0.8, len(set(pairs)) / max(1, len(pairs)), len(set(sentences)) / max(1, len(sentences)),
            float(lengths.mean()), float((lengths <= 3).mean()), float(lengths.std()), n / max(1, len(sentences)),
            len(zlib.compress(data, 1)) / (size + 40), raw[128:].sum() / size, raw[[58, 47, 61, 40, 41]].sum() / size]


def columns(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Each row's active columns of the one-hot bins; column 0 is always on."""
    first = 1 + np.cumsum([0, *(len(e) + 1 for e in edges[:-1])])
    return np.concatenate([np.zeros((len(x), 1), np.int64), to_bins(x, edges) + first], 1)


def mean_gradient(at: np.ndarray, slope: np.ndarray, size: int) -> np.ndarray:
    """Mean over rows of slope times active columns."""
    return np.bincount(at.ravel(), np.repeat(slope, at.shape[1]), size) / len(at)


def descend(gradient, size: int, steps: int = STEPS) -> np.ndarray:
    """Adam on a full gradient."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w) + DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def nn_pu(p: np.ndarray, u: np.ndarray, size: int, prior: float) -> np.ndarray:
    """Weights that minimise the non-negative unbiased risk of the logistic loss."""
    def gradient(w):
        sp, su = sigmoid(w[p].sum(1)), sigmoid(w[u].sum(1))
        negative = -np.log(np.maximum(1 - su, 1e-12)).mean() + prior * np.log(np.maximum(1 - sp, 1e-12)).mean()
        part = mean_gradient(u, su, size) - prior * mean_gradient(p, sp, size)
        if negative < 0:
            return -part                           # overfitted: climb back instead of descending
        return part + prior * mean_gradient(p, sp - 1, size)
    return descend(gradient, size)


def class_prior(p: np.ndarray, u: np.ndarray, size: int) -> float:
    """Share of positives among unlabelled rows: smallest ratio of tail masses on rows left out of the fit."""
    a, b = p[::2], u[::2]

    def gradient(w):
        return (mean_gradient(b, sigmoid(w[b].sum(1)), size) + mean_gradient(a, sigmoid(w[a].sum(1)) - 1, size)) / 2
    w = descend(gradient, size, STEPS // 2)
    sp, su = np.sort(w[p[1::2]].sum(1)), np.sort(w[u[1::2]].sum(1))
    if not len(sp) or not len(su):
        return 0.5
    cuts = np.quantile(sp, np.linspace(0, 0.9, 91))
    tail_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    tail_u = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(40) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    at = np.argmin((tail_u + slack) / tail_p)
    return float(np.clip(tail_u[at] / tail_p[at], 0.05, 0.99))


def train(p: np.ndarray, u: np.ndarray, size: int) -> dict:
    prior = class_prior(p, u, size)
    return {"prior": prior, "weights": nn_pu(p, u, size, prior)}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Model from bounded samples of positives and of unlabelled documents outside the held-out fold."""
    good = labelled(labels, "quality", PARTS, HELD_OUT).filter("y = 1")
    chosen = first_by_hash(good, "doc_id", sample)
    web = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & (fold("doc_id", PARTS) != HELD_OUT)).join(F.broadcast(chosen), "doc_id", "left_anti")
    chosen = chosen.unionByName(first_by_hash(web, "doc_id", sample).withColumn("y", F.lit(0)))
    rows = texts_of(docs, chosen).select("y", feature_column(F.col("text")).alias("x"), F.xxhash64("doc_id").alias("h")).orderBy("h").collect()
    x, y = np.array([r.x for r in rows], float), np.array([r.y for r in rows])
    if not (y == 1).any() or not (y == 0).any():
        return None
    edges = quantile_edges(x, BINS)
    return {"edges": edges} | train(columns(x[y == 1], edges), columns(x[y == 0], edges), 1 + sum(len(e) + 1 for e in edges))


def feature_column(text: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[float(v) for v in features(t or "")] for t in texts.to_pylist()], pa.list_(pa.float64()))
    return run(text)


def score(text: Column, model: dict | None) -> Column:
    """Probability that a whole text is of good quality."""
    if model is None:
        return F.lit(1.0)

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        x = [features(t or "") for t in texts.to_pylist()]
        return pa.array(sigmoid(model["weights"][columns(np.array(x, float), model["edges"])].sum(1)) if x else [], pa.float64())
    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = docs.select("doc_id", (fold("doc_id", PARTS) == HELD_OUT).alias("held_out"), score(whole_text(), fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
