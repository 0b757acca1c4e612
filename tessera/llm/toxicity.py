"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned from a bounded sample of labelled texts: words and word beginnings (written
``begin*``) whose documents are toxic far more often than chance, found by a distributed count. Features are densities of lexicon words (as
written, and after undoing obfuscation), their nearness to second-person words, capitals,
punctuation and obfuscation rates. Trees are fitted on the sample's features.

Null and empty texts are scored like any other, with all densities zero. Without labelled rows of
both kinds the score is 0. Repeated labels of one document count as toxic if one of them is.
"""
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting
from .common import first_by_hash, fold, keep, texts_of, whole_text

SAMPLE = 3000            # labelled documents of each kind used for fitting
LEXICON = 200            # words kept
SUPPORT = 0.03           # share of the toxic sample in which a lexicon word occurs at least
ODDS = 1.5               # log odds of toxic to other documents, at least
PARTS, HELD_OUT = 3, 1
STEMS = (4, 5, 6, 7)     # letters of the word beginnings considered
NEAR = 4                 # words between a lexicon word and a second-person word
# Second-person words of the languages served.
SECOND = frozenset("you your yours yourself u ur ya du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
# Characters that stand in for letters.
UNLEET = str.maketrans("013457@$!|+", "oieastasilt")
EDGE = string.punctuation + "«»“”„’‘…¡¿"


def plain_words(text: str) -> list[str]:
    return [w.strip(EDGE) for w in text.lower().split()]


def undisguised(word: str) -> str:
    """Stand-ins read as letters, other marks dropped, letters repeated three times or more once."""
    letters = [c for c in word.translate(UNLEET) if c.isalpha()]
    return "".join(c for i, c in enumerate(letters) if i < 2 or not c == letters[i - 1] == letters[i - 2])


def entries(word: str):
    """The word and its beginnings, as the lexicon lists them."""
    yield word
    for k in STEMS:
        if len(word) >= k:
            yield word[:k] + "*"


def strength_of(word: str, weights: dict[str, float], openings: frozenset) -> float:
    """Largest weight of the word's entries, 0 if it has none."""
    if word[:STEMS[0]] not in openings:
        return 0.0
    return max((weights.get(e, 0.0) for e in entries(word)), default=0.0)


def openings(weights: dict[str, float]) -> frozenset:
    """First letters that any lexicon word has, to pass over most words at once."""
    return frozenset(w.rstrip("*")[:STEMS[0]] for w in weights)


def features(text: str, weights: dict[str, float], first: frozenset = None) -> list[float]:
    first = openings(weights) if first is None else first
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    chars, upper, lower = max(1, int(raw.sum())), int(raw[65:91].sum()), int(raw[97:123].sum())
    digits, bang, ask = int(raw[48:58].sum()), int(raw[33]), int(raw[63])
    marks = int(raw[33:48].sum() + raw[58:65].sum() + raw[91:97].sum() + raw[123:127].sum())
    words = plain_words(text)
    n = max(1, len(words))
    head = STEMS[0]
    found = {i: f for i, w in enumerate(words) if w[:head] in first and (f := strength_of(w, weights, first))}
    odd = [(i, w) for i, w in enumerate(words) if w and not w.isalpha()]
    hidden = {i: f for i, w in odd if i not in found and (f := strength_of(undisguised(w), weights, first))}
    every = sorted(found | hidden)
    second = [i for i, w in enumerate(words) if w in SECOND]
    close = 0
    if second and every:
        s = np.array(second)
        at = np.searchsorted(s, every)
        gap = np.minimum(np.abs(s[np.minimum(at, len(s) - 1)] - every), np.abs(s[np.maximum(at - 1, 0)] - every))
        close = int((gap <= NEAR).sum())
    runs = sum(b - a <= 12 for a, b in zip(every, every[1:]))
    strength, most = sum(found.values()), max(found.values(), default=0.0)
    return [most, len(every), len(every) / n, len({words[i] for i in every}), strength / n, strength, len(hidden) / n, close / n, close, runs / n,
            len(second) / n, upper / max(1, upper + lower), marks / chars, bang / chars, ask / chars, digits / chars, len(odd) / n, float(np.log1p(n))]


def labelled(labels: DataFrame, column: str, parts: int, held_out: int) -> DataFrame:
    """(doc_id, y) of documents that may be learned from."""
    rows = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).filter(fold("doc_id", parts) != held_out)
    return rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))


def lexicon(sample: DataFrame, words: int = LEXICON) -> dict[str, float]:
    """Words with their log odds; ``sample(y, text)`` is bounded, the counting is distributed."""
    def distinct(batches):
        for b in batches:
            w, y = [], []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {e for x in set(plain_words(text)) if x.isalpha() for e in entries(x)}
                w += own
                y += [label] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(y, pa.int64())], names=["word", "y"])

    counts = sample.select("y", "text").mapInArrow(distinct, "word string, y bigint").groupBy("word").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
    odds = F.log((F.col("t") + 0.5) / (F.col("n") - F.col("t") + 0.5))
    toxic = sample.filter("y = 1").count()
    best = counts.filter(F.col("t") >= max(3, SUPPORT * toxic)).withColumn("odds", odds).filter(F.col("odds") >= ODDS).orderBy(F.desc("t"), "word").limit(words)
    return {r.word: float(r.odds) for r in best.collect()}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Model from at most ``sample`` toxic and ``sample`` other labelled documents outside the held-out fold."""
    known = labelled(labels, "toxic", PARTS, HELD_OUT)
    rates = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picked = first_by_hash(known.filter("y = 1"), "doc_id", sample).unionByName(first_by_hash(known.filter("y = 0"), "doc_id", sample))
    texts = keep(texts_of(docs, picked).dropDuplicates(["doc_id"]))
    words = lexicon(texts)
    rows = texts.select("y", feature_column(F.col("text"), words).alias("x"), F.xxhash64("doc_id").alias("h")).orderBy("h").collect()
    y = np.array([r.y for r in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    x = np.array([r.x for r in rows], float)
    # The sample is balanced; weights give each kind its share among all labelled rows.
    weight = np.where(y == 1, rates[1] / y.sum(), rates[0] / (1 - y).sum())
    return boosting.fit(x, y, weight * len(y) / weight.sum()) | {"words": words}


def feature_column(text: Column, words: dict[str, float]) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[float(v) for v in features(t or "", words)] for t in texts.to_pylist()], pa.list_(pa.float64()))
    return run(text)


def score(text: Column, model: dict | None) -> Column:
    """Calibrated probability of toxicity of a whole text."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf(T.DoubleType())
    def run(texts: pa.Array) -> pa.Array:
        first = openings(model["words"])
        x = [features(t or "", model["words"], first) for t in texts.to_pylist()]
        return pa.array(boosting.calibrated(model, np.array(x, float)) if x else [], pa.float64())
    return run(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    scored = docs.select("doc_id", (fold("doc_id", PARTS) == HELD_OUT).alias("held_out"), score(whole_text(), fit(docs, labels)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
