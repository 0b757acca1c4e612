"""Language identification with a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths run over fixed-length windows; each filter's largest
response in the window feeds a softmax. Training reads a bounded, documented number of windows from
labelled text. A text is cut into windows over all its bytes, and its languages' log probabilities
are averaged by the letters of each window. For scoring, the embedding and a filter's weights are
folded into tables by byte pair, so a window costs a few table rows per byte.

A text that is null or has no letters is ``und`` with score 1. Without labelled text every other one
is ``und`` with score 0. Repeated rows are predicted one by one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import first_by_hash, fold, texts_of, whole_text

LENGTH, WIDTHS, FILTERS, EMBED = 96, (2, 3, 4), 16, 8
LANGUAGES = 64           # most frequent labels learned
SAMPLE = 1500            # documents of each language used for fitting
WINDOWS = 6              # windows of a document used for fitting
EPOCHS, BATCH, RATE = 4, 64, 0.004
STEP = 1 << 12           # windows scored at once
PARTS, HELD_OUT = 5, 0


def lowered(text: str) -> bytes:
    return text.encode().lower()


def windows(data: bytes) -> np.ndarray:
    """All bytes in rows of LENGTH, the last one filled with zeros."""
    rows = -(-len(data) // LENGTH)
    return np.frombuffer(data.ljust(rows * LENGTH, b"\0"), np.uint8).reshape(rows, LENGTH)


def letters(x: np.ndarray) -> np.ndarray:
    """ASCII letters and bytes of other scripts in each window."""
    return (((x >= 97) & (x <= 122)) | (x >= 128)).sum(1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over mini-batches of windows ``x`` with class numbers ``y``; classes weigh the same."""
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)), "bias": np.zeros(classes)}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (1 / (w * EMBED)) ** 0.5, (w, EMBED, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    share = np.bincount(y, minlength=classes)
    weight = (len(y) / classes / np.maximum(share, 1)).astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows = order[at:at + BATCH]
            g = gradient(p, x[rows], y[rows], weight)
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                p[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)
    return p


def gradient(p: dict, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    n, e = len(x), p["emb"][x]
    pooled, peaks = [], []
    for w in WIDTHS:
        spans = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)            # n, positions, embed, width
        z = spans.transpose(0, 1, 3, 2).reshape(n, -1, w * EMBED) @ p[f"w{w}"].reshape(w * EMBED, FILTERS) + p[f"b{w}"]
        peak = z.argmax(1)
        pooled.append(np.take_along_axis(z, peak[:, None], 1)[:, 0])
        peaks.append(peak)
    h = np.concatenate(pooled, 1)
    on = h > 0
    h = h * on
    d = softmax(h @ p["out"] + p["bias"])
    d[np.arange(n), y] -= 1
    d *= (weight[y] / n)[:, None]
    g = {"out": h.T @ d, "bias": d.sum(0), "emb": np.zeros_like(p["emb"])}
    dh = (d @ p["out"].T) * on
    for i, w in enumerate(WIDTHS):
        own = dh[:, i * FILTERS:(i + 1) * FILTERS]
        bytes_at = x[np.arange(n)[:, None, None], peaks[i][:, :, None] + np.arange(w)]     # n, filters, width
        g[f"b{w}"] = own.sum(0)
        g[f"w{w}"] = np.einsum("nf,nfwe->wef", own, p["emb"][bytes_at])
        np.add.at(g["emb"], bytes_at, np.einsum("nf,wef->nfwe", own, p[f"w{w}"]))
    return g


def pair_tables(p: dict) -> dict[tuple[int, int], np.ndarray]:
    """Responses of each filter width to a byte pair at an offset; an odd last byte stands alone."""
    out = {}
    for w in WIDTHS:
        single = [p["emb"] @ p[f"w{w}"][j] for j in range(w)]
        for j in range(0, w, 2):
            out[w, j] = (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS) if j + 1 < w else single[j]
    return out


def log_probabilities(p: dict, tables: dict, x: np.ndarray) -> np.ndarray:
    """Log softmax of each window."""
    pairs = x[:, :-1].astype(np.int64) << 8 | x[:, 1:]
    pooled = []
    for w in WIDTHS:
        z, places = None, LENGTH - w + 1
        for j in range(0, w, 2):
            index = pairs[:, j:j + places] if j + 1 < w else x[:, j:j + places]
            part = tables[w, j].take(index, axis=0)
            z = part if z is None else np.add(z, part, out=z)
        pooled.append(z.max(1) + p[f"b{w}"])
    z = np.maximum(np.concatenate(pooled, 1), 0) @ p["out"] + p["bias"]
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def predict(model: dict, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Class number and probability of each text, from all its windows."""
    cut = [windows(lowered(t) or b" ") for t in texts]
    x = np.concatenate(cut)
    tables = _tables(model["key"], model)
    logs = np.concatenate([log_probabilities(model["net"], tables, x[i:i + STEP // 8]) for i in range(0, len(x), STEP // 8)])
    weight = letters(x) + 1e-3
    starts = np.cumsum([0, *(len(c) for c in cut[:-1])])
    mean = np.add.reduceat(logs * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
    sure = softmax(mean)
    best = sure.argmax(1)
    return best, sure[np.arange(len(best)), best]


_HELD: dict = {}


def _tables(key: str, model: dict) -> dict:
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = pair_tables(model["net"])
    return _HELD[key]


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Network from at most ``sample`` labelled documents a language, outside the held-out fold."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", PARTS) != HELD_OUT))
    names = sorted(r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    if not names:
        return None
    picked = None
    for name in names:
        rows = first_by_hash(known.filter(F.col("lang") == name).select("doc_id", "lang"), "doc_id", sample)
        picked = rows if picked is None else picked.unionByName(rows)

    def cut(batches):
        for b in batches:
            lang, data = [], []
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = windows(lowered(text))
                some = own[np.unique(np.linspace(0, len(own) - 1, WINDOWS).astype(int))] if len(own) else own
                for row in some[letters(some) >= 8]:
                    lang.append(names.index(name))
                    data.append(row.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int64()), pa.array(data, pa.binary())], names=["y", "x"])

    rows = texts_of(docs, picked).select("lang", "text").mapInArrow(cut, "y bigint, x binary").orderBy(F.xxhash64("x"), "y").collect()
    if not rows:
        return None
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.uint8).reshape(len(rows), LENGTH)
    net = train(x, np.array([r.y for r in rows]), len(names))
    return {"names": names, "net": net, "key": str(hash(net["out"].tobytes()))}


def predicted(text: Column, model: dict | None) -> Column:
    """Struct of lang_pred and score of a whole text."""
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    unknown = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0 if model is None else 1.0).alias("score"))
    if model is None:
        return unknown

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        values = [t or "" for t in texts.to_pylist()]
        best, sure = predict(model, values) if values else (np.zeros(0, int), np.zeros(0))
        return pa.StructArray.from_arrays([pa.array([model["names"][i] for i in best], pa.string()), pa.array(sure, pa.float64())], names=["lang_pred", "score"])

    return F.when(text.rlike(r"\p{L}"), run(text)).otherwise(unknown)


def predict_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    rows = docs.select("doc_id", (fold("doc_id", PARTS) == HELD_OUT).alias("held_out"), predicted(whole_text(), fit(docs)).alias("_p"))
    return rows.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
