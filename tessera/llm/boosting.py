"""Gradient-boosted trees on quantile bins, and isotonic calibration, in numpy; trained on bounded samples."""
import numpy as np

TREES, DEPTH, RATE, BINS, SMOOTH, LEAF = 80, 3, 0.2, 32, 1.0, 5.0


def quantile_edges(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Inner bin edges of each feature."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> dict:
    """Second-order boosting of the logistic loss; every tree is a full tree of feature, bin and leaf arrays."""
    edges = quantile_edges(x)
    b = to_bins(x, edges)
    n, features = b.shape
    base = float(np.log((weight @ y + 1) / (weight @ (1 - y) + 1)))
    margin, forest = np.full(n, base), []
    width = max((len(e) for e in edges), default=0) + 1
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = weight * (p - y), weight * p * (1 - p)
        node, split_f, split_b = np.zeros(n, np.int64), [], []
        for level in range(depth):
            count = 1 << level
            best = np.full(count, 1e-9)
            choice_f, choice_b = np.zeros(count, np.int64), np.full(count, width)     # no gain: all rows go left
            for f in range(features):
                slot = node * width + b[:, f]
                gs = np.bincount(slot, g, count * width).reshape(count, width)
                hs = np.bincount(slot, h, count * width).reshape(count, width)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                gt, ht = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + SMOOTH) + (gt - gl)**2 / (ht - hl + SMOOTH) - gt**2 / (ht + SMOOTH)
                gain[(hl < LEAF / 20) | (ht - hl < LEAF / 20)] = 0
                if gain.shape[1]:
                    at = gain.argmax(1)
                    top = gain[np.arange(count), at]
                    better = top > best
                    best[better], choice_f[better], choice_b[better] = top[better], f, at[better]
            split_f.append(choice_f)
            split_b.append(choice_b)
            node = node * 2 + (b[np.arange(n), choice_f[node]] > choice_b[node])
        leaves = 1 << depth
        leaf = -RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + SMOOTH)
        margin += leaf[node]
        forest.append((split_f, split_b, leaf))
    return {"edges": edges, "base": base, "forest": forest}


def predict_margin(model: dict, x: np.ndarray) -> np.ndarray:
    b = to_bins(x, model["edges"])
    rows, out = np.arange(len(b)), np.full(len(b), model["base"])
    for split_f, split_b, leaf in model["forest"]:
        node = np.zeros(len(b), np.int64)
        for f, at in zip(split_f, split_b):
            node = node * 2 + (b[rows, f[node]] > at[node])
        out += leaf[node]
    return out


def isotonic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and values of the best non-decreasing fit."""
    order = np.argsort(z, kind="stable")
    blocks: list[list[float]] = []                 # weighted sum, weight, first and last margin
    for k in order:
        blocks.append([weight[k] * y[k], weight[k], z[k], z[k]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, w, _, last = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = last
    x = np.array([e for b in blocks for e in (b[2], b[3])])
    v = np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])
    return x, v


def calibrated(model: dict, x: np.ndarray) -> np.ndarray:
    """Isotonic value with a small part of the plain probability, which orders rows inside flat steps."""
    z = predict_margin(model, x)
    return 0.98 * np.interp(z, *model["steps"]) + 0.02 * sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, parts: int = 4) -> dict:
    """Trees on all rows; calibration on margins of trees that have not seen the row."""
    part = np.arange(len(y)) % parts
    z = np.zeros(len(y))
    for k in range(parts):
        seen, own = part != k, part == k
        if own.any() and seen.any():
            z[own] = predict_margin(fit_trees(x[seen], y[seen], weight[seen], TREES // 2), x[own])
    model = fit_trees(x, y, weight)
    return model | {"steps": isotonic(z, y, weight)}
