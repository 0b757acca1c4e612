"""Learned scores: held-out accuracy on the given tables, edge rows, and the parts they are made of."""
import numpy as np
import pytest

from tessera.llm import boosting, langid, quality, queries, toxicity
from tessera.llm.common import tune

SF = "/root/testdata/sf0.1"


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def held_out(spark, name, column):
    rows = queries.QUERIES[name](spark, SF).filter("held_out").join(queries.table(spark, SF, "labels"), "doc_id").select("score", "predicted", column).collect()
    return (np.array([r[k] for r in rows]) for k in ("score", "predicted", column))


def test_toxicity_held_out(spark):
    score, predicted, y = held_out(spark, "op7_toxicity", "toxic")     # a fifth of these labels marks texts without any toxic word
    assert area(score, y) > 0.88 and predicted[y == 1].mean() > 0.75 and predicted[y == 0].mean() < 0.01


def test_quality_held_out(spark):
    score, predicted, y = held_out(spark, "op3_quality", "quality")
    assert area(score, y) > 0.97 and predicted[y == 1].mean() > 0.99 and predicted[y == 0].mean() < 0.3


def test_language_held_out(spark):
    rows = queries.QUERIES["op4_langid"](spark, SF).filter("held_out").join(queries.table(spark, SF, "documents"), "doc_id").filter("lang is not null").select("lang", "lang_pred").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", 3), (2, "", "en", 3), (3, "12 34 !!", None, 3), (4, "word " * 200000, "en", 3), (None, "text of a null key", "de", 3), (5, "\x00", "de", 3), (5, "\x00", "de", 3)]
    return tune(spark).createDataFrame(rows, "doc_id bigint, text string, lang string, score int")


def test_edge_rows(spark, odd):
    labels = spark.createDataFrame([(4, 1, 1), (1, 0, 0), (2, 1, 0), (None, 1, 1), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for part in (labels, labels.limit(0)):
        for module in (toxicity, quality):
            got = module.score_documents(odd, part).collect()
            assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted in (0, 1) and r.held_out is not None for r in got)
            assert module.score_documents(odd.limit(0), part).count() == 0
    assert {r.score for r in toxicity.score_documents(odd, labels.limit(0)).collect()} == {0.0}
    got = langid.predict_documents(odd).collect()
    assert len(got) == 7 and [r.lang_pred for r in got if r.doc_id in (1, 2, 3, 5)] == ["und"] * 5
    assert langid.predict_documents(odd.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict_documents(odd.withColumn("lang", odd.lang.substr(9, 1)).filter("lang is null")).collect()} == {"und"}


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    z, y = np.sort(rng.normal(size=60)), rng.integers(0, 2, 60).astype(float)
    x, v = boosting.isotonic(z, y, np.ones(60))
    fit = np.interp(z, x, v)
    assert (np.diff(v) >= 0).all()
    best = [max(min(y[a:b + 1].mean() for b in range(i, 60)) for a in range(i + 1)) for i in range(60)]
    assert np.allclose(fit, best)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert area(boosting.predict_margin(boosting.fit_trees(x, y, np.ones(2000)), x), y) > 0.95


def test_obfuscated_words_are_found():
    plain = toxicity.features("you are an idiot now", {"idiot": 5.0})
    hidden = toxicity.features("you are an 1d.i0t now", {"idiot": 5.0})
    assert plain[1] == hidden[1] == 1 and hidden[6] > 0 == plain[6] and plain[8] == hidden[8] == 1


def test_class_prior_is_recovered():
    rng = np.random.default_rng(2)
    p = rng.normal(2, 1, (3000, 2))
    u = np.concatenate([rng.normal(2, 1, (1800, 2)), rng.normal(-2, 1, (1200, 2))])
    edges = boosting.quantile_edges(np.concatenate([p, u]), 16)
    size = 1 + sum(len(e) + 1 for e in edges)
    assert abs(quality.class_prior(quality.columns(p, edges), quality.columns(rng.permutation(u), edges), size) - 0.6) < 0.08


def test_pair_tables_equal_the_network():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 256, (200, langid.LENGTH), dtype=np.uint8), rng.integers(0, 3, 200)
    net = langid.train(x, y, 3)
    logs = langid.log_probabilities(net, langid.pair_tables(net), x)
    e, pooled = net["emb"][x], []
    for w in langid.WIDTHS:
        z = sum(e[:, j:langid.LENGTH - w + 1 + j] @ net[f"w{w}"][j] for j in range(w)) + net[f"b{w}"]
        pooled.append(np.maximum(z.max(1), 0))
    want = np.log(langid.softmax(np.concatenate(pooled, 1) @ net["out"] + net["bias"]))
    assert np.allclose(logs, want, atol=1e-3)


def test_gradient_matches_differences():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 256, (8, langid.LENGTH), dtype=np.uint8), rng.integers(0, 2, 8)
    p = {k: v.astype(np.float64) for k, v in langid.train(x, y, 2).items()}
    one = np.ones(2)

    def loss():
        return -langid.log_probabilities(p, langid.pair_tables(p), x)[np.arange(8), y].mean()

    g = langid.gradient(p, x, y, one)
    for k in ("out", "bias", "w3", "b2", "emb"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        p[k][at] += 1e-5
        up = loss()
        p[k][at] -= 2e-5
        down = loss()
        p[k][at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-3 * max(1, abs(g[k][at])), k
