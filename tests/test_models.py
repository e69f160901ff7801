"""Boosting stopped by patience, the perceptron's gradient rounds, and what is read off their nodes and weights."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from candlemill.models import boosting as B, perceptron as P, training as T


def test_patience_counts_from_the_first_least_loss():
    assert B.best_round([3.0, 2.0, 2.0, 2.5, 1.0], 2) == (2, True)  # patience runs out before the lowest
    assert B.best_round([3.0, 2.0, 2.5, 1.0, 1.5], 2) == (4, False)
    assert B.best_round([1.0], 5) == (1, False)


@pytest.mark.parametrize("dropout", [False, True])
def test_gradient_against_differences(dropout):
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(9, 3)), draw.integers(0, 2, 9).astype(float)
    w = P.start_weights(3, 5)
    mask = P.keep_mask(draw.integers(0, 2**62, 9), 4) if dropout else None
    grad, loss = P.gradient(w, x, y, mask)
    assert loss == pytest.approx(P.losses(P.forward(w, x, mask)[0], y).sum())
    for i in draw.integers(0, len(w), 60):
        e = np.zeros(len(w))
        e[i] = 1e-6
        near = (P.gradient(w + e, x, y, mask)[1] - P.gradient(w - e, x, y, mask)[1]) / 2e-6
        assert grad[i] == pytest.approx(near, abs=1e-5)


def _rows(spark, n, seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0).astype(float)
    return x, y, spark.createDataFrame([(i, float(b), Vectors.dense(a)) for i, (a, b) in enumerate(zip(x.tolist(), y))], ["id", "y", "features"])


def test_epochs_against_whole_arrays(spark):
    """Partitions do not matter: the losses are those of full-batch steps over one array, and the best epoch is kept."""
    x, y, train = _rows(spark, 120, 2)
    vx, vy, held = _rows(spark, 60, 3)
    model = P.fit_perceptron(train.repartition(5), held, "y", "id", seed=4, epochs=4, batches=1, dropout=False)
    w, want = P.start_weights(3, 4), []
    adam = P.AdamW(len(w), 0.01)
    for _ in range(4):
        w = adam.step(w, P.gradient(w, x, y)[0] / len(y))
        want.append(P.losses(P.forward(w, vx)[0], vy).mean())
    assert model.history == pytest.approx(want, abs=1e-9) and model.best_epoch == int(np.argmin(want)) + 1
    assert P.losses(P.forward(model.weights, vx)[0], vy).mean() == pytest.approx(min(want), abs=1e-9)


def test_boosting_is_cut_and_its_nodes_tell_the_gains(spark):
    x, y, train = _rows(spark, 120, 5)
    _, _, held = _rows(spark, 60, 6)
    fit = B.fit_boosted(train, held, "y", rounds=3, first=3)
    assert len(fit.losses) == 3 and fit.rounds == B.best_round(fit.losses, 40)[0]
    assert B.cut(fit.model, 1).getNumTrees == 1
    nodes = B.tree_nodes(fit.model).collect()
    by = {(r.tree, r.node): r for r in nodes}

    def margin(row):  # predictions from the nodes alone
        total = 0.0
        for t in {r.tree for r in nodes}:
            n = by[t, 0]
            while n.left >= 0:
                n = by[t, n.left if row[n.feature_index] <= n.threshold else n.right]
            total += n.weight * n.prediction
        return 1 / (1 + np.exp(-2 * total))

    got = {r.id: r.probability[1] for r in fit.transform(train).select("id", "probability").collect()}
    assert all(got[i] == pytest.approx(margin(row), abs=1e-9) for i, row in enumerate(x.tolist()))
    gains = {r.feature: r for r in B.split_gains(B.tree_nodes(fit.model), ["a", "b", "c"]).collect()}
    assert sum(r.splits for r in gains.values()) == sum(n.left >= 0 for n in nodes)
    assert sum(r.importance for r in gains.values()) == pytest.approx(1.0) and max(gains, key=lambda f: gains[f].importance) == "a"


def test_logistic_scores_in_a_session_with_job_tags(spark):
    """Scoring tasks do not carry the session along: once it has had job tags, it cannot be serialized."""
    own = spark.newSession()
    own.addTag("tagged")
    rows = own.createDataFrame([(i, float(i % 5 > 1), float(i % 7 + i % 5), "validation" if i % 3 == 0 else "train") for i in range(60)], ["id", "y", "a", "split"])
    fits, prep = T.fit_models(rows, ["a"], [], "y", "id", rounds=1, epochs=1)
    scored = T.predict(fits["logistic"], prep.apply(rows)).repartition(3, "id").select("id", "probability").collect()
    assert len(scored) == 60 and all(0 < r.probability < 1 for r in scored)
