"""TreeSHAP against brute-force Shapley values of the path-dependent value function."""

from itertools import combinations
from math import factorial

import numpy as np

from churnlake.operators.treeshap import Ensemble, Tree, explain_batch


def _tree(rng, n_features, depth):
    left, right, feat, thr, val, cover = [], [], [], [], [], []

    def build(d, c):
        i = len(left)
        left.append(-1); right.append(-1); feat.append(-1); thr.append(0.0)
        val.append(float(rng.normal())); cover.append(c)
        if d < depth:
            f = int(rng.integers(n_features))
            share = float(rng.uniform(0.2, 0.8))
            feat[i] = f; thr[i] = float(rng.normal())
            left[i] = build(d + 1, c * share)
            right[i] = build(d + 1, c * (1 - share))
        return i

    build(0, 100.0)
    return Tree(np.array(left), np.array(right), np.array(feat), np.array(thr), np.array(val),
                np.array(cover), float(rng.uniform(0.5, 1.5)))


def _cond_exp(t: Tree, x, S, node=0):
    if t.left[node] < 0:
        return t.value[node]
    f = t.feature[node]
    l, r = t.left[node], t.right[node]
    if f in S:
        return _cond_exp(t, x, S, l if x[f] <= t.threshold[node] else r)
    return (t.cover[l] * _cond_exp(t, x, S, l) + t.cover[r] * _cond_exp(t, x, S, r)) / t.cover[node]


def _brute(ens: Ensemble, x):
    M = ens.n_features
    phi = np.zeros(M)
    for i in range(M):
        others = [j for j in range(M) if j != i]
        for k in range(len(others) + 1):
            for S in combinations(others, k):
                w = factorial(k) * factorial(M - k - 1) / factorial(M)
                for t in ens.trees:
                    phi[i] += w * t.weight * (_cond_exp(t, x, set(S) | {i}) - _cond_exp(t, x, set(S)))
    return phi


def test_matches_brute_force_and_adds_up():
    rng = np.random.default_rng(7)
    M = 4
    ens = Ensemble("boosting", [_tree(rng, M, 4) for _ in range(3)], M)
    X = rng.normal(size=(25, M))
    phi = explain_batch(ens, X)
    for r in range(len(X)):
        np.testing.assert_allclose(phi[r], _brute(ens, X[r]), atol=1e-9)
    np.testing.assert_allclose(phi.sum(axis=1) + ens.expected_value(), ens.predict(X), atol=1e-9)


def test_deep_trees_are_explained():
    rng = np.random.default_rng(3)

    def chain(depth):
        """A tree of that depth with one path: every inner node has a leaf on its right."""
        n = 2 * depth + 1
        inner = np.arange(depth)
        left, right = np.full(n, -1), np.full(n, -1)
        left[inner], right[inner] = np.append(inner[1:], depth), depth + 1 + inner
        feature = np.full(n, -1)
        feature[inner] = inner % 3
        cover = np.concatenate((np.arange(depth + 1, 0, -1.0), np.ones(depth)))
        return Tree(left, right, feature, rng.normal(size=n), rng.normal(size=n), cover, 1.0)

    ens = Ensemble("forest", [chain(18), chain(25)], 3)
    X = rng.normal(size=(10, 3))
    phi = explain_batch(ens, X)
    np.testing.assert_allclose(phi.sum(axis=1) + ens.expected_value(), ens.predict(X), atol=1e-9)
    for r in range(3):
        np.testing.assert_allclose(phi[r], _brute(ens, X[r]), atol=1e-9)


def test_deep_forest_finishes():
    """200 trees of depth 30: time is linear in the nodes, not in leaves times path length squared."""
    import time
    rng = np.random.default_rng(5)

    def random_tree(depth):
        left, right, feature, cover = [], [], [], []

        def build(d, c):
            i = len(left)
            left.append(-1), right.append(-1), feature.append(-1), cover.append(c)
            if d < depth and c > 1.5 and (d < 3 or rng.random() < 0.9):
                share = rng.uniform(0.05, 0.95)
                feature[i] = int(rng.integers(40))
                left[i], right[i] = build(d + 1, c * share), build(d + 1, c * (1 - share))
            return i

        build(0, 60.0)
        n = len(left)
        return Tree(*(np.array(a) for a in (left, right, feature)), rng.normal(size=n), rng.normal(size=n), np.array(cover), 1 / 200)

    ens = Ensemble("forest", [random_tree(30) for _ in range(200)], 40)
    X = rng.normal(size=(500, 40))
    began = time.perf_counter()
    phi = explain_batch(ens, X)
    assert time.perf_counter() - began < 120
    np.testing.assert_allclose(phi.sum(axis=1) + ens.expected_value(), ens.predict(X), atol=1e-9)


def test_stored_model_is_reused_only_under_its_fingerprint(spark, tmp_path):
    import pytest

    from churnlake.operators import models
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0), (0.0, 2.0), (1.0, -1.0)], "label double, x double")
    fp = models.Fingerprint.of(df, ["x"], {"C": 1})
    fits = []

    def fit():
        fits.append(1)
        return models.logistic(["x"], 4).fit(df)

    path = str(tmp_path / "m")
    first, second = (models.fit_or_load(path, fp, fit) for _ in range(2))
    assert len(fits) == 1 and first.stages[-1].intercept == second.stages[-1].intercept
    other = models.Fingerprint.of(df, ["x"], {"C": 2})
    with pytest.raises(ValueError, match="not trained"):
        models.load_model(path, other)
    models.fit_or_load(path, other, fit)
    assert len(fits) == 2 and models.stored_fingerprint(path) == other.value
