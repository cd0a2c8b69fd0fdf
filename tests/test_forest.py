"""Forests against a plain tree, both routes against each other, and the limits on splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import forest as R
from churnlake.operators import models, treeshap
from churnlake.operators.bins import Layout
from tests.test_boosting import FEATURES, matrix, table


def plain_tree(codes, one, weight, count, name, s, tree, depth=0):
    """(value, None) or (value, feature, code, left, right) by trying every cut of the features drawn, in plain loops."""
    value = one.sum() / weight.sum()
    if count.sum() < s.min_split or one.sum() in (0, weight.sum()) or s.max_depth is not None and depth >= s.max_depth:
        return (value,)
    order = R.feature_order(np.array([name], np.uint64), tree, codes.shape[1], s.seed)[0]
    k, best = s.drawn(codes.shape[1]), None

    def cuts(f):
        for c in range(256):
            left = codes[:, f] <= c
            if min(left.sum(), (~left).sum()) >= s.min_leaf:
                gain = sum(one[p].sum() ** 2 / weight[p].sum() for p in (left, ~left)) - one.sum() ** 2 / weight.sum()
                yield 2 * gain, c

    for f in order[:k]:
        for gain, c in cuts(f):
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, c)
    for f in order[k:]:
        if best is None:
            best = max(((gain, f, c) for gain, c in cuts(f)), key=lambda b: (round(b[0], 9), -b[2]), default=None)
    if best is None:
        return (value,)
    _, f, c = best
    left = codes[:, f] <= c
    names = [n[0] for n in R.child_names(np.array([name], np.uint64))]
    return (value, f, c, *(plain_tree(codes[p], one[p], weight[p], count[p], n, s, tree, depth + 1) for p, n in zip((left, ~left), names)))


def plain_value(node, row):
    while len(node) > 1:
        node = node[3] if row[node[1]] <= node[2] else node[4]
    return node[0]


@pytest.mark.parametrize("change", [{}, {"min_split": 12}, {"min_leaf": 5}, {"max_depth": 3}, {"features": "log2", "balanced": True}])
def test_trees_equal_plain_ones(spark, change):
    df = table(spark, 150, missing=False)
    s = R.Settings(trees=3, **change)
    model = R.fit(df, FEATURES, s)
    x, y = matrix(df)
    codes = model.layout.codes(x)
    key = np.array([r.k for r in df.orderBy(F.col("customerID").cast("int")).select(F.xxhash64("customerID").alias("k")).collect()])
    n1 = y.sum()
    per_class = (len(y) / (2 * (len(y) - n1)), len(y) / (2 * n1)) if s.balanced else (1.0, 1.0)
    for t, got in enumerate(model.trees):
        drawn = R.drawn_weights(key, t, s.seed)
        use = drawn > 0
        weight = drawn[use] * np.where(y[use] == 1, per_class[1], per_class[0])
        want = plain_tree(codes[use], weight * (y[use] == 1), weight, np.ones(use.sum()), int(R.ROOT), s, t)
        np.testing.assert_allclose(got.value[got.descend(codes)], [plain_value(want, r) for r in codes], atol=1e-5)


def test_leaves_are_pure_and_depth_has_no_limit(spark):
    n = 400  # the label alternates along the one feature: a tree must go on to single values
    df = spark.createDataFrame([(str(i), float(i), float(i % 2)) for i in range(200)] + [(f"x{i}", float(i % 200), float(i % 2)) for i in range(n - 200)],
                               "customerID string, v double, label double")
    model = R.fit(df, ["v"], R.Settings(trees=5))
    for t in model.trees:
        leaves = t.left < 0
        assert set(np.round(t.value[leaves], 9)) <= {0.0, 1.0}
    deep = R.grow(np.arange(250, dtype=np.uint8)[:, None], np.stack((np.arange(250) % 2 * 2.0 ** 20, np.full(250, 2.0 ** 20)), axis=1), 0, R.Settings())
    assert deep.depth() > 30 and (deep.left < 0).sum() == 250
    limited = R.fit(df, ["v"], R.Settings(trees=5, min_split=50))
    assert all((t.left >= 0).sum() < (u.left >= 0).sum() for t, u in zip(limited.trees, model.trees))


@pytest.mark.parametrize("local_rows", [60, 7])
def test_both_routes_grow_the_same_trees(spark, local_rows):
    df = table(spark, 200).repartition(3)
    s = R.Settings(trees=4, min_leaf=2)
    x, _ = matrix(df)
    here, there = (R.fit(df, FEATURES, s, local_rows=n) for n in (10_000, local_rows))
    codes = here.layout.codes(x)
    for a, b in zip(here.trees, there.trees):
        assert (a.left >= 0).sum() == (b.left >= 0).sum()
        assert (a.value[a.descend(codes)] == b.value[b.descend(codes)]).all()


def test_search_scores_stored_model_and_shap(spark, tmp_path):
    df = table(spark, 200).withColumn("Churn", F.when(F.col("label") == 1, "Yes").otherwise("No"))
    grid = {"trees": [4, 8], "max_depth": [None, 3], "min_split": [2], "min_leaf": [1, 3], "features": ["sqrt"], "balanced": [True, False]}
    (_, found), (model, slow) = (models.tune_forest(df, FEATURES, 4, grid, n) for n in (10_000, 60))
    a, b = ({r.params: r.mean_auc for r in t.collect()} for t in (found, slow))
    assert len(a) == 4 and a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-6 and 0.6 < a[k] <= 1 for k in a)
    x, _ = matrix(df)
    ens = treeshap.ensemble_of(model)
    p = model.predict(model.layout.codes(x))
    np.testing.assert_allclose(ens.predict(x), p, atol=1e-12)
    phi = treeshap.explain_batch(ens, x)
    np.testing.assert_allclose(phi.sum(axis=1) + ens.expected_value(), p, atol=1e-9)
    model.save(spark, str(tmp_path / "m"))
    again = R.RandomForest.load(spark, str(tmp_path / "m"))
    assert (again.predict(again.layout.codes(x)) == p).all()
    scored = {r.customerID: r.p for r in model.probability(df, ["customerID"]).collect()}
    np.testing.assert_allclose([scored[str(i)] for i in range(len(p))], p, atol=1e-12)
    assert abs(sum(model.importances()) - 1) < 1e-9


def test_one_class_and_no_rows(spark):
    df = table(spark, 30).withColumn("label", F.lit(1.0))
    assert R.fit(df, FEATURES, R.Settings(trees=2)).probability(df).agg(F.min("p")).first()[0] == 1.0
    empty = R.fit(df.limit(0), FEATURES, R.Settings(trees=2))
    assert empty.probability(df).count() == 30
    assert Layout.fit(df.limit(0), FEATURES).width == 2 * len(FEATURES)


@pytest.mark.parametrize("seed", range(6))
def test_cuts_of_few_rows_equal_those_of_histograms(seed):
    rng = np.random.default_rng(seed)
    codes, node = rng.integers(0, 9, (60, 7)).astype(np.uint8), np.sort(rng.integers(0, 12, 60))
    chosen = np.stack([rng.permutation(7)[:3] for _ in range(12)])
    w = rng.integers(1, 4, 60) * R.UNIT
    sums = np.stack((w * rng.integers(0, 2, 60), w), axis=1).astype(float)
    for s in (R.Settings(), R.Settings(min_leaf=3)):
        for in_turn in (False, True):
            a = R.best_cuts(R.histogram(codes, node, chosen, sums), s, in_turn)
            b = R.best_cuts_of_rows(codes, node, chosen, sums, s, in_turn)
            fine = np.isfinite(a[0])
            assert (a[0] == b[0]).all() and (a[1][fine] == b[1][fine]).all() and (a[2][fine] == b[2][fine]).all()


@pytest.mark.parametrize("local_rows", [10_000, 60])
def test_stored_forest_equals_the_held_one(spark, tmp_path, local_rows):
    """The driver gets the tops alone; scores, importances and facts are those of the whole trees."""
    df = table(spark, 200).repartition(3)
    s = R.Settings(trees=4)
    held, stored = (R.fit(df, FEATURES, s, local_rows=local_rows, held_draws=n) for n in (10_000, 0))
    assert isinstance(stored, R.StoredForest) and not isinstance(held, R.StoredForest)
    assert sum(len(t.left) for t in stored.tops) < sum(len(t.left) for t in held.trees) / 4
    stored.save(spark, str(tmp_path / "m"))
    again = R.RandomForest.load(spark, str(tmp_path / "m"))
    rows = df.unionByName(df.limit(5))  # an id may repeat
    want, *got = (sorted(map(tuple, m.probability(rows, ["customerID", "label"]).collect())) for m in (held, stored, again))
    assert len(want) == 205 and all(g == want for g in got)
    np.testing.assert_allclose(stored.importances(), held.importances(), atol=1e-12)
    for a, b in zip(stored.facts(), held.facts()):
        np.testing.assert_allclose((a.root, a.leaves, a.splits, *a.gains), (b.root, b.leaves, b.splits, *b.gains), atol=1e-9)
        assert abs(a.gains.sum() - (a.root - a.leaves)) < 1e-6 * a.root
    few, some = (sorted(map(tuple, R.prefix(m, 2).probability(df, ["customerID"]).collect())) for m in (held, stored))
    assert few == some


def test_search_scores_the_fits_of_a_larger_table_together(spark):
    """The scores are those of the fits one by one, the passes are shared by all fits."""
    df, sc = table(spark, 300).repartition(3).withColumn("fold", F.col("customerID").cast("int") % 3), spark.sparkContext
    layout = Layout.fit(df, FEATURES)
    rows = R.materialize(R.binned(df, layout, "label", "customerID", "fold"), "binned")
    fits = [R.Fit(s, k) for s in (R.Settings(trees=4, max_depth=3), R.Settings(trees=4, balanced=True)) for k in range(3)]
    jobs, found = {}, None
    for some in (fits[:2], fits):
        sc.setJobGroup(f"fits-{len(some)}", "scores of fits")
        found = R.held_out_scores(rows, layout, some, [(2, 4)] * len(some), 2, 60).collect()
        jobs[len(some)] = len(sc.statusTracker().getJobIdsForGroup(f"fits-{len(some)}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[6] < 2 * jobs[2]
    want = set()
    for k, f in enumerate(fits):
        model = R.train(rows, layout, [f], 10_000)[0]
        for n in (2, 4):
            part = R.prefix(model, n).probability_of_codes(rows.filter(F.col("fold") == f.held), ["id", "y"])
            want |= {(k, n, r.id, r.y, r.p) for r in part.collect()}
    assert len(found) == len(want) == 2 * 2 * 300 and set(map(tuple, found)) == want


def test_search_over_a_table_that_a_task_can_hold_needs_no_pass_per_level(spark):
    """72,000 rows (six times sf0.1) are scored by a task per group of trees: deeper trees are no further jobs."""
    df, sc = spark.range(72_000).selectExpr("cast(id as string) customerID", "double(id % 7) a", "double(id % 97) b",
                                            "double((id * id) % 5 < 2) label", "int(id % 3) fold"), spark.sparkContext
    layout, jobs = Layout.fit(df, ["a", "b"]), {}
    rows = R.materialize(R.binned(df, layout, "label", "customerID", "fold"), "binned")
    for depth in (1, 4):
        sc.setJobGroup(f"deep-{depth}", "groups of trees")
        found = R.held_out_scores(rows, layout, [R.Fit(R.Settings(trees=2, max_depth=depth), k) for k in range(3)], [(1, 2)] * 3, 1)
        jobs[depth] = len(sc.statusTracker().getJobIdsForGroup(f"deep-{depth}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert found.count() == 2 * 72_000
    assert 0 < jobs[4] == jobs[1]


def test_first_features_drawn_and_those_of_two_codes():
    names = np.random.default_rng(1).integers(1, 1 << 62, 50).astype(np.uint64)
    whole = R.feature_order(names, 3, 20, 42)
    for k in (1, 6, 19, 20):
        assert (R.feature_order(names, 3, 20, 42, k) == whole[:, :k]).all()
    codes, node = np.random.default_rng(2).integers(0, 2, (60, 9)).astype(np.uint8), np.repeat(np.arange(20), 3)
    order = np.stack([np.random.default_rng(i).permutation(9) for i in range(20)])
    got, n = R._not_constant(codes, node, order)
    for i in range(20):
        two = [f for f in order[i] if len(set(codes[node == i, f])) > 1]
        assert got[i, : n[i]].tolist() == two and sorted(got[i]) == list(range(9))


def test_tops_of_all_trees_are_grown_by_the_same_passes(spark, monkeypatch):
    """Rows are sent in batches of few trees, but a pass splits the open nodes of all of them; some may wait for the next pass."""
    df, sc = table(spark, 240).repartition(3).cache(), spark.sparkContext
    s, x = R.Settings(trees=6, min_leaf=2), matrix(df)[0]
    monkeypatch.setattr(R, "JOB_ROWS", 480)  # two trees at a time
    jobs, models_ = {}, {}
    for room in (2048, 5):
        monkeypatch.setattr(R, "NODES_A_PASS", room)
        sc.setJobGroup(f"tops-{room}", "tops")
        models_[room] = R.fit(df, FEATURES, s, local_rows=60)
        jobs[room] = len(sc.statusTracker().getJobIdsForGroup(f"tops-{room}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
    here = R.fit(df, FEATURES, s)
    deepest = max(t.depth() for t in here.trees)
    assert jobs[2048] <= 3 * (2 * deepest + 4) < 3 * jobs[5] and jobs[2048] < jobs[5]
    codes = here.layout.codes(x)
    for model in models_.values():
        for a, b in zip(here.trees, model.trees, strict=True):
            assert (a.left >= 0).sum() == (b.left >= 0).sum()
            assert (a.value[a.descend(codes)] == b.value[b.descend(codes)]).all()
