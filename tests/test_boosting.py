"""Boosting against a plain split search, both routes against each other, and what rests on the trees."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.operators import boosting as B
from churnlake.operators import evaluate, explain, models, treeshap
from churnlake.operators.bins import Layout

FEATURES = ["a", "b", "c", "d"]


def table(spark, n=400, seed=0, missing=True):
    rng = np.random.default_rng(seed)
    x = np.stack((rng.normal(size=n), rng.integers(0, 3, n), rng.integers(0, 60, n), rng.normal(size=n).round(1)), axis=1)
    y = (x[:, 0] + (x[:, 1] == 2) - x[:, 3] * (x[:, 2] > 30) + rng.normal(size=n) > 0.4).astype(float)
    if missing:
        x[rng.random((n, 4)) < 0.1] = np.nan
        x[rng.random(n) < 0.3, 3] = np.nan
    rows = [(str(i), *(None if np.isnan(v) else float(v) for v in r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "customerID string, a double, b double, c double, d double, label double")


def plain_tree(x, g, h, s, depth=0):
    """A nested tree (feature, threshold, missing left, left, right) or a leaf value, trying every value of every feature."""
    def score(gs, hs):
        return np.sign(gs) ** 2 * max(abs(gs) - s.alpha, 0) ** 2 / (hs + s.lam)

    best = None
    if depth < s.depth:
        for f in range(x.shape[1]):
            gone = np.isnan(x[:, f])
            values = np.unique(x[~gone, f])
            for t in values:
                for side in (False, True):
                    left = np.where(gone, side, x[:, f] <= t)
                    if side and not gone.any() or min(h[left].sum(), h[~left].sum()) < s.min_hessian or min(left.sum(), (~left).sum()) < s.min_rows:
                        continue
                    gain = score(g[left].sum(), h[left].sum()) + score(g[~left].sum(), h[~left].sum()) - score(g.sum(), h.sum())
                    if best is None or gain > best[0] + 1e-7:
                        best = (gain, f, t, side, left)
    if best is None or best[0] <= 1e-6 or best[0] < s.gamma:
        return -s.rate * np.sign(g.sum()) * max(abs(g.sum()) - s.alpha, 0) / (h.sum() + s.lam)
    _, f, t, side, left = best
    return (f, t, side, plain_tree(x[left], g[left], h[left], s, depth + 1), plain_tree(x[~left], g[~left], h[~left], s, depth + 1))


def plain_value(tree, row):
    while isinstance(tree, tuple):
        f, t, side, left, right = tree
        tree = (left if side else right) if np.isnan(row[f]) else left if row[f] <= t else right
    return tree


def matrix(df):
    pdf = df.orderBy(F.col("customerID").cast("int")).toPandas()
    return pdf[FEATURES].to_numpy(float), pdf["label"].to_numpy(float)


@pytest.mark.parametrize("change", [{}, {"gamma": 2.0}, {"alpha": 3.0}, {"min_hessian": 6.0}, {"lam": 9.0, "depth": 2}, {"min_rows": 25}])
def test_first_trees_equal_a_plain_search(spark, change):
    df = table(spark, 200)
    s = B.Settings(**{"trees": 3, "depth": 3, "rate": 0.3, "subsample": 1.0, "colsample": 1.0, **change})
    model = B.fit(df, FEATURES, s)
    x, y = matrix(df)
    weight, margin = (y == 0).sum() / (y == 1).sum(), np.zeros(len(y))
    for got in model.margins(x):
        p = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, weight, 1.0)
        tree = plain_tree(x, w * (p - y), w * p * (1 - p), s)
        margin = margin + np.array([plain_value(tree, r) for r in x])
        np.testing.assert_allclose(got, margin, atol=1e-6)


@pytest.mark.parametrize("settings", [B.Settings(trees=10, depth=3), B.Settings(trees=9, depth=4, max_leaves=5, min_rows=5, lam=0.0, from_average=True)])
def test_both_routes_grow_the_same_trees(spark, settings):
    df = table(spark, 300).repartition(5)
    here, there = (B.fit(df, FEATURES, settings, local_rows=n) for n in (10_000, 10))
    assert len(here.trees) == len(there.trees) == settings.trees
    for a, b in zip(here.trees, there.trees):
        for name in B.Heap.NAMES:
            at = a.feature >= (0 if name in ("code", "missing_left", "gain") else -1)
            assert (a.feature == b.feature).all() and (getattr(a, name)[at] == getattr(b, name)[at]).all()


def test_leaf_wise_takes_the_best_open_leaf(spark):
    df = table(spark, 400)
    s = B.Settings(trees=1, depth=5, subsample=1.0, colsample=1.0, lam=0.0, min_hessian=1e-3, min_rows=5)
    whole, some = B.fit(df, FEATURES, s).trees[0], B.fit(df, FEATURES, B.replace(s, max_leaves=7)).trees[0]
    assert whole.leaves() > 7 and some.leaves() == 7
    open_, taken = [1], []
    while len(taken) < 6:
        best = max((i for i in open_ if whole.feature[i] >= 0), key=lambda i: (whole.gain[i], -i))
        open_.remove(best)
        taken.append(best)
        open_ += [2 * best, 2 * best + 1]
    assert sorted(taken) == np.flatnonzero(some.feature >= 0).tolist() and (some.value[open_] == whole.value[open_]).all()
    assert B.LEAF_WISE.max_leaves == 31


def test_sampling_depends_on_row_and_tree_only():
    key = np.random.default_rng(0).integers(-1 << 62, 1 << 62, 100_000)
    s = B.Settings()
    first, again, other = B.sampled(key, 3, s), B.sampled(key[::-1].copy(), 3, s)[::-1], B.sampled(key, 4, s)
    assert (first == again).all() and abs(first.mean() - 0.8) < 0.01 and abs((first & other).mean() - 0.64) < 0.01
    assert len(B.sampled_columns(10, 0, s)) == 8


def test_curve_ends_at_the_whole_model(spark, tmp_path):
    df = table(spark, 300)
    model = B.fit(df, FEATURES, B.Settings(trees=12, depth=3))
    curve = B.evaluation_curve(model, df).orderBy("iteration").collect()
    assert [r.iteration for r in curve] == list(range(1, 13))
    assert curve[0].log_loss > curve[-1].log_loss
    scored = model.probability(df, ["customerID", "label"]).select(F.col("label").cast("int").alias("y"), "p")
    assert curve[-1].roc_auc == evaluate.roc_auc(scored).first()[0]
    x, y = matrix(df)
    p = 1 / (1 + np.exp(-model.margin(x)))
    np.testing.assert_allclose(curve[-1].log_loss, -np.mean(np.where(y == 1, np.log(p), np.log(1 - p))), atol=1e-9)
    model.save(spark, str(tmp_path / "m"))
    again = B.BoostedTrees.load(spark, str(tmp_path / "m"))
    assert (again.margin(x) == model.margin(x)).all() and again.about() == model.about()
    assert abs(sum(model.importances()) - 1) < 1e-9


@pytest.mark.parametrize("local_rows", [10_000, 10])
def test_search_over_a_small_grid(spark, local_rows):
    """The real search: candidates that share an ensemble score as the prefixes that fits of their own give."""
    df = table(spark, 160).withColumn("Churn", F.when(F.col("label") == 1, "Yes").otherwise("No"))
    grid = {"trees": [2, 5], "depth": [2], "rate": [0.1, 0.3], "subsample": [0.8], "colsample": [1.0], "gamma": [0.0], "alpha": [0.0, 0.1]}
    model, found = models.tune_boosting(df, FEATURES, 6, grid, local_rows)
    rows = {r.params: r.mean_auc for r in found.collect()}
    assert len(rows) == 6 and all(0.5 < a <= 1 for a in rows.values())
    best = max(rows, key=rows.get)
    assert rows[json.dumps({k: getattr(model.settings, k) for k in sorted(grid)}, sort_keys=True)] == rows[best]
    from churnlake.operators.sample import cv_folds
    folded = cv_folds(df, 5)
    params, layout = json.loads(best), B.Layout.fit(df, FEATURES)
    areas = []
    for k in range(5):
        rows_ = B.binned(folded.where(F.col("fold") != k), layout, "label", "customerID")
        fit = B.train(rows_, layout, [B.Fit(B.Settings(**params))], B.class_ratio(df, "label"))[0][0]
        scored = fit.probability(folded.where(F.col("fold") == k), ["label"]).select(F.col("label").cast("int").alias("y"), "p")
        areas.append(evaluate.roc_auc(scored).first()[0])
    assert abs(np.mean(areas) - rows[best]) < 0.02


def test_shap_and_responses_of_boosted_trees(spark, tmp_path):
    df = table(spark, 120)
    model = B.fit(df, FEATURES, B.Settings(trees=6, depth=4))
    ens = treeshap.Ensemble.of_boosting(model)
    x, _ = matrix(df)
    np.testing.assert_allclose(ens.predict(x), model.margin(x), atol=1e-12)
    phi = treeshap.explain_batch(ens, x)
    np.testing.assert_allclose(phi.sum(axis=1) + ens.expected_value(), model.margin(x), atol=1e-9)
    grid = np.array(sorted({-1.5, 0.0, 2.0, *x[~np.isnan(x[:, 2]), 2][:5], *model.layout.cuts[2][:3]}))
    for f in range(4):
        got = treeshap.responses(ens, x, f, grid)
        for j, v in enumerate(grid):
            moved = x.copy()
            moved[:, f] = v
            np.testing.assert_allclose(got[:, j], model.margin(moved), atol=1e-9)
    scorer = explain.TreeScorer(ens, FEATURES)
    by_steps = explain.partial_dependence(df, scorer, ["c"], 10).orderBy("grid_index").collect()
    by_scores = explain.partial_dependence(df, lambda rows: model.probability(rows, ["customerID", "g"]), ["c"], 10).orderBy("grid_index").collect()
    assert [r.grid_value for r in by_steps] == [r.grid_value for r in by_scores]
    np.testing.assert_allclose([r.partial_dependence for r in by_steps], [r.partial_dependence for r in by_scores], atol=1e-6)


def test_one_class_and_no_rows(spark):
    df = table(spark, 30).withColumn("label", F.lit(0.0))
    model = B.fit(df, FEATURES, B.Settings(trees=2))
    assert model.probability(df).agg(F.max("p")).first()[0] < 0.5
    only_positive = B.fit(df.withColumn("label", F.lit(1.0)), FEATURES, B.Settings(trees=2))
    assert only_positive.probability(df).agg(F.max("p")).first()[0] == 0.5  # weight 0 / 30: nothing to learn
    assert B.fit(df.limit(0), FEATURES, B.Settings(trees=2)).probability(df).agg(F.max("p")).first()[0] == 0.5


def test_a_level_is_one_job_over_kept_rows(spark):
    df, sc = table(spark, 200), spark.sparkContext
    s = B.Settings(trees=10, depth=3)
    sc.setJobGroup("levels", "levels")
    there = B.fit(df, FEATURES, s, local_rows=10)
    jobs = len(sc.statusTracker().getJobIdsForGroup("levels"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= s.trees * s.depth + 15  # besides: cuts, binned rows, counts, one refresh of the margins
    here = B.fit(df, FEATURES, s)
    assert all((a.value == b.value).all() and (a.feature == b.feature).all() for a, b in zip(here.trees, there.trees))


def test_a_level_of_a_small_table_is_one_stage(spark):
    df, sc = table(spark, 240).cache(), spark.sparkContext

    def stages(trees):
        sc.setJobGroup(f"stages-{trees}", "stages")
        B.fit(df, FEATURES, B.Settings(trees=trees, depth=3, min_hessian=0.1), local_rows=10)
        jobs = sc.statusTracker().getJobIdsForGroup(f"stages-{trees}")
        sc.setLocalProperty("spark.jobGroup.id", None)
        return sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs)

    assert stages(15) - stages(3) <= 12 * 3 + 12 // B.REFRESH + 2


@pytest.mark.parametrize("settings", [B.Settings(trees=3, depth=4, min_hessian=0.1),
                                      B.Settings(trees=3, depth=4, min_rows=7, max_leaves=9, lam=0.0, from_average=True, min_hessian=0.0)])
def test_sums_of_the_driver_and_of_spark_grow_the_same_trees(spark, monkeypatch, settings):
    df, found = table(spark, 300, seed=4).repartition(3).cache(), []
    rows = B.Layout.fit(df, FEATURES).width * 24
    for held, parts in ((0, 12_000), (1 << 30, 12_000), (1 << 30, 100), (2 * rows * 3, 100)):  # the last: the upper levels by the driver only
        monkeypatch.setattr(B, "DRIVER_BYTES", held)
        monkeypatch.setattr(B, "LEAST_ROWS", parts)
        found.append(B.fit(df, FEATURES, settings, local_rows=10).trees)
    found.append(B.fit(df, FEATURES, settings).trees)
    for trees in found[1:]:
        for a, b in zip(found[0], trees, strict=True):
            assert all((getattr(a, n) == getattr(b, n)).all() for n in B.Heap.NAMES)


@pytest.mark.parametrize("with_rows", [True, False])
def test_features_of_few_bins_are_counted_together(with_rows):
    rng = np.random.default_rng(3)
    layout = Layout([f"f{j}" for j in range(24)], [np.arange(n, dtype=float) for n in (1, 254, 0, 2, 1, 13, 40, *[1] * 17)])
    assert len(layout.bundles) <= 8 and sorted(j for b in layout.bundles for j in b) == list(range(24))
    codes = np.stack([rng.integers(0, m + 1, 500) for m in layout.missing], axis=1).astype(np.uint8)
    node, sums = rng.integers(0, 3, 500), rng.integers(-1 << 30, 1 << 30, (500, 2)).astype(float)
    want = np.zeros((4, layout.width, 3), np.int64)
    for i, row in enumerate(codes):
        for j, code in enumerate(row):
            want[node[i], layout.offsets[j] + code] += [int(sums[i, 0]), int(sums[i, 1]), 1]
    got = B.histogram(layout.packed(codes), node, 4, sums, layout, with_rows)
    assert (got == want[:, :, : 3 if with_rows else 2]).all()


def test_rows_walk_down_a_tree_as_each_split_says():
    rng = np.random.default_rng(5)
    missing, tree = np.array([255, 3, 9]), B.Heap(3)
    tree.feature[[1, 2, 3, 5, 6]], tree.feature[[4, 10, 11, 12, 13, 7]] = [0, 1, 2, 0, 1], -1
    tree.code[[1, 2, 3, 5, 6]], tree.missing_left[[1, 5, 6]] = [120, 1, 4, 30, 2], True
    codes = np.stack([rng.integers(0, m + 1, 300) for m in missing], axis=1).astype(np.uint8)
    codes[:20, 0] = 255
    for levels in (0, 1, 2, 3, None):
        for row, end in zip(codes, tree.descend(codes, missing, levels)):
            at = 1
            for _ in range(3 if levels is None else levels):
                f = tree.feature[at]
                if f >= 0:
                    left = tree.missing_left[at] if row[f] == missing[f] else row[f] <= tree.code[at]
                    at = 2 * at + (0 if left else 1)
            assert at == end


def test_margins_are_brought_up_to_date_by_the_pass_that_reads_them(spark):
    """A tree more is a job more for each of its levels, nothing else."""
    df, sc = table(spark, 300), spark.sparkContext
    jobs = {}
    for trees in (8, 16):
        sc.setJobGroup(f"trees-{trees}", "levels of trees")
        B.fit(df, FEATURES, B.Settings(trees=trees, depth=2, min_hessian=0.1), local_rows=10)
        jobs[trees] = len(sc.statusTracker().getJobIdsForGroup(f"trees-{trees}"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert 16 < jobs[8] and jobs[16] - jobs[8] <= 8 * 2


def test_fits_of_a_table_that_a_task_can_hold_need_no_pass_per_level(spark):
    """72,000 rows (six times sf0.1) are grown in a task per fit: more trees are no further jobs."""
    df, sc = spark.range(72_000).selectExpr("cast(id as string) customerID", "double(id % 7) a", "double(id % 97) b",
                                            "double((id * id) % 5 < 2) label", "int(id % 3) fold"), spark.sparkContext
    layout, jobs = Layout.fit(df, ["a", "b"]), {}
    rows = B.materialize(B.binned(df, layout, "label", "customerID", "fold"), "binned")
    for trees in (2, 6):
        fits = [B.Fit(B.Settings(trees=trees, depth=2), k, (trees,)) for k in range(3)]
        sc.setJobGroup(f"held-{trees}", "fits in tasks")
        _, scored = B.train(rows, layout, fits, 1.5, with_trees=False)
        jobs[trees] = len(sc.statusTracker().getJobIdsForGroup(f"held-{trees}"))
        sc.setLocalProperty("spark.jobGroup.id", None)
        assert scored.count() == scored.select("id").distinct().count() == 72_000
    assert 0 < jobs[6] == jobs[2]


def test_every_group_has_all_rows_in_a_task_of_its_own(spark):
    from churnlake.operators.bins import dealt
    df = table(spark, 90).repartition(4).withColumn("fold", F.col("customerID").cast("int") % 3)
    rows = B.binned(df, Layout.fit(df, FEATURES), "label", "customerID", "fold")

    def run(number, ids, key, y, fold, codes):
        import pyarrow as pa
        from pyspark import TaskContext
        n = len(ids)
        yield pa.RecordBatch.from_arrays([pa.array([number] * n), pa.array([TaskContext.get().partitionId()] * n), ids, pa.array(key), pa.array(y), pa.array(fold),
                                          pa.array([c.tobytes() for c in codes], pa.binary())], names=["number", "task", "id", "key", "y", "fold", "codes"])

    found = dealt(rows, 7, True, run, "number long, task long, id string, key long, y int, fold int, codes binary").collect()
    want = {(r.id, r.key, r.y, r.fold, bytes(r.codes)) for r in rows.collect()}
    for number in range(7):
        own = [r for r in found if r.number == number]
        assert len(own) == 90 and {(r.id, r.key, r.y, r.fold, bytes(r.codes)) for r in own} == want and {r.task for r in own} == {number}
