"""Property tests: split, ranks, partition invariance, model reload, SHAP additivity, plan shape."""

import pytest
from pyspark.sql import functions as F

from churnlake.operators import evaluate, explain, sample
from churnlake.operators.rank import Key, ranged, running_totals
from churnlake.plans import queries as Q
from tests.conftest import SF001, SF01


def test_split_disjoint_complete_and_stratified(spark):
    df = Q._subs(spark, SF01)
    s = sample.stratified_split(df).cache()
    assert s.count() == df.count()
    assert s.select("customerID").distinct().count() == df.count()
    rates = {r["split"]: r["churn_rate"] for r in sample.split_report(s).collect()}
    assert abs(rates["train"] - rates["test"]) < 0.01
    n_test = s.where("split = 'test'").count()
    assert abs(n_test - 0.2 * df.count()) <= 2


def test_hash_split_needs_no_shuffle(spark):
    df = Q._subs(spark, SF001)
    plan = sample.stratified_split(df, exact=False).select("customerID", "split")._jdf.queryExecution() \
        .executedPlan().toString()
    # only the adapter's own aggregation/join exchanges, none added by the split
    base = df.select("customerID")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == base.count("Exchange")


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_running_totals_partition_invariant(spark, parts):
    df = spark.range(0, 5000).select(F.col("id"), (F.col("id") % 7).cast("double").alias("p"),
                                     (F.col("id") % 3 == 0).cast("int").alias("y")).repartition(parts)
    rt = running_totals(df, [Key("p", False), Key("id")], ["y"], buckets=8)
    got = {r["id"]: (r["pos"], r["cum_y"]) for r in rt.collect()}
    ordered = sorted(df.collect(), key=lambda r: (-r["p"], r["id"]))
    cum = 0
    for i, r in enumerate(ordered, 1):
        cum += r["y"]
        assert got[r["id"]] == (i, cum)


def test_hot_value_is_split_across_ranges(spark):
    # a third of the rows share one score: the ranges are cut inside it, by id
    df = spark.range(0, 9000).select("id", F.when(F.col("id") % 3 == 0, F.lit(0.5))
                                     .otherwise(F.rand(3)).alias("p"), F.lit(1).alias("y"))
    stored = ranged(df, [Key("p", False), Key("id")], 8)
    sizes = [r["count"] for r in stored.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 9000 / 8
    assert stored.where("p = 0.5").select("_range").distinct().count() >= 3
    assert running_totals(df, [Key("p", False), Key("id")], ["y"], buckets=8).agg(F.max("pos")).first()[0] == 9000


def _labelled(spark, n):
    label = F.when(F.col("id") % 10 < 4, "Yes").when(F.col("id") % 10 < 9, "No")
    return spark.range(n).select(F.col("id").cast("string").alias("customerID"), label.alias("Churn"))


@pytest.mark.parametrize("n", [1500, 20000])
def test_null_labels_split_and_fold_alike_at_every_size(spark, n):
    df = _labelled(spark, n)
    got = {(r["Churn"], r["split"]): r["count"] for r in
           sample.stratified_split(df).groupBy("Churn", "split").count().collect()}
    assert [got[c, "test"] for c in ("Yes", "No", None)] == [n * 8 // 100, n // 10, n // 50]
    folds = {(r["Churn"], r["fold"]): r["count"] for r in sample.cv_folds(df).groupBy("Churn", "fold").count().collect()}
    assert folds == {(c, k): share * n // 50 for c, share in (("Yes", 4), ("No", 5), (None, 1)) for k in range(5)}


def test_split_equals_ranking(spark):
    rows = [(r["customerID"], r["Churn"], r["h"]) for r in
            _labelled(spark, 3000).withColumn("h", sample.key_hash()).collect()]
    first = {i for c in ("Yes", "No", None)
             for i, _, _ in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))[
                 : int(sum(r[1] == c for r in rows) * 0.2 + 0.5)]}
    split = sample.stratified_split(_labelled(spark, 3000))
    assert {r["customerID"] for r in split.where("split = 'test'").collect()} == first


def test_null_keys_take_part_in_running_totals(spark):
    df = spark.createDataFrame([(None, 1, 5), (2.0, 2, 7), (None, 3, 1), (1.0, 4, 2)], "k double, id int, y int")
    rt = running_totals(df, [Key("k"), Key("id")], ["y"], buckets=3)
    assert [(r["id"], r["pos"], r["cum_y"]) for r in rt.orderBy("pos").collect()] == [(1, 1, 5), (3, 2, 6), (4, 3, 8), (2, 4, 15)]


def test_gains_have_all_deciles_and_skip_incomplete_rows(spark):
    rows = [(i, i % 2, p) for i, p in enumerate([0.9, 0.8, 0.3, 0.2, 0.1])] + [(9, 1, None), (10, None, 0.5), (11, 1, float("nan"))]
    df = spark.createDataFrame(rows, "id int, y int, p double")
    gains = evaluate.gains_table(df).orderBy("decile").collect()
    assert [r["decile"] for r in gains] == list(range(10)) and sum(r["customers"] for r in gains) == 5
    assert gains[-1]["pct_churners_captured"] == 1.0
    cm = evaluate.confusion_matrix(df).first()
    assert cm["tn"] + cm["fp"] + cm["fn"] + cm["tp"] == 5
    assert evaluate.score_table(df).agg(F.sum("pos") + F.sum("neg")).first()[0] == 5


def test_master_without_shared_folder_raises():
    from types import SimpleNamespace

    from churnlake.session import ensure_checkpoint_dir
    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: SimpleNamespace(get=lambda *a: None),
                              _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(ValueError, match="share"):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *a: None)))


def test_auc_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.linalg import Vectors, VectorUDT  # noqa: F401
    s = Q._scored(spark, SF01)
    ours = evaluate.roc_auc(s).first()["roc_auc"]
    raw = s.select(F.col("y").cast("double").alias("label"),
                   F.array(1 - F.col("p"), F.col("p")).alias("a"))
    from pyspark.ml.functions import array_to_vector
    raw = raw.select("label", array_to_vector("a").alias("rawPrediction"))
    ml = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(raw)
    assert ours == pytest.approx(ml, abs=1e-6)


def test_gains_end_at_one(spark):
    g = evaluate.gains_table(Q._scored(spark, SF001)).orderBy("decile").collect()
    assert len(g) == 10 and g[-1]["pct_churners_captured"] == 1.0
    assert sum(r["customers"] for r in g) == Q._scored(spark, SF001).count()


def test_onehot_rows_sum_at_most_one(spark):
    df = Q.q_onehot_encode(spark, SF001)
    for prefix in ("Contract_", "PaymentMethod_", "InternetService_"):
        cols = [c for c in df.columns if c.startswith(prefix)]
        total = sum((F.col(f"`{c}`") for c in cols[1:]), F.col(f"`{cols[0]}`"))
        assert df.agg(F.max(total)).first()[0] <= 1


def test_linear_shap_adds_up(spark):
    df = Q._structured(spark, SF001)
    s = explain.shap_linear(df, Q.SCORER)
    base = explain.base_value(df, Q.SCORER)
    per = s.groupBy("customerID").agg(F.sum("shap").alias("s"))
    margin = df.select("customerID", Q.SCORER.margin().alias("m"))
    worst = per.join(margin, "customerID").agg(F.max(F.abs(F.col("s") + base - F.col("m")))).first()[0]
    assert worst < 1e-9


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["gains_table", "roc_auc", "pr_auc", "roc_curve", "stratified_split",
                                  "feature_pipeline", "segment_report", "dedup_customers", "cv_folds"])
def test_no_python_and_no_single_partition_window(spark, name):
    plan = _plan(Q.QUERIES[name](spark, SF001))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    for line in plan.splitlines():
        if "Window [" in line:
            # Window [exprs], [partition spec], [order spec]: the partition spec must not be empty
            assert "], [], [" not in line, line


def test_registered_search_draws_every_candidate(spark, monkeypatch):
    from churnlake.operators import models
    fitted = []

    class Search:
        avgMetrics, bestModel = [], None

        def __init__(self, estimatorParamMaps, **settings):
            self.avgMetrics = [0.5] * len(estimatorParamMaps)
            fitted.extend(estimatorParamMaps)

        def fit(self, data):
            return self

    monkeypatch.setattr(models, "CrossValidator", Search)
    table = Q.QUERIES["tune_models"](spark, SF001)
    assert {r.model for r in table.collect()} == {"logistic"} and table.count() == len(fitted) == 12


@pytest.mark.parametrize("name", ["tune_forest", "tune_boosting"])
def test_whole_tree_searches(spark, name):
    """The registered searches, fits and all."""
    rows = Q.QUERIES[name](spark, SF001).collect()
    assert len({r.params for r in rows}) == 15 and all(0.2 < r.mean_auc < 1 for r in rows)


def test_feature_filters_reach_the_prepared_scan(spark):
    df = Q.q_filter_customers(spark, SF001)
    plan = spark.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    text = " ".join(line for line in plan.splitlines() if "PushedFilters" in line)
    assert "GreaterThanOrEqual(sentiment_score,-1.0)" in text and "In(network_quality, [1,2])" in text
    # the text features are read from the written feature table, never recomputed in the filter
    assert "regexp_replace" not in plan


@pytest.mark.parametrize("sizes", [{"a": 7, "b": 8}, {"a": 3, "b": 11, None: 2}, {"a": 1, "b": 1, "c": 1}, {"a": 13, "b": 14, None: 12}])
def test_apportioned_test_rows(spark, sizes):
    n = sum(sizes.values())
    share = sample.apportion(sizes, 0.2)
    assert sum(share.values()) == -(-n // 5) and all(abs(share[y] - sizes[y] * sum(share.values()) / n) < 1 for y in sizes)
    label = {"a": "Yes", "b": "No", None: None}
    if "c" not in sizes:
        rows = [(f"{y}{i}", label[y]) for y, k in sizes.items() for i in range(k)]
        split = sample.stratified_split(spark.createDataFrame(rows, "customerID string, Churn string"))
        got = {r["Churn"]: r["n"] for r in split.where("split = 'test'").groupBy("Churn").agg(F.count("*").alias("n")).collect()}
        by_bit = sample.apportion({1: sizes["a"], 0: sizes["b"], **({None: sizes[None]} if None in sizes else {})}, 0.2)
        assert got == {label[{1: "a", 0: "b", None: None}[y]]: k for y, k in by_bit.items() if k}


def test_a_hot_id_at_the_cut_is_counted(spark):
    rows = [("hot", "Yes")] * 300 + [(str(i), "Yes") for i in range(100)]
    split = sample.stratified_split(spark.createDataFrame(rows, "customerID string, Churn string"))
    got = split.groupBy("customerID").agg(F.count_distinct("split").alias("n")).agg(F.max("n")).first()[0]
    assert got == 1  # rows that repeat an id go the same way


@pytest.mark.parametrize("seed", range(3))
def test_roc_curve_leaves_out_straight_points_only(spark, seed):
    import random
    rng = random.Random(seed)
    rows = [(f"m{m}", i, int(rng.random() < 0.5), round(rng.random(), 2 if m else 1)) for m in range(2) for i in range(200)]
    df = spark.createDataFrame(rows, "model string, id int, y int, p double")
    whole, some = (evaluate.roc_curve(df, "model", drop_collinear=d) for d in (False, True))
    for m in ("m0", "m1"):
        a, b = ([(r.fpr, r.tpr) for r in c.where(F.col("model") == m).orderBy(F.desc("threshold")).collect()] for c in (whole, some))
        fps, tps = zip(*a[1:])
        keep = [a[0]] + [a[i + 1] for i in range(len(fps)) if i in (0, len(fps) - 1)
                         or abs(fps[i + 1] - 2 * fps[i] + fps[i - 1]) > 3e-6 or abs(tps[i + 1] - 2 * tps[i] + tps[i - 1]) > 3e-6]
        assert b == keep and (m == "m0" or len(b) < len(a))
        area = lambda c: sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(c, c[1:]))
        assert abs(area(a) - area(b)) < 1e-4
