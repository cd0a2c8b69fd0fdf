"""Model training, tuning, scoring, importance and persistence.

Logistic regression is an MLlib pipeline (VectorAssembler -> estimator); forests
and boosting are this library's (``forest``, ``boosting``). All train on the
executors; only model parameters reach the driver. Hyper-parameters mirror
the reference's fixed settings and search grids.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import schema as S
from churnlake.operators import boosting, forest
from churnlake.operators.bins import Layout, binned
from churnlake.session import ensure_checkpoint_dir, materialize

LABEL = "label"
WEIGHT = "class_weight"

# FIXED VALUES: search spaces of the reference (M6)
LR_GRID = {"C": [0.001, 0.01, 0.1, 1, 10, 100], "penalty": ["l1", "l2"], "class_weight": ["balanced", None]}
RF_GRID = {"trees": [100, 200, 300], "max_depth": [None, 5, 10, 15], "min_split": [2, 5, 10], "min_leaf": [1, 2, 4],
           "features": ["sqrt", "log2"], "balanced": [True, False]}
GBT_GRID = {"trees": [200, 400, 600], "depth": [3, 5, 7], "rate": [0.01, 0.05, 0.1], "subsample": [0.6, 0.8, 1.0],
            "colsample": [0.6, 0.8, 1.0], "gamma": [0.0, 0.1, 0.3], "alpha": [0.0, 0.1, 1.0]}
N_CANDIDATES = {"logistic": 12, "forest": 15, "gbt": 15}
CV_FOLDS = 5
TREE_MODELS = (boosting.BoostedTrees, forest.RandomForest)


def model_columns(df: DataFrame, exclude: tuple = (S.ID_COLUMN, S.TARGET_COLUMN, LABEL, "split", "fold",
                                                     WEIGHT)) -> list[str]:
    """Numeric columns only (text columns never reach the assembler)."""
    num = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def with_label(df: DataFrame) -> DataFrame:
    if LABEL in df.columns:
        return df
    from churnlake.functions.columns import churn_label
    return df.withColumn(LABEL, churn_label(F.col(S.TARGET_COLUMN)).cast("double"))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced weights n / (2 n_c) and the boosting ratio neg / max(pos, 1) (M5).

    One grouped count (two rows), joined back by broadcast where used.
    """
    counts = with_label(df).groupBy(LABEL).agg(F.count(F.lit(1)).alias("n_c"))
    tot = counts.agg(F.sum("n_c").alias("n"),
                     F.sum(F.when(F.col(LABEL) == 1, F.col("n_c")).otherwise(0)).alias("pos"),
                     F.sum(F.when(F.col(LABEL) == 0, F.col("n_c")).otherwise(0)).alias("neg"))
    return counts.crossJoin(tot).select(
        F.col(LABEL).cast("int").alias("label"), F.col("n_c").alias("count"),
        (F.col("n") / (2.0 * F.col("n_c"))).alias("balanced_weight"),
        (F.col("neg") / F.greatest(F.col("pos"), F.lit(1))).alias("scale_pos_weight"))


def add_weights(df: DataFrame, mode: str | None) -> DataFrame:
    """``balanced`` -> n/(2 n_c); ``ratio`` -> positives weighted neg/pos; None -> 1."""
    df = with_label(df)
    if mode is None:
        return df.withColumn(WEIGHT, F.lit(1.0))
    w = F.broadcast(class_weights(df))  # two rows
    col = "balanced_weight" if mode == "balanced" else "scale_pos_weight"
    joined = df.join(w.select(F.col("label").cast("double").alias(LABEL), col), LABEL, "left")
    if mode == "balanced":
        return joined.withColumn(WEIGHT, F.col(col)).drop(col)
    return joined.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, F.col(col)).otherwise(1.0)).drop(col)


def _weight_arg(weighted: bool) -> dict:
    return {"weightCol": WEIGHT} if weighted else {}


def _assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def logistic(features: list[str], n_rows: int, C: float = 1.0, penalty: str = "l2",
             weighted: bool = False) -> Pipeline:
    """C-form L2/L1 logistic regression: regParam = 1 / (C * n) gives the same optimum."""
    # tol 1e-4 and 1000 iterations: the reference estimator's stopping rule
    lr = LogisticRegression(featuresCol="features", labelCol=LABEL, maxIter=1000, tol=1e-4,
                            regParam=1.0 / (C * max(n_rows, 1)),
                            elasticNetParam=1.0 if penalty == "l1" else 0.0,
                            standardization=False, **_weight_arg(weighted))
    return Pipeline(stages=[_assembler(features), lr])


def probability(model, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Class-1 probability as a plain column ``p``."""
    if isinstance(model, TREE_MODELS):
        return model.probability(df, keep)
    out = model.transform(df)
    return out.select(*(keep or []), vector_to_array("probability")[1].alias("p"))


def _importances(est) -> list[float]:
    """What a fitted stage says of its inputs: tree importances, or the size of linear weights."""
    readers = (("featureImportances", lambda v: v), ("coefficients", abs))
    found = next(((read, getattr(est, name)) for name, read in readers if hasattr(est, name)), None)
    if found is None:
        raise TypeError(f"{type(est).__name__} is neither a tree ensemble nor a linear model")
    read, vector = found
    return [float(read(v)) for v in vector.toArray()]


def feature_importance(model, features: list[str], top_n: int = 20) -> DataFrame:
    """Top n features by importance (ties by name)."""
    from pyspark.sql import SparkSession
    found = model.importances() if isinstance(model, TREE_MODELS) else _importances(model.stages[-1])
    rows = sorted(zip(features, found), key=lambda r: (-r[1], r[0]))[:top_n]
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def coefficients(model: PipelineModel, features: list[str]) -> DataFrame:
    from pyspark.sql import SparkSession
    est = model.stages[-1]
    rows = [("(intercept)", float(est.intercept))] + list(zip(features, est.coefficients.toArray().tolist()))
    return SparkSession.getActiveSession().createDataFrame(rows, "feature string, coefficient double")


# ----------------------------------------------------------------- tuning

def sample_candidates(grid: dict, n: int, seed: int = S.SEED) -> list[dict]:
    """n distinct combinations drawn with a seeded RNG (randomised search)."""
    keys = list(grid)
    combos = [{}]
    for k in keys:
        combos = [dict(c, **{k: v}) for c in combos for v in grid[k]]
    rng = random.Random(seed)
    return rng.sample(combos, min(n, len(combos)))


GRIDS = {"logistic": LR_GRID, "forest": RF_GRID, "gbt": GBT_GRID}


def tune(kind: str, train: DataFrame, features: list[str], n_candidates: int | None = None,
         parallelism: int = 4, grid: dict | None = None) -> tuple:
    """Randomised search (M6): seeded sample of the grid, stratified folds, ROC-AUC.

    Returns the best model, fitted on all rows, and one row per candidate (parameters as JSON, mean AUC over the folds).
    Boosting weighs the positive class by neg/pos; the others have class weights as a parameter.
    """
    if kind == "gbt":
        return tune_boosting(train, features, n_candidates, grid)
    if kind == "forest":
        return tune_forest(train, features, n_candidates, grid)
    return tune_logistic(train, features, n_candidates, parallelism, grid)


def tune_logistic(train: DataFrame, features: list[str], n_candidates: int | None = None, parallelism: int = 4,
                  grid: dict | None = None) -> tuple[PipelineModel, DataFrame]:
    """Candidates that differ in class weighting are searched by separate CrossValidators over their own weighted data."""
    from churnlake.operators.sample import cv_folds
    cands = sample_candidates(grid or LR_GRID, n_candidates or N_CANDIDATES["logistic"])
    # the folds are read by every candidate: ranked and written once
    folded = materialize(cv_folds(train, CV_FOLDS), "folds")
    n = folded.count() * (CV_FOLDS - 1) / CV_FOLDS  # rows a fold is fitted on
    evaluator = BinaryClassificationEvaluator(labelCol=LABEL, rawPredictionCol="rawPrediction", metricName="areaUnderROC")
    results, best = [], None
    for weighting in ("balanced", None):
        group = [c for c in cands if c["class_weight"] == weighting]
        if not group:
            continue
        pipe = logistic(features, n, weighted=weighting is not None)
        est = pipe.getStages()[-1]
        maps = [{est.regParam: 1.0 / (c["C"] * n), est.elasticNetParam: 1.0 if c["penalty"] == "l1" else 0.0} for c in group]
        cv = CrossValidator(estimator=pipe, estimatorParamMaps=maps, evaluator=evaluator, foldCol="fold", numFolds=CV_FOLDS,
                            parallelism=parallelism, seed=S.SEED)
        model = cv.fit(add_weights(folded, weighting))
        for c, auc in zip(group, model.avgMetrics):
            results.append(("logistic", json.dumps(c, sort_keys=True), float(auc)))
            if best is None or auc > best[0]:
                best = (auc, model.bestModel)
    return best[1], train.sparkSession.createDataFrame(results, "model string, params string, mean_auc double")


def _ensembles(cands: list[dict]) -> dict[str, list[int]]:
    """The settings without the number of trees, and the numbers of trees asked of each: one ensemble serves them as prefixes."""
    stages: dict = {}
    for c in cands:
        stages.setdefault(json.dumps({k: v for k, v in c.items() if k != "trees"}, sort_keys=True), set()).add(c["trees"])
    return {rest: sorted(trees) for rest, trees in stages.items()}


def _mean_areas(kind: str, cands: list[dict], stages: dict, scored: DataFrame) -> tuple[int, DataFrame]:
    """The best candidate, and (model, params, mean_auc) of all, from scores (fit, trees, id, y, p); fits in order of (ensemble, fold)."""
    from churnlake.operators.evaluate import roc_auc
    key = F.concat_ws("/", F.col("fit").cast("string"), F.col("trees").cast("string"))
    areas = {tuple(map(int, r.model.split("/"))): r.roc_auc for r in
             roc_auc(scored.select(key.alias("model"), "id", "y", "p"), by="model").collect()}  # a row per fit and stage
    results = []
    for c in cands:
        at = list(stages).index(json.dumps({k: v for k, v in c.items() if k != "trees"}, sort_keys=True)) * CV_FOLDS
        known = [a for a in (areas.get((at + k, c["trees"])) for k in range(CV_FOLDS)) if a is not None]
        results.append((kind, json.dumps(c, sort_keys=True), sum(known) / len(known) if known else None))
    best = max(range(len(cands)), key=lambda i: (results[i][2] is not None, results[i][2] or 0.0, -i))
    return best, scored.sparkSession.createDataFrame(results, "model string, params string, mean_auc double")


def _folded(train: DataFrame, features: list[str]):
    """The training rows binned once, on all of them, with their folds."""
    from churnlake.operators.sample import cv_folds
    layout = Layout.fit(train, features)
    return layout, materialize(binned(with_label(cv_folds(train, CV_FOLDS)), layout, LABEL, S.ID_COLUMN, "fold"), "folds-binned")


def tune_forest(train: DataFrame, features: list[str], n_candidates: int | None = None, grid: dict | None = None,
                local_rows: int | None = None) -> tuple[forest.RandomForest, DataFrame]:
    """The search over forests: the trees of all candidates and folds are grown side by side."""
    cands = sample_candidates(grid or RF_GRID, n_candidates or N_CANDIDATES["forest"])
    layout, rows = _folded(train, features)
    stages = _ensembles(cands)
    fits = [forest.Fit(forest.Settings(**json.loads(rest), trees=trees[-1]), fold) for rest, trees in stages.items() for fold in range(CV_FOLDS)]
    each = [tuple(trees) for trees in stages.values() for _ in range(CV_FOLDS)]
    scored = forest.held_out_scores(rows, layout, fits, each, math.gcd(*(t for ts in each for t in ts)), local_rows)
    best, table = _mean_areas("forest", cands, stages, scored)
    return forest.train(rows, layout, [forest.Fit(forest.Settings(**cands[best]))], local_rows)[0], table


def tune_boosting(train: DataFrame, features: list[str], n_candidates: int | None = None, grid: dict | None = None,
                  local_rows: int | None = None) -> tuple[boosting.BoostedTrees, DataFrame]:
    """The search over boosting settings: all candidates and folds are grown at once."""
    cands = sample_candidates(grid or GBT_GRID, n_candidates or N_CANDIDATES["gbt"])
    layout, rows = _folded(train, features)
    ratio, stages = boosting.class_ratio(with_label(train), LABEL), _ensembles(cands)
    fits = [boosting.Fit(boosting.Settings(**json.loads(rest), trees=trees[-1]), fold, tuple(trees))
            for rest, trees in stages.items() for fold in range(CV_FOLDS)]
    _, scored = boosting.train(rows, layout, fits, ratio, with_trees=False, local_rows=local_rows)
    best, table = _mean_areas("gbt", cands, stages, scored.withColumnRenamed("margin", "p"))
    return boosting.train(rows, layout, [boosting.Fit(boosting.Settings(**cands[best]))], ratio, local_rows=local_rows)[0][0], table


# ----------------------------------------------------------------- persistence

@dataclass(frozen=True)
class Fingerprint:
    """Schema + parameters of a trained pipeline; a stored model is reused only if equal."""
    value: str

    @staticmethod
    def of(df: DataFrame, features: list[str], params: dict) -> "Fingerprint":
        blob = json.dumps({"schema": df.select(*features).schema.json(), "params": params}, sort_keys=True)
        return Fingerprint(hashlib.sha256(blob.encode()).hexdigest()[:16])


def save_model(model, path: str, fp: Fingerprint | None = None) -> str:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    if isinstance(model, TREE_MODELS):
        model.save(spark, path)
    else:
        model.write().overwrite().save(path)
    if fp is not None:
        spark.createDataFrame([(fp.value,)], "fingerprint string").write.mode("overwrite").parquet(f"{path}-fingerprint")
    return path


def load_model(path: str, fp: Fingerprint | None = None, kind=PipelineModel):
    """The stored model, of the class ``kind``; with ``fp``, one stored under another fingerprint (or none) raises."""
    if fp is not None and stored_fingerprint(path) != fp.value:
        raise ValueError(f"the model in {path} was not trained with this schema and these parameters")
    if kind in TREE_MODELS:
        from pyspark.sql import SparkSession
        return kind.load(SparkSession.getActiveSession(), path)
    return kind.load(path)


def stored_fingerprint(path: str) -> str | None:
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession
    try:
        row = SparkSession.getActiveSession().read.parquet(f"{path}-fingerprint").first()
    except AnalysisException:  # nothing stored there
        return None
    return row[0] if row else None


def fit_or_load(path: str, fp: Fingerprint, fit, kind=PipelineModel):
    """The stored model if its fingerprint is ``fp``, else a new fit, stored under it."""
    if stored_fingerprint(path) == fp.value:
        return load_model(path, fp, kind)
    model = fit()
    save_model(model, path, fp)
    return model


def model_path(df: DataFrame, name: str, fp: Fingerprint) -> str:
    return f"{ensure_checkpoint_dir(df.sparkSession)}/models/{name}-{fp.value}"
