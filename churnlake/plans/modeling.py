"""Model plans: encoded matrix -> split -> scaled (LR) / raw (trees) -> fit ->
score the test split. Used by the registered model queries and the bench."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.operators import boosting, encode, forest, models, sample
from churnlake.operators.explain import LinearScorer
from churnlake.plans import pipeline
from churnlake.session import materialize


@dataclass
class Matrix:
    train: DataFrame
    test: DataFrame
    features: list
    scaler: encode.Scaler


def model_matrix(spark: SparkSession, sf_dir: str) -> Matrix:
    """Prepared table -> encoded numeric matrix (key kept, text not assembled) -> exact split."""
    prepared = pipeline.subscribers_prepared(spark, sf_dir, with_text=True)
    encoded = encode.encode_categorical(prepared).drop("complaint_text_clean")
    encoded = models.with_label(encoded)
    split = sample.stratified_split(encoded)
    # the split is consumed by several fits: write it once in the shared checkpoint folder
    split = materialize(split, "model_matrix")
    features = models.model_columns(split)
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    scaler = encode.Scaler.fit(train)
    return Matrix(train, test, features, scaler)


def logistic_pipeline(m: Matrix):
    return models.logistic(m.features, m.train.count())


def fit_logistic(m: Matrix) -> PipelineModel:
    return logistic_pipeline(m).fit(m.scaler.transform(m.train))


def fit_gbt(m: Matrix, settings: boosting.Settings = boosting.SECOND_ORDER) -> boosting.BoostedTrees:
    return boosting.fit(m.train, m.features, settings)


@dataclass(frozen=True)
class Kind:
    """How a model is fitted, the class it is stored as, and all settings that the fit depends on."""
    fit: Callable[[Matrix], object]
    stored: type
    settings: Callable[[Matrix], dict]


def _stage_settings(pipe) -> dict:
    est = pipe.getStages()[-1]
    return {p.name: str(v) for p, v in est.extractParamMap().items()}


FITS = {
    "logistic": Kind(fit_logistic, PipelineModel, lambda m: _stage_settings(logistic_pipeline(m))),
    "forest": Kind(lambda m: forest.fit(m.train, m.features), forest.RandomForest, lambda m: asdict(forest.Settings())),
    "gbt": Kind(fit_gbt, boosting.BoostedTrees, lambda m: asdict(boosting.SECOND_ORDER)),
    "gbt_light": Kind(lambda m: fit_gbt(m, boosting.LEAF_WISE), boosting.BoostedTrees, lambda m: asdict(boosting.LEAF_WISE)),
}


def fitted(m: Matrix, name: str):
    """The model of that name for this matrix: stored once under a fingerprint of its columns, settings and rows."""
    rows = m.train.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*m.train.columns).cast("decimal(38,0)"))).first()
    kind = FITS[name]
    fp = models.Fingerprint.of(m.train, m.features, {"model": name, "settings": kind.settings(m), "rows": [str(v) for v in rows]})
    return models.fit_or_load(models.model_path(m.train, name, fp), fp, lambda: kind.fit(m), kind.stored)


def scored_rows(model, m: Matrix, rows: DataFrame, scaled: bool = False) -> DataFrame:
    """(id, y, p) of some rows of the matrix."""
    out = models.probability(model, m.scaler.transform(rows) if scaled else rows, [S.ID_COLUMN, models.LABEL])
    return out.select(S.ID_COLUMN, F.col(models.LABEL).cast("int").alias("y"), "p")


def scored_test(model, m: Matrix, scaled: bool = False) -> DataFrame:
    return scored_rows(model, m, m.test, scaled)


def model_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked test-split scores of the three trained models: (model, id, y, p)."""
    m = model_matrix(spark, sf_dir)
    return scores_of(m, {"logistic_regression": "logistic", "random_forest": "forest", "gradient_boosting": "gbt"})


def scores_of(m: Matrix, names: dict[str, str]) -> DataFrame:
    """Stacked test scores (model, id, y, p): label shown -> name in FITS."""
    parts = [scored_test(fitted(m, kind), m, scaled=kind == "logistic").select(
        F.lit(shown).alias("model"), F.col(S.ID_COLUMN).alias("id"), "y", "p") for shown, kind in names.items()]
    return reduce(DataFrame.unionByName, parts)


def linear_scorer(m: Matrix) -> LinearScorer:
    """The fitted logistic regression as a scorer over unscaled columns."""
    est = fitted(m, "logistic").stages[-1]
    return LinearScorer.from_scaled(dict(zip(m.features, est.coefficients.toArray().tolist())), float(est.intercept),
                                    m.scaler.stats)


def gradient_norm(m: Matrix) -> DataFrame:
    """(n_train, gradient): largest entry of the penalised mean gradient at the fitted logistic regression.

    At the optimum of mean log loss + reg/2 |w|^2 the gradient is zero in every weight and the intercept.
    """
    est = fitted(m, "logistic").stages[-1]
    w, train = est.coefficients.toArray().tolist(), m.scaler.transform(m.train)
    z = reduce(lambda a, b: a + b, [F.lit(v) * F.col(c).cast("double") for c, v in zip(m.features, w)], F.lit(est.intercept))
    r = 1.0 / (1.0 + F.exp(-z)) - F.col(models.LABEL)
    reg = est.getRegParam()
    parts = [F.abs(F.avg(r * F.col(c).cast("double")) + F.lit(reg * v)) for c, v in zip(m.features, w)]
    return train.agg(F.count(F.lit(1)).alias("n_train"), F.greatest(F.abs(F.avg(r)), *parts).alias("gradient"))
