"""Explanations: linear SHAP, global/summary/waterfall/top tables, PDP and ICE
(X1, X3-X8). Tree SHAP (X2) lives in ``treeshap``.

Per-row contributions are column expressions; tables are long
(id, feature, value, shap) so every summary is a plain aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.operators import treeshap
from churnlake.operators.rank import exact_order_statistics


@dataclass(frozen=True)
class LinearScorer:
    """p = sigmoid(intercept + sum w_j x_j): the linear model form (also what
    a fitted logistic regression exposes), so it is checkable in SQL."""
    weights: dict = field(default_factory=dict)
    intercept: float = 0.0

    @staticmethod
    def from_scaled(weights: dict, intercept: float, stats: dict) -> "LinearScorer":
        """Weights over columns scaled as (x - mean) / sd, turned into weights over the columns themselves."""
        raw = {c: w / stats.get(c, (0.0, 1.0))[1] for c, w in weights.items()}
        return LinearScorer(raw, intercept - sum(raw[c] * stats[c][0] for c in raw if c in stats))

    def margin(self, overrides: dict | None = None) -> Column:
        overrides = overrides or {}
        z = F.lit(float(self.intercept))
        for f, w in self.weights.items():
            x = overrides.get(f, F.col(f).cast("double"))
            z = z + F.lit(float(w)) * x
        return z

    def probability(self, overrides: dict | None = None) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin(overrides)))

    def score(self, df: DataFrame, id_col: str = S.ID_COLUMN, keep_y: str | None = None) -> DataFrame:
        cols = [F.col(id_col).alias("id") if id_col != "id" else F.col("id")]
        if keep_y:
            cols.append(F.col(keep_y).alias("y"))
        return df.select(*cols, self.probability().alias("p"))


# FIXED VALUES: the demonstration scorer used by the registered queries
DEMO_SCORER = LinearScorer({"tenure": -0.04, "MonthlyCharges": 0.03, "network_quality": 0.5}, 1.0)


def background_means(background: DataFrame, features: list[str]) -> dict:
    row = background.agg(*[F.avg(F.col(f).cast("double")).alias(f"m{i}")
                           for i, f in enumerate(features)]).first()
    return {f: row[f"m{i}"] for i, f in enumerate(features)}


def shap_linear(df: DataFrame, scorer: LinearScorer, background: DataFrame | None = None,
                id_col: str = S.ID_COLUMN) -> DataFrame:
    """Long table (id, feature, value, shap) with shap = w * (x - mean_background).

    The background is the training table (never the explained row itself).
    Means are one aggregate; the unpivot is an in-row explode.
    """
    rows = shap_linear_rows(df, scorer, background, id_col)
    return rows.select(id_col, F.explode("shap").alias("s")).select(id_col, "s.feature", "s.value", "s.shap")


def shap_linear_rows(df: DataFrame, scorer: LinearScorer, background: DataFrame | None = None,
                     id_col: str = S.ID_COLUMN) -> DataFrame:
    """One row per customer: (id, shap: array of (feature, value, shap))."""
    feats = list(scorer.weights)
    means = background_means(background if background is not None else df, feats)
    return df.select(F.col(id_col), F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                 (F.lit(float(scorer.weights[f])) * (F.col(f).cast("double") - F.lit(means[f]))).alias("shap"))
        for f in feats]).alias("shap"))


def base_value(df: DataFrame, scorer: LinearScorer, background: DataFrame | None = None) -> float:
    feats = list(scorer.weights)
    means = background_means(background if background is not None else df, feats)
    return scorer.intercept + sum(scorer.weights[f] * means[f] for f in feats)


def shap_global(shap_long: DataFrame, max_display: int = 15) -> DataFrame:
    return (shap_long.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
            .orderBy(F.desc("mean_abs_shap"), "feature").limit(max_display))


def shap_summary(shap_long: DataFrame, max_display: int = 20) -> DataFrame:
    """(id, feature, value, shap) restricted to the top features (semi join, tiny right side)."""
    top = shap_global(shap_long, max_display).select("feature")
    return shap_long.join(F.broadcast(top), "feature", "left_semi")


def shap_waterfall(shap_long: DataFrame, customer_id: str, base: float, max_display: int = 15,
                   id_col: str = S.ID_COLUMN) -> DataFrame:
    """One customer: top contributions by |shap|, the rest folded into 'other',
    then a running total from the base value. The window spans one customer's
    features only (bounded by the feature count)."""
    one = shap_long.where(F.col(id_col) == F.lit(customer_id))
    w = Window.orderBy(F.desc(F.abs("shap")), "feature")
    ranked = one.withColumn("rank", F.row_number().over(w))
    top = ranked.where(F.col("rank") <= max_display).select("rank", "feature", "value", "shap")
    rest = (ranked.where(F.col("rank") > max_display)
            .agg(F.lit(max_display + 1).alias("rank"), F.lit("other").alias("feature"),
                 F.lit(None).cast("double").alias("value"), F.sum("shap").alias("shap"))
            .where(F.col("shap").isNotNull()))
    rows = top.unionByName(rest)
    run = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("rank", "feature", "value", "shap",
                       (F.lit(float(base)) + F.sum("shap").over(run)).alias("cumulative"))


def shap_customer_top(shap_rows: DataFrame, top_n: int = 10, id_col: str = S.ID_COLUMN) -> DataFrame:
    """Top n features by |shap| for every customer, sorted inside each row.

    ``shap_rows`` has one row per customer with the array ``shap`` of (feature, value, shap), as
    ``shap_linear_rows`` and ``treeshap.shap_tree_rows`` give it; nothing is shuffled.
    """
    by_size = F.sort_array(F.transform("shap", lambda s: F.struct(
        (-F.abs(s["shap"])).alias("size"), s["feature"].alias("feature"), s["value"].alias("value"), s["shap"].alias("shap"))))
    return shap_rows.select(id_col, F.posexplode(F.slice(by_size, 1, top_n)).alias("pos", "s")).select(
        id_col, (F.col("pos") + 1).alias("rank"), "s.feature", "s.value", F.col("s.shap").alias("shap_value"),
        F.when(F.col("s.shap") > 0, F.lit("increases_churn")).otherwise(F.lit("reduces_churn")).alias("direction"))


# ----------------------------------------------------------------- PDP / ICE

def pdp_grid(df: DataFrame, feature: str, grid_resolution: int = 100,
             percentiles: tuple = (0.05, 0.95)) -> list[float]:
    """Distinct values when fewer than ``grid_resolution``; otherwise an even
    grid between the two plotting-position quantiles (alphap = betap = 0.4)."""
    x = F.col(feature).cast("double")
    uniq = (df.select(x.alias("v")).where(F.col("v").isNotNull()).distinct()
            .limit(grid_resolution).collect())
    if len(uniq) < grid_resolution:
        return sorted(r["v"] for r in uniq)
    n = df.where(x.isNotNull()).count()
    ranks, plan = set(), []
    for p in percentiles:
        m = 0.4 + p * (1 - 0.4 - 0.4)
        aleph = n * p + m
        k = math.floor(min(max(aleph, 1), n - 1))
        g = min(max(aleph - k, 0.0), 1.0)
        ranks.update({k - 1, k})
        plan.append((k, g))
    stats = exact_order_statistics(df, feature, sorted(ranks))
    lo, hi = [(1 - g) * stats[k - 1] + g * stats[k] for k, g in plan]
    if grid_resolution == 1:
        return [lo]
    step = (hi - lo) / (grid_resolution - 1)
    return [lo + i * step for i in range(grid_resolution - 1)] + [hi]


@dataclass(frozen=True)
class TreeScorer:
    """A fitted tree ensemble, whose response to one feature is a step function worked out per row (``treeshap.responses``)."""
    ensemble: treeshap.Ensemble
    features: list


def _responses(df: DataFrame, scorer, feature: str, grid: list[float], id_col: str) -> DataFrame:
    """(id, grid_index, grid_value, p): the probability of every row at every grid value of a feature.

    ``scorer`` is a ``LinearScorer``, scored in-row with the feature replaced, a ``TreeScorer``, or any function
    from a table of model columns to the same table with ``p``.
    """
    arr = F.array(*[F.struct(F.lit(i).alias("gi"), F.lit(float(v)).alias("gv")) for i, v in enumerate(grid)])
    if isinstance(scorer, TreeScorer):
        rows = treeshap.response_rows(df, scorer.ensemble, scorer.features, feature, grid, id_col)
        each = rows.select(id_col, F.explode(F.arrays_zip(arr.alias("g"), "p")).alias("e")).select(id_col, "e.g", "e.p")
    else:
        each = df.select(*[c for c in df.columns if c != "g"], F.explode(arr).alias("g"))
        each = (each.withColumn("p", scorer.probability({feature: F.col("g.gv")})) if isinstance(scorer, LinearScorer)
                else scorer(each.withColumn(feature, F.col("g.gv").cast("double"))))
    return each.select(F.col(id_col).cast("string").alias(id_col), F.col("g.gi").alias("grid_index"), F.col("g.gv").alias("grid_value"), "p")


def partial_dependence(df: DataFrame, scorer, features: list[str], grid_resolution: int = 100, id_col: str = S.ID_COLUMN) -> DataFrame:
    """Mean probability with the feature set to each grid value, per feature; features the table lacks are left out.

    The rows' values are aggregated straight away (partial aggregation keeps the shuffle at grid size per task).
    """
    known = [f for f in features if f in df.columns]
    if not known:
        raise ValueError(f"no column among {features}")
    outs = []
    for f in known:
        rows = _responses(df, scorer, f, pdp_grid(df, f, grid_resolution), id_col)
        outs.append(rows.groupBy("grid_index", "grid_value").agg(F.avg("p").alias("avg")).select(
            F.lit(f).alias("feature"), "grid_index", F.round("grid_value", 6).alias("grid_value"),
            F.round("avg", 6).alias("partial_dependence")))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def ice_curves(df: DataFrame, scorer, feature: str, sample_n: int = 100,
               grid_resolution: int = 100, id_col: str = S.ID_COLUMN) -> DataFrame:
    """Per-customer curves for a seeded sample of ``sample_n`` customers plus
    their mean ('__mean__' rows)."""
    from churnlake.operators.sample import row_sample
    sample = row_sample(df, sample_n, id_col)
    grid = pdp_grid(sample, feature, grid_resolution)
    curves = _responses(sample, scorer, feature, grid, id_col)
    mean = curves.groupBy("grid_index", "grid_value").agg(F.avg("p").alias("p")) \
        .select(F.lit("__mean__").alias(id_col), "grid_index", "grid_value", "p")
    both = curves.unionByName(mean)
    return both.select(id_col, "grid_index", F.round("grid_value", 6).alias("grid_value"),
                       F.round("p", 6).alias("prediction"))
