"""Grouped rates, histograms and correlations."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.functions.columns import churn_label, nan_to_null


def _y(df: DataFrame, target: str) -> Column:
    return churn_label(F.col(target)).cast("double")


def churn_rate_by_feature(df: DataFrame, feature: str, target: str = S.TARGET_COLUMN) -> DataFrame:
    """100 * mean(churn) per non-null feature value, highest first."""
    return (df.where(F.col(feature).isNotNull())
            .groupBy(F.col(feature).alias("value"))
            .agg(F.round(F.avg(_y(df, target)) * 100.0, 6).alias("churn_rate"),
                 F.count(F.lit(1)).alias("customers"))
            .orderBy(F.desc("churn_rate"), F.col("value"))
            .select(F.col("value").cast("string").alias(feature), "churn_rate", "customers"))


def segment_report(df: DataFrame, features: list[str] | None = None,
                   target: str = S.TARGET_COLUMN) -> DataFrame:
    """H1 over several features in one pass: unpivot to (feature, value), one groupBy."""
    feats = [f for f in (features or S.SEGMENT_FEATURES) if f in df.columns]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                         F.col(f).cast("string").alias("value")) for f in feats]))
    long = df.select(pairs.alias("kv"), _y(df, target).alias("y"))
    return (long.where(F.col("kv.value").isNotNull())
            .groupBy(F.col("kv.feature").alias("feature"), F.col("kv.value").alias("value"))
            .agg(F.round(F.avg("y") * 100.0, 6).alias("churn_rate"),
                 F.count(F.lit(1)).alias("customers")))


def overall_churn_rate(df: DataFrame, target: str = S.TARGET_COLUMN) -> DataFrame:
    return df.agg(F.round(F.avg(_y(df, target)), 6).alias("churn_rate"),
                  F.count(F.lit(1)).alias("customers"))


def histogram_by_class(df: DataFrame, features: list[str], target: str = S.TARGET_COLUMN,
                       bins: int = 30, classes: list[int] | None = (0, 1)) -> DataFrame:
    """Equal-width counts per (feature, class) with that class's own min/max, empty bins included.

    Last bin is closed; min == max widens the range by 0.5 each side. Several
    features are unpivoted first, so one aggregate serves all of them. The
    per-(feature,class) ranges are a tiny aggregate joined back by broadcast.
    ``classes=None`` puts every row in one class (-1): the no-target case.
    """
    cls = F.lit(-1) if classes is None else churn_label(F.col(target))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"),
                                         F.col(f).cast("double").alias("x")) for f in features]))
    long = (df.select(pairs.alias("kv"), cls.alias("cls"))
            .select("kv.feature", "kv.x", "cls")
            .where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("cls").isNotNull()))
    if classes is not None:
        long = long.where(F.col("cls").isin(list(classes)))
    rng = (long.groupBy("feature", "cls").agg(F.min("x").alias("mn"), F.max("x").alias("mx"))
           .select("feature", "cls",
                   F.when(F.col("mn") == F.col("mx"), F.col("mn") - 0.5).otherwise(F.col("mn")).alias("lo"),
                   F.when(F.col("mn") == F.col("mx"), F.col("mx") + 0.5).otherwise(F.col("mx")).alias("hi")))
    # one row per (feature, class): bounded by |features| x |classes|
    joined = long.join(F.broadcast(rng), ["feature", "cls"])
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                F.lit(bins - 1)).cast("int")
    counts = joined.withColumn("bin", b).groupBy("feature", "cls", "bin").agg(F.count(F.lit(1)).alias("count"))
    every = rng.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = every.join(counts, ["feature", "cls", "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return out.select("feature", F.col("cls").alias("churn"), "bin",
                      F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins, 6).alias("bin_start"),
                      F.round(F.col("lo") + (F.col("bin") + 1) * (F.col("hi") - F.col("lo")) / bins, 6).alias("bin_end"),
                      "count")


def correlation_matrix(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Pearson r for every column pair (strict lower triangle), nulls dropped pairwise.

    One aggregate computes all k(k-1)/2 correlations.
    """
    from churnlake.operators.clean import numeric_columns
    cols = cols or numeric_columns(df)
    pairs = list(combinations(cols, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, r double")
    value = {c: nan_to_null(F.col(c).cast("double")) for c in cols}
    wide = df.agg(*[F.corr(value[a], value[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("feature_a"), F.lit(a).alias("feature_b"),
                                        F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)]))
    return wide.select(rows.alias("p")).select("p.feature_a", "p.feature_b",
                                                F.round("p.r", 6).alias("r"))
