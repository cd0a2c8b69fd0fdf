"""Filters, filter domains, previews and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import schema as S
from churnlake.functions.columns import churn_label, network_quality_label


def filter_customers(df: DataFrame, network_qualities: list[int], tenure_range: tuple,
                     charges_range: tuple, sentiment_range: tuple | None = None) -> DataFrame:
    """Inclusive ranges; rows with a missing value fail the predicate.

    Raw-column predicates (tenure, MonthlyCharges) pass through the feature
    projections down to the scan.
    """
    pred = (F.col("network_quality").isin(list(network_qualities))
            & F.col("tenure").between(*tenure_range)
            & F.col("MonthlyCharges").between(*charges_range))
    if sentiment_range is not None and "sentiment_score" in df.columns:
        pred = pred & F.col("sentiment_score").between(*sentiment_range)
    # where() drops NULL like false; a bare predicate stays translatable to parquet filters
    return df.where(pred)


def filter_bounds(df: DataFrame) -> DataFrame:
    """Sorted distinct network qualities (integers) and min/max of tenure and charges, from one aggregate.

    The set holds the domain of a slider, a handful of values.
    """
    return df.agg(F.sort_array(F.collect_set(F.col("network_quality").cast("int"))).alias("network_qualities"),
                  F.min("tenure").alias("tenure_min"), F.max("tenure").alias("tenure_max"),
                  F.min("MonthlyCharges").alias("charges_min"), F.max("MonthlyCharges").alias("charges_max"))


def filtered_count(df: DataFrame, predicate) -> DataFrame:
    return df.agg(F.count_if(predicate).alias("shown"),
                  F.count(F.lit(1)).alias("total"))


def preview(df: DataFrame, n: int = 10, key: str = S.ID_COLUMN) -> DataFrame:
    return df.orderBy(key).limit(n)


def feature_target_split(df: DataFrame, target: str = S.TARGET_COLUMN,
                         id_col: str = S.ID_COLUMN) -> DataFrame:
    """Feature columns with the key kept beside them; the target as ``label``."""
    feats = [c for c in df.columns if c not in (target, id_col)]
    return df.select(id_col, *feats, churn_label(F.col(target)).alias("label"))


def drop_non_model_columns(df: DataFrame, keep: tuple = ("complaint_text_clean", S.ID_COLUMN)) -> DataFrame:
    drop = {"tenure_bracket", "complaint_text"}
    cols = [f.name for f in df.schema.fields
            if f.name in keep or (f.name not in drop and not isinstance(f.dataType, T.StringType))]
    return df.select(*cols)


def churn_to_numeric(df: DataFrame, target: str = S.TARGET_COLUMN) -> DataFrame:
    return df.withColumn(target, churn_label(F.col(target)))


def with_network_quality_label(df: DataFrame) -> DataFrame:
    return df.withColumn("network_quality_label", network_quality_label(F.col("network_quality")))
