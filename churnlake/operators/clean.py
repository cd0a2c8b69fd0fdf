"""Cleaning, de-duplication and data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import schema as S
from churnlake.functions.columns import nan_to_null, parse_number
from churnlake.operators.rank import exact_quantiles_by_column

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def clean_total_charges(df: DataFrame, flag_col: str | None = None) -> DataFrame:
    """TotalCharges text -> double; unparseable/blank/missing -> tenure*MonthlyCharges.

    A table without the column gets it, fully imputed.
    """
    parsed = parse_number(F.col("TotalCharges")) if "TotalCharges" in df.columns else F.lit(None).cast("double")
    imputed = F.col("tenure").cast("double") * F.col("MonthlyCharges").cast("double")
    out = df.withColumn("_tc", parsed)
    if flag_col:
        out = out.withColumn(flag_col, F.col("_tc").isNull().cast("int"))
    return out.withColumn("TotalCharges", F.coalesce(F.col("_tc"), imputed)).drop("_tc")


def imputed_count(df: DataFrame) -> DataFrame:
    """Number of TotalCharges values that C1 imputes (one row)."""
    parsed = parse_number(F.col("TotalCharges")) if "TotalCharges" in df.columns else F.lit(None)
    return df.agg(F.sum(F.when(parsed.isNull(), 1).otherwise(0)).cast("long").alias("imputed"),
                  F.count(F.lit(1)).alias("rows"))


def dedup_first(df: DataFrame, order_cols: list[str], id_col: str = S.ID_COLUMN) -> DataFrame:
    """Keep the first row per id in ``order_cols`` order (null ids form one group).

    The first order key of each id is found on the narrow key columns, combined in every task before the
    shuffle, so an id with very many rows moves once per task. Full rows, texts included, are then moved once, by
    the join with those keys; rows that share id and order key are told apart by the row of least values.
    """
    if id_col not in df.columns:
        raise ValueError(f"dedup needs the id column {id_col!r}")
    if not order_cols:
        raise ValueError("dedup needs the columns that say which row comes first")
    keys = [f"_o{i}" for i in range(len(order_cols))]
    first = F.struct(*[F.col(c).alias(k) for c, k in zip(order_cols, keys)])
    firsts = df.groupBy(F.col(id_col).alias("_id")).agg(F.min(first).alias("_first")).select("_id", "_first.*")
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    for c, k in zip(order_cols, keys):
        same = same & F.col(c).eqNullSafe(F.col(k))
    kept = df.join(firsts, same, "left_semi")
    rest = [c for c in df.columns if c != id_col]
    return kept.groupBy(id_col).agg(F.min(F.struct(*rest)).alias("_row")).select(id_col, "_row.*").select(*df.columns)


def _missing(field: T.StructField):
    """NULL, or NaN in a fractional column."""
    c = F.col(field.name)
    return c.isNull() | F.isnan(c) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else c.isNull()


def quality_shape(df: DataFrame) -> DataFrame:
    """rows, columns and total missing cells in one pass."""
    miss = [F.sum(_missing(f).cast("long")) for f in df.schema.fields]
    total = miss[0]
    for m in miss[1:]:
        total = total + m
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.lit(len(df.columns)).cast("long").alias("n_columns"),
                  F.coalesce(total, F.lit(0)).cast("long").alias("total_missing"))


def quality_missing(df: DataFrame) -> DataFrame:
    """(column, missing) - one aggregate, then unpivot."""
    wide = df.agg(*[F.sum(_missing(f).cast("long")).alias(f"m{i}") for i, f in enumerate(df.schema.fields)])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                         F.coalesce(F.col(f"m{i}"), F.lit(0)).alias("missing"))
                                for i, c in enumerate(df.columns)]))
    return wide.select(stack.alias("s")).select("s.column_name", "s.missing")


def quality_dtypes(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    return spark.createDataFrame([(c, t) for c, t in df.dtypes], "column_name string, dtype string")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def quality_numeric_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """describe(): count, mean, std (n-1), min, 25%, 50%, 75%, max per numeric column.

    Moments come from one aggregate over all columns; exact quartiles use the
    distributed order statistic (no single-task percentile map).
    """
    cols = numeric_columns(df)
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], _SUMMARY_SCHEMA)
    aggs = []
    for i, c in enumerate(cols):
        x = nan_to_null(F.col(c).cast("double"))
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"),
                 F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
    if not exact:
        for i, c in enumerate(cols):
            aggs.append(F.percentile_approx(F.col(c).cast("double"), [0.25, 0.5, 0.75], 10000)
                        .alias(f"q{i}"))
    m = df.agg(*aggs).first()
    quartiles = exact_quantiles_by_column(df, cols, [0.25, 0.5, 0.75]) if exact else {}
    rows = []
    for i, c in enumerate(cols):
        qs = quartiles[c] if exact else (m[f"q{i}"] or [None] * 3)
        rows.append((c, int(m[f"n{i}"]), m[f"a{i}"], m[f"s{i}"], m[f"lo{i}"], *qs, m[f"hi{i}"]))
    return spark.createDataFrame(rows, _SUMMARY_SCHEMA)


_SUMMARY_SCHEMA = ("column_name string, count long, mean double, std double, min double, "
                   "q25 double, q50 double, q75 double, max double")
