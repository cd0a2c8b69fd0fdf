"""Encoding and scaling (G1-G4), fit/transform separated.

Fitted parameters (category lists, means, deviations) are small and the only
things that reach the driver; transforms are plain column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.functions.columns import churn_label, nan_to_null, yes_no_flag


def encode_binary(df: DataFrame, strict: bool = False) -> DataFrame:
    """Yes/Male -> 1, No/Female -> 0 (Churn also accepts 1/0). Unknown -> NULL,
    or an error in strict mode."""
    out = df
    for c in S.BINARY_COLUMNS:
        if c not in df.columns:
            continue
        e = churn_label(F.col(c)) if c == S.TARGET_COLUMN else yes_no_flag(F.col(c))
        if strict:
            e = F.when(F.col(c).isNull() | e.isNotNull(), e).otherwise(
                F.raise_error(F.concat(F.lit(f"unknown value in {c}: "), F.col(c).cast("string"))))
        out = out.withColumn(c, e.cast("int"))
    return out


def encode_senior(df: DataFrame) -> DataFrame:
    if "SeniorCitizen" not in df.columns:
        return df
    return df.withColumn("SeniorCitizen", F.col("SeniorCitizen").cast("int"))


@dataclass(frozen=True)
class OneHot:
    """Sorted categories per column; the first is dropped (reference level)."""
    categories: dict = field(default_factory=dict)

    @staticmethod
    def fit(df: DataFrame, columns: list[str] | None = None) -> "OneHot":
        cols = [c for c in (columns or S.CATEGORICAL_COLUMNS) if c in df.columns]
        if not cols:
            return OneHot({})
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("val"))
                                    for c in cols]))
        distinct = (df.select(pairs.alias("kv")).select("kv.col", "kv.val")
                    .where(F.col("val").isNotNull()).distinct())
        cats: dict[str, list[str]] = {c: [] for c in cols}
        for r in distinct.collect():  # one row per output column
            cats[r["col"]].append(r["val"])
        return OneHot({c: sorted(v) for c, v in cats.items()})

    def output_columns(self) -> list[str]:
        return [f"{c}_{v}" for c, vals in self.categories.items() for v in vals[1:]]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, vals in self.categories.items():
            for v in vals[1:]:
                new[f"{c}_{v}"] = F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0))
        keep = [F.col(c) for c in df.columns if c not in self.categories]
        return df.select(*keep, *[e.alias(n) for n, e in new.items()])


def encode_categorical(df: DataFrame, onehot: OneHot | None = None) -> DataFrame:
    """G1 + G2 + G3 + D6: binary, senior, one-hot, then drop non-model strings."""
    from churnlake.operators.select import drop_non_model_columns
    oh = onehot or OneHot.fit(df)
    return drop_non_model_columns(oh.transform(encode_senior(encode_binary(df))))


def default_scaled_columns(df: DataFrame) -> list[str]:
    return [c for c in S.NUMERIC_COLUMNS + S.SCALED_EXTRA_COLUMNS if c in df.columns]


@dataclass(frozen=True)
class Scaler:
    """Mean and population standard deviation per column (zero std -> 1)."""
    stats: dict = field(default_factory=dict)

    @staticmethod
    def fit(train: DataFrame, columns: list[str] | None = None) -> "Scaler":
        cols = columns or default_scaled_columns(train)
        values = [nan_to_null(F.col(c).cast("double")) for c in cols]
        row = train.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
                        *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)]).first()
        stats = {}
        for i, c in enumerate(cols):
            sd = row[f"s{i}"]
            stats[c] = (row[f"m{i}"], sd if sd else 1.0)
        return Scaler(stats)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                               for c, (m, s) in self.stats.items() if c in df.columns})
