"""Readers and writers.

CSV is read as strings and cast **by name** to the declared schema: an
explicit CSV schema is applied by position, which silently misreads a file
whose columns come in another order. Columns the schema does not know pass
through as strings.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import schema as S
from churnlake.functions.columns import nan_to_null
from churnlake.session import ensure_checkpoint_dir

REQUIRED_DEFAULT = ["tenure", "MonthlyCharges"]


_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)
# CSV as pandas writes and reads it: a quote inside a quoted field is doubled
CSV_DIALECT = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}


def cast_by_name(df: DataFrame, schema: T.StructType = S.CUSTOMER_SCHEMA) -> DataFrame:
    """Columns cast to the types the schema gives their names.

    Whole numbers written with a fraction ("3.0") are whole numbers; NaN in any
    numeric column is a missing value, whether the schema knows the column or not.
    """
    types = {f.name: f.dataType for f in schema.fields}
    cols = []
    for f in df.schema.fields:
        t, c = types.get(f.name, f.dataType), F.col(f"`{f.name}`")
        if isinstance(t, _INTEGRAL) and not isinstance(f.dataType, _INTEGRAL):
            x = c.cast("string").try_cast("double")
            exact = c.cast("string").try_cast(t)
            c = F.coalesce(exact, F.when(x == F.floor(x), x.try_cast(t)))
        elif t != f.dataType and not isinstance(t, T.StringType):
            c = c.cast("string").try_cast(t)
        if isinstance(t, _FRACTIONAL):
            c = nan_to_null(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _read_csv(spark: SparkSession, path: str, multi_line: bool, mode: str) -> DataFrame:
    return spark.read.options(**CSV_DIALECT, mode=mode, multiLine=multi_line).csv(path)


def load_customers(spark: SparkSession, path: str, fmt: str = "csv",
                   schema: T.StructType = S.CUSTOMER_SCHEMA, multi_line: bool = True) -> DataFrame:
    """Header CSV (or parquet) scan. A missing path raises AnalysisException.

    ``multi_line`` lets quoted fields span lines (free text), at the price of one task
    per file: switch it off for files without line breaks in fields, which then split.
    """
    raw = spark.read.parquet(path) if fmt == "parquet" else _read_csv(spark, path, multi_line, "PERMISSIVE")
    return cast_by_name(raw, schema)


def load_checked(spark: SparkSession, path: str, schema: T.StructType = S.CUSTOMER_SCHEMA,
                 multi_line: bool = True) -> DataFrame:
    """Like ``load_customers`` but malformed rows fail the scan and a file without rows raises."""
    raw = _read_csv(spark, path, multi_line, "FAILFAST")
    if raw.limit(1).isEmpty():
        raise ValueError(f"no data rows in {path}")
    return cast_by_name(raw, schema)


def missing_columns(df: DataFrame, required: list[str] | None = None) -> DataFrame:
    req = REQUIRED_DEFAULT if required is None else required
    missing = [c for c in req if c not in df.columns]
    return df.sparkSession.createDataFrame([(c,) for c in missing], "missing_column string")


def _stamp(ts: _dt.datetime | None) -> str:
    return (ts or _dt.datetime.now()).strftime("%Y%m%d_%H%M%S_%f")


def save_versioned(df: DataFrame, output_dir: str | None = None, prefix: str = "processed",
                   fmt: str = "csv", ts: _dt.datetime | None = None) -> str:
    """Write ``{output_dir}/{prefix}_{YYYYmmdd_HHMMSS_ffffff}``; returns the path.

    An existing version is never replaced: writing to it raises. Default folder: under the session's checkpoint folder.
    """
    base = output_dir or f"{ensure_checkpoint_dir(df.sparkSession)}/datasets"
    path = f"{base}/{prefix}_{_stamp(ts)}"
    w = df.write.mode("errorifexists")
    if fmt == "csv":
        w.options(**CSV_DIALECT).csv(path)
    else:
        w.parquet(path)
    return path


def save_roster(roster: DataFrame, output_dir: str | None = None, ts=None) -> str:
    return save_versioned(roster, output_dir, prefix="high_risk_customers", ts=ts)


def save_model_comparison(comparison: DataFrame, output_dir: str | None = None, ts=None) -> str:
    """Metrics rounded to 4 places, one row per model."""
    metric_cols = [c for c, t in comparison.dtypes if t == "double"]
    rounded = comparison.select(*[F.round(c, 4).alias(c) if c in metric_cols else F.col(c)
                                  for c in comparison.columns])
    return save_versioned(rounded, output_dir, prefix="model_comparison", ts=ts)
