"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnlake import schema as S

# A number as pandas.to_numeric accepts it: optional sign, digits with an
# optional fraction, optional exponent, surrounding blanks allowed.
# try_cast alone would also accept '1d' / '1f' suffixes.
_NUMBER_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def nan_to_null(c: Column) -> Column:
    """NaN is a value in Spark (NaN > 0.1 is true); the pipeline treats it as missing."""
    return F.when(~F.isnan(c), c)


def parse_number(c: Column) -> Column:
    """Text -> double; unparseable, blank, NaN -> NULL (never raises under ANSI)."""
    s = c.cast("string")
    return F.when(s.rlike(_NUMBER_RE), nan_to_null(F.trim(s).try_cast("double")))


def churn_label(c: Column) -> Column:
    """Yes/No, '1'/'0' or numeric 1/0 -> 1/0 integer; anything else -> NULL."""
    s = F.upper(F.trim(c.cast("string")))
    return (F.when(s.isin("YES", "1", "1.0", "TRUE"), F.lit(1))
            .when(s.isin("NO", "0", "0.0", "FALSE"), F.lit(0)))


def yes_no_flag(c: Column) -> Column:
    """Binary encoding Yes/Male -> 1, No/Female -> 0, other -> NULL."""
    expr = None
    for k, v in S.BINARY_MAP.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, NULL when den is 0 or NULL (try_divide semantics)."""
    return F.try_divide(num, den)


def network_quality_label(c: Column) -> Column:
    expr = None
    for k, v in S.NETWORK_QUALITY_LABELS.items():
        expr = F.when(c == k, F.lit(v)) if expr is None else expr.when(c == k, F.lit(v))
    return expr.otherwise(c.cast("string"))


def tenure_bracket_label(tenure: Column, strict: bool = False) -> Column:
    """Right-closed brackets; tenure 0 joins the first bracket unless strict."""
    edges, labels = S.TENURE_EDGES, S.TENURE_LABELS
    first = (tenure > edges[0]) & (tenure <= edges[1])
    if not strict:
        first = (tenure >= edges[0]) & (tenure <= edges[1])
    expr = F.when(first, F.lit(labels[0]))
    for lo, hi, lab in zip(edges[1:-1], edges[2:], labels[1:-1]):
        expr = expr.when((tenure > lo) & (tenure <= hi), F.lit(lab))
    return expr.when(tenure > edges[-1], F.lit(labels[-1]))


def tenure_bracket_code(tenure: Column, strict: bool = False) -> Column:
    label = tenure_bracket_label(tenure, strict)
    expr = None
    for i, lab in enumerate(S.TENURE_LABELS):
        expr = F.when(label == lab, F.lit(i)) if expr is None else expr.when(label == lab, F.lit(i))
    return expr


def risk_tier(p_rounded: Column) -> Column:
    """(0,.4] Low, (.4,.6] Medium, (.6,.8] High, (.8,1] Critical; 0 and outside -> NULL."""
    e, lab = S.RISK_EDGES, S.RISK_LABELS
    expr = F.when((p_rounded > e[0]) & (p_rounded <= e[1]), F.lit(lab[0]))
    for hi, name in zip(e[2:], lab[1:]):
        expr = expr.when((p_rounded > e[0]) & (p_rounded <= hi), F.lit(name))
    return expr
