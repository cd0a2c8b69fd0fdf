"""Risk tiers and high-risk rosters (K1-K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.functions.columns import risk_tier as tier_expr


def risk_tier(scored: DataFrame, p_col: str = "p") -> DataFrame:
    """Probability rounded half-even to 4 places and its tier."""
    return (scored.withColumn("churn_probability", F.bround(F.col(p_col), 4))
            .withColumn("risk_tier", tier_expr(F.col("churn_probability"))))


def high_risk_roster(df: DataFrame, p_col: str = "p", top_n: int = 20,
                     id_col: str = S.ID_COLUMN) -> DataFrame:
    """Top n by rounded probability (id breaks ties): a TakeOrderedAndProject."""
    cols = [c for c in S.ROSTER_COLUMNS if c in df.columns and c != id_col]
    tiered = risk_tier(df, p_col)
    return (tiered.select(id_col, *cols, "churn_probability", "risk_tier")
            .orderBy(F.desc("churn_probability"), F.asc(id_col)).limit(top_n))


def roster_for_split(df: DataFrame, p_col: str = "p", top_n: int | None = None, id_col: str = S.ID_COLUMN,
                     text_col: str = "complaint_text", preview_chars: int = 60) -> DataFrame:
    """Display attributes and tier of scored rows, highest risk first, cut to ``top_n`` (all rows if None)."""
    cols = [c for c in S.ROSTER_COLUMNS if c in df.columns and c != id_col]
    text = F.col(text_col) if text_col in df.columns else F.lit("")
    rows = risk_tier(df, p_col).select(
        id_col, *cols, F.substring(F.coalesce(text, F.lit("")), 1, preview_chars).alias("complaint_preview"),
        "churn_probability", "risk_tier").orderBy(F.desc("churn_probability"), F.asc(id_col))
    return rows if top_n is None else rows.limit(top_n)
