"""Column-expression helpers (all JVM-side, no Python on rows)."""

from churnlake.functions.columns import (  # noqa: F401
    churn_label, parse_number, nan_to_null, safe_ratio, yes_no_flag,
    network_quality_label, tenure_bracket_code, tenure_bracket_label, risk_tier,
)
from churnlake.functions.text import drop_stopwords, keyword_flag  # noqa: F401
