"""Column groups, domains and constants of the customer table.

The values in the FIXED VALUES block must equal the ones of the churn
pipeline this engine reproduces (column names, category maps, bins, keyword
and stopword lists, thresholds); they are stated as data, in their natural
order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference pipeline's results)
# ---------------------------------------------------------------------------
ID_COLUMN = "customerID"
TARGET_COLUMN = "Churn"
SEED = 42

BINARY_COLUMNS = ["gender", "Partner", "Dependents", "PhoneService", "PaperlessBilling", "Churn"]
BINARY_MAP = {"Yes": 1, "No": 0, "Male": 1, "Female": 0}

CATEGORICAL_COLUMNS = [
    "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
    "Contract", "PaymentMethod",
]

NUMERIC_COLUMNS = ["tenure", "MonthlyCharges", "TotalCharges"]

SCALED_EXTRA_COLUMNS = [
    "avg_monthly_charges", "tenure_network_interaction",
    "charges_network_interaction", "service_bundle_count",
]

INTERNET_NETWORK_QUALITY = {"DSL": 1, "Fiber optic": 2, "No": 0}
NETWORK_QUALITY_LABELS = {0: "Low", 1: "Medium", 2: "High"}

SERVICE_COLUMNS = [
    "PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
]

# right-closed brackets (0,12], (12,24], ..., (60, inf)
TENURE_EDGES = [0, 12, 24, 36, 48, 60]
TENURE_LABELS = ["0-12", "13-24", "25-36", "37-48", "49-60", "60+"]

NETWORK_KEYWORDS = ["network", "signal", "coverage", "dropped", "slow", "speed",
                    "4g", "3g", "disconnected", "outage", "weak"]
BILLING_KEYWORDS = ["bill", "charge", "overcharged", "refund", "price",
                    "expensive", "extra", "payment", "deducted", "balance"]
SERVICE_KEYWORDS = ["service", "support", "help", "response", "staff",
                    "wait", "rude", "resolved", "complaint"]

STOPWORDS = ["hai", "ka", "ki", "ke", "ko", "se", "mein", "aur", "bhi",
             "yeh", "woh", "hain", "nahi", "nhi", "kya", "tha", "thi",
             "the", "a", "an", "is", "it", "in", "of", "to", "for",
             "on", "at", "by", "or", "and", "but", "not", "with"]

SENTIMENT_NEGATIVE_BELOW = -0.1
SENTIMENT_POSITIVE_ABOVE = 0.1
RECENT_CONTRACT_TENURE = 3
HIGH_VALUE_QUANTILE = 0.75

# risk tiers on (0, .4], (.4, .6], (.6, .8], (.8, 1]
RISK_EDGES = [0.0, 0.4, 0.6, 0.8, 1.0]
RISK_LABELS = ["Low", "Medium", "High", "Critical"]

COST_FALSE_NEGATIVE = 500.0
COST_FALSE_POSITIVE = 50.0
DEFAULT_THRESHOLD = 0.5

SEGMENT_FEATURES = ["Contract", "InternetService", "PaymentMethod", "tenure_bracket",
                    "network_quality", "SeniorCitizen", "Partner", "Dependents"]
ROSTER_COLUMNS = ["customerID", "tenure", "MonthlyCharges", "Contract",
                  "InternetService", "network_quality"]

TFIDF_MAX_FEATURES = 50
TFIDF_MIN_DF = 2

# Declared source schema (applied by name over string columns, see sources).
CUSTOMER_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("SeniorCitizen", T.IntegerType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
    T.StructField("complaint_text", T.StringType()),
])
# ---------------------------------------------------------------------------
