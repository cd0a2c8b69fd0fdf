"""Views over the driver's tables that give the operators their inputs.

* ``subscribers``   - the customer-table schema, derived from customer x orders
                      (left join documents for the complaint text).
* ``scored``        - (id, y, p) rows for the evaluation operators, from events.
* ``dup_customers`` - rows with repeated ids (events keyed by user), for dedup.

Every view is a lazy DataFrame over the parquet scans, so its work grows with
the tables; nothing is materialised on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# FIXED VALUES of the adapter (shared with the SQL oracle)
CONTRACT_BY_SEGMENT = {
    "BUILDING": "Month-to-month", "MACHINERY": "Month-to-month",
    "AUTOMOBILE": "One year", "HOUSEHOLD": "One year", "FURNITURE": "Two year",
}
INTERNET_BY_NATION_MOD3 = ["DSL", "Fiber optic", "No"]
PAYMENT_BY_NATION_MOD4 = ["Electronic check", "Mailed check",
                          "Bank transfer (automatic)", "Credit card (automatic)"]
# column -> bit of c_custkey deciding Yes/No (gender: Male/Female)
# (bits 0-7 only, so every category occurs even in the smallest table)
BIT_OF = {"gender": 0, "SeniorCitizen": 1, "Partner": 2, "Dependents": 3,
          "PhoneService": 4, "PaperlessBilling": 5, "MultipleLines": 6,
          "OnlineSecurity": 7, "OnlineBackup": 6, "DeviceProtection": 0,
          "TechSupport": 1, "StreamingTV": 3, "StreamingMovies": 5}
INTERNET_DEPENDENT = ["OnlineSecurity", "OnlineBackup", "DeviceProtection",
                      "TechSupport", "StreamingTV", "StreamingMovies"]
BLANK_TOTAL_EVERY = 50
CHURN_GAP_DAYS = 180


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bit(c, k: int):
    return F.shiftright(c, k).bitwiseAND(F.lit(1))


def _map_values(c, values: list[str]):
    return reduce(lambda acc, iv: acc.when(c == iv[0], F.lit(iv[1])),
                  list(enumerate(values))[1:], F.when(c == 0, F.lit(values[0])))


# which of several rows of a customer comes first (the derived table has one row per customer)
SUBSCRIBER_ORDER = ["tenure", "MonthlyCharges"]


def subscribers(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    """Customer table in the churn schema.

    orders is aggregated per customer before the join (partial aggregation on
    the map side, so a customer holding a third of the orders is pre-combined
    per task); the global latest date is a one-row aggregate of those aggregates, joined by
    broadcast (one row, bounded).
    """
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey", F.to_date("o_orderdate").alias("d"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amt"))
    per_cust = orders.groupBy("o_custkey").agg(
        F.min("d").alias("first_d"), F.max("d").alias("last_d"), F.sum("amt").alias("total"))
    latest = per_cust.agg(F.max("last_d").alias("latest_d"))

    c = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    df = (c.join(per_cust, c.c_custkey == per_cust.o_custkey, "left")
          .crossJoin(F.broadcast(latest)))
    k = F.col("c_custkey")
    internet = _map_values(F.col("c_nationkey") % 3, INTERNET_BY_NATION_MOD3)
    yes_no = {name: F.when(_bit(k, b) == 1, F.lit("Yes")).otherwise(F.lit("No"))
              for name, b in BIT_OF.items()}
    contract = reduce(lambda acc, kv: acc.when(F.col("c_mktsegment") == kv[0], F.lit(kv[1])),
                      list(CONTRACT_BY_SEGMENT.items())[1:],
                      F.when(F.col("c_mktsegment") == list(CONTRACT_BY_SEGMENT)[0],
                             F.lit(list(CONTRACT_BY_SEGMENT.values())[0])))
    cols = {
        "customerID": k.cast("string"),
        "gender": F.when(_bit(k, BIT_OF["gender"]) == 1, F.lit("Male")).otherwise(F.lit("Female")),
        "SeniorCitizen": _bit(k, BIT_OF["SeniorCitizen"]).cast("int"),
        "Partner": yes_no["Partner"],
        "Dependents": yes_no["Dependents"],
        "tenure": F.coalesce(F.floor(F.datediff("last_d", "first_d") / 30), F.lit(0)).cast("int"),
        "PhoneService": yes_no["PhoneService"],
        "MultipleLines": F.when(yes_no["PhoneService"] == "No", F.lit("No phone service"))
                          .otherwise(yes_no["MultipleLines"]),
        "InternetService": internet,
    }
    for name in INTERNET_DEPENDENT:
        cols[name] = F.when(internet == "No", F.lit("No internet service")).otherwise(yes_no[name])
    cols.update({
        "Contract": contract,
        "PaperlessBilling": yes_no["PaperlessBilling"],
        "PaymentMethod": _map_values(F.col("c_nationkey") % 4, PAYMENT_BY_NATION_MOD4),
        "MonthlyCharges": F.abs(F.col("c_acctbal")) / 100,
        "TotalCharges": F.when(k % BLANK_TOTAL_EVERY == 0, F.lit(" "))
                         .otherwise(F.col("total").cast("string")),
        "Churn": F.when(F.datediff("latest_d", "last_d") > CHURN_GAP_DAYS, F.lit("Yes"))
                  .otherwise(F.lit("No")),
    })
    out = df.select(k.alias("_key"), *[v.alias(n) for n, v in cols.items()])
    if with_text:
        docs = table(spark, sf_dir, "documents").select(
            F.col("doc_id"), F.col("text").alias("complaint_text"))
        out = out.join(docs, out._key == docs.doc_id, "left").drop("doc_id")
    return out.drop("_key")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, p) rows: y = error event, p = value/500 capped at 1."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "error").cast("int").alias("y"),
        F.least(F.col("value") / 500.0, F.lit(1.0)).alias("p"))


def scored_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three 'models' over the same rows: p, 1-p and p*p (model, id, y, p)."""
    s = scored(spark, sf_dir)
    variants = [("direct", F.col("p")), ("inverse", 1.0 - F.col("p")), ("squared", F.col("p") * F.col("p"))]
    return s.select(
        F.explode(F.array(*[F.struct(F.lit(n).alias("model"), e.alias("p")) for n, e in variants]))
        .alias("m"), "id", "y").select("m.model", "id", "y", "m.p")


def dup_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows keyed by user with repeats: (customerID, ts, event_id, event_type, value)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").cast("string").alias("customerID"),
                     "ts", "event_id", "event_type", "value")
