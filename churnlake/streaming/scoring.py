"""Incremental scoring of customer files as they arrive (Structured Streaming).

The batch pipeline's row-wise steps - C1 cleaning, the structured features
with their *fitted* parameters (high-value threshold), text features and a
linear scorer - are all stateless projections, so the very same operators
run on a streaming DataFrame. Nothing here keeps state across micro-batches:
de-duplication across files would need unbounded state without an event
time, so it stays a batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake import schema as S
from churnlake.operators import clean, features, roster, text
from churnlake.operators.explain import LinearScorer
from churnlake.sources.io import CSV_DIALECT, cast_by_name


def read_customer_stream(spark: SparkSession, source_dir: str, columns: list[str],
                         max_files_per_trigger: int = 100) -> DataFrame:
    """Header CSV files as a stream; strings first, then cast by name."""
    raw_schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    # enforceSchema=false: a header that does not match the column names fails the scan
    raw = (spark.readStream.schema(raw_schema).options(**CSV_DIALECT, multiLine=True, enforceSchema=False)
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir))
    return cast_by_name(raw)


def score_stream(stream: DataFrame, high_value: features.HighValue, scorer: LinearScorer) -> DataFrame:
    """Stateless feature pipeline + score + tier on each micro-batch."""
    df = clean.clean_total_charges(stream)
    df = features.structured_features(df, high_value)
    df = text.text_features(df)
    scored = df.withColumn("p", scorer.probability())
    tiered = roster.risk_tier(scored)
    keep = [c for c in S.ROSTER_COLUMNS if c in tiered.columns]
    return tiered.select(*keep, "sentiment_score", "churn_probability", "risk_tier",
                         F.current_timestamp().alias("scored_at"))


def start_scoring(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                  columns: list[str], high_value: features.HighValue, scorer: LinearScorer,
                  available_now: bool = True):
    """Score new files into a parquet sink; the checkpoint makes restarts exactly-once."""
    out = score_stream(read_customer_stream(spark, source_dir, columns), high_value, scorer)
    writer = (out.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
