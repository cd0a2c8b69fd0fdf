"""The streaming scorer gives the same rows as the batch operators on the same files."""

from pyspark.sql import functions as F

from churnlake.operators import features
from churnlake.plans import queries as Q
from churnlake.sources import adapters, io
from churnlake.streaming import scoring
from tests.conftest import SF001


def test_stream_equals_batch(spark, tmp_path):
    subs = adapters.subscribers(spark, SF001, with_text=True)
    src = str(tmp_path / "in")
    (subs.where(F.col("customerID").cast("int") % 2 == 0).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(src + "/a"))
    (subs.where(F.col("customerID").cast("int") % 2 == 1).write.option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(src + "/b"))
    batch = io.load_customers(spark, src + "/*")
    hv = features.HighValue.fit(batch)
    q = scoring.start_scoring(spark, src + "/*", str(tmp_path / "out"), str(tmp_path / "ckpt"),
                              subs.columns, hv, Q.SCORER)
    q.awaitTermination(300)
    streamed = spark.read.parquet(str(tmp_path / "out")).drop("scored_at")
    expected = scoring.score_stream(batch, hv, Q.SCORER).drop("scored_at")
    assert streamed.count() == subs.count()
    assert streamed.exceptAll(expected).count() == 0 and expected.exceptAll(streamed).count() == 0
