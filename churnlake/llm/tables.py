"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that are not taken, in any case: helpers that no column of the input can clash with."""
    used, found = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        found.append(name)
    return found


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots included."""
    return [F.col(f"`{c}`") for c in columns]


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written in the shared folder, tightly compressed, and read back: later passes re-read files."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def learning_rows(id_col: str = "doc_id"):
    """The rows a model may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda, a plain column expression is evaluated per element."""
    return F.transform(F.array(value), body)[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of an Arrow batch that hold about ``limit`` bytes in a string or binary column, at least a row each."""
    values = batch.column(column)
    sizes = np.cumsum([0] + [len(x.as_buffer()) if x.is_valid else 0 for x in values])
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + limit, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
