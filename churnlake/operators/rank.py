"""Distributed running totals and exact order statistics.

``Window.orderBy`` without a partition moves every row into one task. Here the rows are
range-partitioned by Spark on the whole order key and written once to the shared folder, with the
number of the range stored in each row. Per-range counts and sums give the offsets of the
ranges; a window inside each range adds the rest. The key includes the tie-break columns, so a
single hot value is spread over ranges; NULL keys are ordered by Spark, first when ascending.

The number of ranges follows the row count alone, and every size takes the same route.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnlake.session import materialize

ROWS_PER_RANGE = 200_000
MIN_RANGES = 4


@dataclass(frozen=True)
class Key:
    name: str
    ascending: bool = True


def _keys(order) -> list[Key]:
    return [k if isinstance(k, Key) else Key(*k) if isinstance(k, tuple) else Key(k) for k in order]


def _sort_cols(keys: list[Key]) -> list[Column]:
    return [F.col(k.name).asc_nulls_first() if k.ascending else F.col(k.name).desc_nulls_last() for k in keys]


def range_count(n_rows: int) -> int:
    return max(MIN_RANGES, math.ceil(n_rows / ROWS_PER_RANGE))


def ranged(df: DataFrame, order, ranges: int) -> DataFrame:
    """``df`` range-partitioned along ``order`` and written, with the range's number in ``_range``."""
    split = df.repartitionByRange(ranges, *_sort_cols(_keys(order)))
    return materialize(split.withColumn("_range", F.spark_partition_id()), "ranges")


def _with_offsets(stored: DataFrame, values: list[str], stats: list | None = None) -> DataFrame:
    """``stored`` joined with the count and sums of all earlier ranges (one row per range)."""
    stats = stats or range_stats(stored, values)
    types = {f.name: f.dataType for f in stored.schema.fields}
    zero = {v: 0 if isinstance(_sum_type(types[v]), T.LongType) else 0.0 for v in values}
    rows, n, sums = [], 0, dict(zero)
    for r in stats:
        rows.append((r["_range"], n, *sums.values()))
        n += r["_n"]
        sums = {v: sums[v] + (r[f"_s_{v}"] or zero[v]) for v in values}
    schema = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_off_n", T.LongType()),
                           *[T.StructField(f"_off_{v}", _sum_type(types[v])) for v in values]])
    return stored.join(F.broadcast(stored.sparkSession.createDataFrame(rows, schema)), "_range")


def range_stats(stored: DataFrame, values: list[str]) -> list:
    """Rows (_range, _n, _s_value...) in range order."""
    return (stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in values])
            .orderBy("_range").collect())


def running_totals(df: DataFrame, order, values: list[str], *, prefix: str = "cum_",
                   position: str | None = "pos", buckets: int | None = None,
                   n_rows: int | None = None) -> DataFrame:
    """Append inclusive running sums of ``values`` (and a 1-based ``position``)
    along ``order``, whose keys together are unique per row.
    """
    ranges = buckets or range_count(df.count() if n_rows is None else n_rows)
    stored = ranged(df, order, ranges)
    return totals_of(stored, df.columns, order, values, prefix=prefix, position=position)


def totals_of(stored: DataFrame, columns: list[str], order, values: list[str], *, prefix: str = "cum_",
              position: str | None = None, stats: list | None = None) -> DataFrame:
    """Running totals over a table that ``ranged`` wrote in the same order."""
    w = (Window.partitionBy("_range").orderBy(*_sort_cols(_keys(order)))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _with_offsets(stored, values, stats).select(
        *columns,
        *[(F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(w), F.lit(0))).alias(f"{prefix}{v}") for v in values],
        *([(F.col("_off_n") + F.row_number().over(w)).alias(position)] if position else []))


def _sum_type(t: T.DataType) -> T.DataType:
    integral = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.BooleanType)
    return T.LongType() if isinstance(t, integral) else T.DoubleType()


def exact_quantiles_by_column(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list]:
    """Linearly interpolated quantiles (the pandas/numpy default) of several columns, exact.

    Values are counted per distinct (column, value), so hot values collapse on the map side; the counts
    are range-partitioned on (column, value) once. The range totals tell in which ranges the wanted
    positions lie; only the two values around each position reach the driver. NULL and NaN are left out.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v"))
                                for i, c in enumerate(cols)]))
    counts = materialize(df.select(pairs.alias("kv")).select("kv.c", "kv.v")
                         .where(F.col("v").isNotNull() & ~F.isnan("v"))
                         .groupBy("c", "v").agg(F.count(F.lit(1)).alias("w")), "value-counts")
    totals = {r["c"]: (r["n"], r["k"]) for r in
              counts.groupBy("c").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
    wanted, before = {}, 0
    for i in range(len(cols)):
        n = totals.get(i, (0, 0))[0]
        for q in probs if n else ():
            h = (n - 1) * q
            wanted[i, q] = (h, before + math.floor(h), before + math.ceil(h))
        before += n
    places = sorted({p for _, lo, hi in wanted.values() for p in (lo, hi)})
    values = _values_at(counts, [Key("c"), Key("v")], places, sum(k for _, k in totals.values()))
    out = {}
    for i, c in enumerate(cols):
        out[c] = []
        for q in probs:
            if (i, q) not in wanted:
                out[c].append(None)
                continue
            h, lo, hi = wanted[i, q]
            a, b, t = values[lo], values[hi], h - math.floor(h)
            out[c].append(a + (b - a) * t if t < 0.5 else b - (b - a) * (1 - t))
    return out


def _values_at(counts: DataFrame, order: list[Key], places: list[int], n_rows: int) -> dict[int, float]:
    """The value v at each 0-based place of the order, from weighted distinct values (columns v, w)."""
    if not places:
        return {}
    ranked = running_totals(counts, order, ["w"], position=None, n_rows=n_rows)
    hit = F.exists(F.array(*[F.lit(p) for p in places]),
                   lambda p: (F.col("cum_w") - F.col("w") <= p) & (p < F.col("cum_w")))
    found = ranked.where(hit).select("v", "w", "cum_w").collect()
    return {p: next(r["v"] for r in found if r["cum_w"] - r["w"] <= p < r["cum_w"]) for p in places}


def exact_order_statistics(df: DataFrame, col: str, ranks: list[int]) -> dict[int, float]:
    """Values at 0-based ranks of the sorted column without NULL and NaN."""
    counts = materialize(df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
                         .groupBy("v").agg(F.count(F.lit(1)).alias("w")), "value-counts")
    return _values_at(counts, [Key("v")], sorted(set(ranks)), counts.count())


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    return exact_quantiles_by_column(df, [col], probs)[col]
