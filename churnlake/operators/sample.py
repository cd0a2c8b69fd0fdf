"""Splits, folds and samples.

Rows are ordered by a seeded hash of the key, h = first 60 bits of
md5(id || ':' || seed), the same function in SQL engines, so the split is
reproducible, independent of partitioning and checkable.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.functions.columns import churn_label
from churnlake.operators.rank import Key, running_totals


def key_hash(id_col: str = S.ID_COLUMN, seed: int = S.SEED) -> Column:
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


HASH_BITS = 60
STEP_BITS = 12


def apportion(sizes: dict, test_size: float) -> dict:
    """Test rows of each class: ceil(test_size * rows) in all, dealt by largest remainder (ties: smaller label, NULL last)."""
    total = sum(sizes.values())
    tests = math.ceil(Fraction(str(test_size)) * total)
    share = {y: n * tests // total for y, n in sizes.items()}
    by_rest = sorted(sizes, key=lambda y: (-(sizes[y] * tests % total), y is None, y))
    for y in by_rest[: tests - sum(share.values())]:
        share[y] += 1
    return share


def class_cuts(df: DataFrame, wanted, target: str, id_col: str, seed: int) -> dict:
    """Per class (NULL is a class): the (hash, id) of its n-th row in (hash, id) order, n from ``wanted(class sizes)``.

    The place is found by counting: rows per leading hash bits, then again inside the one group that holds the place,
    until the hash is known; only then are ids looked at, those of that one hash. Every round reads
    the id and the label and moves a few thousand counts; no row is sorted or shuffled.
    """
    rows = df.select(churn_label(F.col(target)).alias("y"), key_hash(id_col, seed).alias("h"), F.col(id_col).alias("id"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = {y: n for y, n in wanted(sizes).items() if n > 0}
    prefix = {y: 0 for y in left}
    for done in range(STEP_BITS, HASH_BITS + 1, STEP_BITS):
        part = rows.filter(_in_prefix(prefix, done - STEP_BITS)).groupBy(
            "y", F.shiftright("h", HASH_BITS - done).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        for r in sorted(part.collect(), key=lambda r: r["p"]):
            y = r["y"]
            if r["p"] >> STEP_BITS == prefix[y] and left[y] > 0:
                if left[y] > r["n"]:
                    left[y] -= r["n"]
                else:
                    prefix[y], left[y] = r["p"], -left[y]
        left = {y: -k for y, k in left.items()}
    # different ids with equal hashes are rare; rows that repeat an id are counted where they are
    ids: dict = {}
    for r in rows.filter(_in_prefix(prefix, HASH_BITS)).groupBy("y", "id").agg(F.count(F.lit(1)).alias("n")).collect():
        ids.setdefault(r["y"], []).append((r["id"], r["n"]))
    cuts = {}
    for y in prefix:
        for i, n in sorted(ids[y], key=lambda i: (i[0] is not None, i[0])):
            left[y] -= n
            if left[y] <= 0:
                cuts[y] = (prefix[y], i)
                break
    return cuts


def _in_prefix(prefix: dict, bits: int) -> Column:
    hit = F.lit(False)
    for y, p in prefix.items():
        hit = hit | (F.col("y").eqNullSafe(F.lit(y)) & (F.shiftright("h", HASH_BITS - bits) == F.lit(p)))
    return hit


def stratified_split(df: DataFrame, target: str = S.TARGET_COLUMN, test_size: float = 0.2,
                     id_col: str = S.ID_COLUMN, seed: int = S.SEED, exact: bool = True) -> DataFrame:
    """Adds ``split`` ('train'/'test').

    exact: ceil(test_size * rows) rows go to test, shared out to the classes (NULL labels are one) by ``apportion``, of each class
    those first in hash order; each row is compared with its class's cut where it stands. Otherwise a hash threshold with
    no pass before (class rates within sampling error). Rows that repeat an id at the cut go the same way.
    """
    h = key_hash(id_col, seed)
    if not exact:
        return df.withColumn("split", F.when(h / F.lit(float(1 << HASH_BITS)) < test_size, "test").otherwise("train"))
    test = F.lit(False)
    for y, (cut, last) in class_cuts(df, lambda sizes: apportion(sizes, test_size), target, id_col, seed).items():
        here = churn_label(F.col(target)).eqNullSafe(F.lit(y))
        upto = F.coalesce(F.col(id_col) <= F.lit(last), F.col(id_col).isNull())
        test = test | (here & ((h < F.lit(cut)) | ((h == F.lit(cut)) & upto)))
    return df.withColumn("split", F.when(F.coalesce(test, F.lit(False)), F.lit("test")).otherwise(F.lit("train")))


def split_report(split_df: DataFrame, target: str = S.TARGET_COLUMN) -> DataFrame:
    return split_df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(churn_label(F.col(target)).cast("double")), 6).alias("churn_rate"))


def row_sample(df: DataFrame, n: int, id_col: str = S.ID_COLUMN, seed: int = S.SEED) -> DataFrame:
    """min(n, rows) rows first in seeded-hash order: a deterministic top-k."""
    return (df.withColumn("_h", key_hash(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h"))


def cv_folds(df: DataFrame, k: int = 5, target: str = S.TARGET_COLUMN, id_col: str = S.ID_COLUMN,
             seed: int = S.SEED) -> DataFrame:
    """Stratified fold id: position within class (hash order, NULL labels first) modulo k."""
    base = df.withColumn("_y", churn_label(F.col(target))).withColumn("_h", key_hash(id_col, seed))
    sizes = {r["_y"]: r["n"] for r in base.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = running_totals(base, [Key("_y"), Key("_h"), Key(id_col)], [], position="_pos", n_rows=sum(sizes.values()))
    before, start = 0, F.lit(0)
    for y in sorted(sizes, key=lambda y: (y is not None, y)):
        start = F.when(F.col("_y").eqNullSafe(F.lit(y)), F.lit(before)).otherwise(start)
        before += sizes[y]
    return ranked.withColumn("fold", ((F.col("_pos") - 1 - start) % k).cast("int")).drop("_y", "_h", "_pos")
