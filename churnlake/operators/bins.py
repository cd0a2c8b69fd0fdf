"""Binned feature rows, shared by the tree learners: a row is the bin codes of its features, its label and a hash of its id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CUTS = 254
#: Codes that a byte has.
WIDTH = 256


@dataclass
class Layout:
    """The cuts of each feature; code c means cuts[c - 1] < x <= cuts[c], and len(cuts) + 1 a missing value."""
    features: list
    cuts: list
    offsets: np.ndarray = field(init=False)
    width: int = field(init=False)

    def __post_init__(self):
        sizes = [len(c) + 2 for c in self.cuts]
        self.offsets = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int32)
        self.width = int(sum(sizes))
        self.missing = np.array([s - 1 for s in sizes])
        # the places a split can be: after each bin but the missing one
        self.place_feature = np.repeat(np.arange(len(sizes)), self.missing)
        self.place_code = np.concatenate([np.arange(m) for m in self.missing]) if sizes else np.zeros(0, int)
        self.place = self.offsets[self.place_feature] + self.place_code
        # features of few bins that one byte can tell all codes of
        self.bundles, cells = [], WIDTH
        for j in np.argsort(sizes, kind="stable").tolist():
            cells *= sizes[j]
            if cells > WIDTH:
                self.bundles.append([])
                cells = sizes[j]
            self.bundles[-1].append(j)
        # the cells of a bundle that each bin of its features has, and where these bins are
        self.shares, self.bundled = [], {}
        for features in self.bundles:
            digits = np.indices([sizes[j] for j in features]).reshape(len(features), -1)
            self.shares.append(np.concatenate([digits[i][:, None] == np.arange(sizes[j]) for i, j in enumerate(features)], axis=1).astype(float)
                               if len(features) > 1 else None)
            self.bundled[features[0]] = np.concatenate([self.offsets[j] + np.arange(sizes[j]) for j in features])

    @staticmethod
    def fit(df: DataFrame, features: list[str]) -> "Layout":
        """Cuts at the quantiles k / 256 of each feature, one pass for all; the largest value is no cut."""
        shares = [k / 256 for k in range(1, MAX_CUTS + 1)]
        double = {f: F.col(f"`{f}`").cast("double") for f in features}
        value = {f: F.when(~F.isnan(x), x) for f, x in double.items()}
        row = df.agg(*(F.struct(F.percentile_approx(v, shares, 10_000).alias("q"), F.max(v).alias("top")).alias(f"f{i}")
                       for i, v in enumerate(value.values()))).first()
        cuts = [np.array(sorted({x for x in (r["q"] or []) if x < r["top"]}), float) for r in row]
        return Layout(list(features), cuts)

    def codes(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, cuts in enumerate(self.cuts):
            out[:, j] = np.where(np.isnan(x[:, j]), len(cuts) + 1, np.searchsorted(cuts, x[:, j], "left"))
        return out

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """(bundles, rows): the codes of each bundle's features as the digits of one byte."""
        out = np.zeros((len(self.bundles), len(codes)), np.uint8)
        for row, features in zip(out, self.bundles):
            for j in features:
                row *= np.uint8(self.missing[j] + 1 & WIDTH - 1)  # a size of 256 comes first and alone: 0 times it
                row += codes[:, j]
        return out


def matrix(df: DataFrame, features: list[str], *keep) -> DataFrame:
    nan = F.lit(float("nan"))
    return df.select(*keep, F.array(*(F.coalesce(F.col(f"`{f}`").cast("double"), nan) for f in features)).alias("x"))


def values_of(batch, n_features: int) -> np.ndarray:
    column = batch.column("x")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_features)


def binned(df: DataFrame, layout: Layout, label: str, id_col: str, fold: str | None = None) -> DataFrame:
    """(id, key, y, fold, codes): each row's bins as bytes; without a fold column, fold is -1. Rows without a label go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = layout.codes(values_of(b, len(layout.features)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), b.column("y"), b.column("fold"),
                                              pa.array([r.tobytes() for r in codes], pa.binary())], names=["id", "key", "y", "fold", "codes"])

    rows = matrix(df.filter(F.col(label).isNotNull()), layout.features, F.col(id_col).cast("string").alias("id"),
                   F.xxhash64(F.col(id_col).cast("string")).alias("key"), F.col(label).cast("int").alias("y"),
                   (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"))
    return rows.mapInArrow(run, "id string, key long, y int, fold int, codes binary")


def unpacked(column, n_features: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, n_features)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have so many rows."""
    held, n = [], 0
    for b in batches:
        held, n = [*held, b], n + b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


#: Columns of binned rows that blocks hold as bytes.
_HELD = (("key", np.int64), ("y", np.int32), ("fold", np.int32))


def in_blocks(rows: DataFrame, at_least: int, with_ids: bool) -> DataFrame:
    """Binned rows, so many or more together as one record: (key, y, fold, codes) as bytes, and their ids, if wanted."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _gathered(batches, at_least):
            held = [pa.array([b.column(c).to_numpy().astype(kind).tobytes()], pa.binary()) for c, kind in _HELD]
            ids = b.column("id") if with_ids else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*held, pa.array([b"".join(b.column("codes").to_pylist())], pa.binary()),
                                              pa.array([ids.to_pylist()], pa.list_(pa.string()))], names=[*(c for c, _ in _HELD), "codes", "ids"])

    return rows.select("id", "key", "y", "fold", "codes").mapInArrow(pack, "key binary, y binary, fold binary, codes binary, ids array<string>")


def dealt(rows: DataFrame, groups: int, with_ids: bool, run, fields: str) -> DataFrame:
    """``run(number, ids, key, y, fold, codes)`` of all rows for each of so many groups, a task each, in order of their numbers."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            key, y, fold = (np.frombuffer(b"".join(t.column(c).to_pylist()), kind) for c, kind in _HELD)
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(len(key), -1)
            ids = t.column("ids").combine_chunks().flatten() if with_ids else None
            number = t.column("number")[0].as_py()
            del t, held
            yield from run(number, ids, key, y, fold, codes)

    blocks = in_blocks(rows, 1, with_ids)
    numbered = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("number"), "*")
    return numbered.repartitionById(groups, "number").mapInArrow(each, fields)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
