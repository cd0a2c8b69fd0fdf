"""Gradient boosting of trees over histograms (M3, M4, M6, M7): second order, level by level, many fits at once.

Features are binned once: at most 254 cuts, the exact quantiles of the training rows, and a bin of their own for missing
values. From then on a row is its bin codes, its label and its margin under every fit. A level of a tree
needs the sums of gradients and hessians per (fit, node, bin); they are taken in one pass over the rows for all
fits together. Where the partial sums of a level are small (``DRIVER_BYTES``) the driver adds them up, so a level is a single stage
and of two children one is counted; else Spark adds them up per (fit, node), and only the best split of every node reaches the driver.

Sums are fixed-point integers, so neither the partitioning nor the order of addition can change a tree. Rows and columns are
sampled by hashes of (row key, tree), which any task can work out alone. Because of both, fits whose rows
are few (``LOCAL_ROWS``, a bound on what a group may hold) need no pass per level: each fit is then one task and grows its
trees there with the same functions; a search of 75 such fits is 75 tasks. Both routes give the same trees, bit for bit.

Leaf-wise growth takes the open leaf of best gain first, up to ``max_leaves``. The best split of a node does not depend on
when it is opened, so the tree is grown level by level and the best-first choice is made on the finished gains.
"""

from __future__ import annotations

import heapq
import io
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.operators.bins import WIDTH, Layout, binned, dealt, in_blocks, matrix, mix, values_of
from churnlake.session import ensure_checkpoint_dir, materialize

#: A fit with no more rows than this is grown whole in one task; larger ones level by level.
LOCAL_ROWS = 250_000
#: Bytes of histograms that a task of the level-by-level route holds.
HELD_BYTES = 128 << 20
#: Bytes of partial histograms of a pass that the driver adds up itself.
DRIVER_BYTES = 16 << 20
#: Trees after which the margins of the level-by-level route are brought up to date, by the pass that reads them next.
REFRESH = 4
#: Of so many such writings one goes to the checkpoint folder, the others stay with the executors (a lost one is worked out again).
KEPT_STEPS = 16
#: Nodes whose histograms a task adds up, where there are cores enough.
NODES_PER_TASK = 8
#: Rows of a partition of the level-by-level route, where the cores do not ask for smaller ones, and rows times fits that a task is worth.
PART_ROWS = 500_000
LEAST_ROWS = 12_000
#: Rows times fits of a block of rows.
BLOCK_ROWS = 60_000
LEAST_GAIN = 1e-6
_NONE = -2


@dataclass(frozen=True)
class Settings:
    """What a fit is made with; the defaults are those of the second-order preset."""
    trees: int = 300
    depth: int = 5
    rate: float = 0.05
    subsample: float = 0.8
    colsample: float = 0.8
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    max_leaves: int | None = None
    from_average: bool = False
    seed: int = S.SEED


# FIXED VALUES: the two boosting presets; what they leave open has the usual defaults of such libraries
SECOND_ORDER = Settings()
LEAF_WISE = Settings(trees=400, depth=6, subsample=1.0, lam=0.0, min_hessian=1e-3, min_rows=20, max_leaves=31, from_average=True)


# ------------------------------------------------------------------ one tree

class Heap:
    """A tree as arrays over heap numbers: the root is 1, the children of i are 2 i and 2 i + 1. A feature of -1 is a leaf."""

    NAMES = ("feature", "code", "missing_left", "value", "cover", "gain")

    def __init__(self, depth: int):
        size, self.depth = 2 << depth, depth
        self.feature, self.code = np.full(size, _NONE, np.int32), np.zeros(size, np.int32)
        self.missing_left = np.zeros(size, bool)
        self.value, self.cover, self.gain = (np.zeros(size) for _ in range(3))

    def descend(self, codes: np.ndarray, missing: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The heap number at which each row ends, or arrives after so many levels."""
        return walk(self.ways(missing), codes, self.depth if levels is None else levels)

    def ways(self, missing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The feature asked at each node (0 where none is) and, for each code of it, the node that comes next: a leaf itself."""
        following = np.repeat(np.arange(len(self.feature)), WIDTH).reshape(-1, WIDTH)
        inner = np.flatnonzero(self.feature >= 0)
        code, f = np.arange(WIDTH), self.feature[inner]
        left = np.where(code == missing[f][:, None], self.missing_left[inner][:, None], code <= self.code[inner][:, None])
        following[inner] = 2 * inner[:, None] + ~left
        return np.maximum(self.feature, 0).astype(np.int64), following.ravel()

    def _enter(self, ids: np.ndarray, g: np.ndarray, h: np.ndarray, s: Settings, unit: float) -> None:
        """Nodes as leaves, from their sums."""
        self.feature[ids] = -1
        self.cover[ids] = h / unit
        self.value[ids] = -s.rate * _weight(g / unit, s) / (h / unit + max(s.lam, 1e-12))

    def put(self, ids: np.ndarray, best: dict, level: int, s: Settings, unit: float) -> np.ndarray:
        """Enter a level; returns the children that are still to be entered, those at full depth are leaves."""
        self._enter(ids, best["g"], best["h"], s, unit)
        split = (best["gain"] > LEAST_GAIN) & (best["gain"] >= s.gamma) & (level < s.depth)
        into = ids[split]
        for name in ("feature", "code", "missing_left", "gain"):
            getattr(self, name)[into] = best[name][split]
        if level + 1 == s.depth:  # the split tells the children's sums: no pass for the last level
            g, h = best["left_g"][split], best["left_h"][split]
            self._enter(2 * into, g, h, s, unit)
            self._enter(2 * into + 1, best["g"][split] - g, best["h"][split] - h, s, unit)
            return into[:0]
        return np.stack((2 * into, 2 * into + 1), axis=1).ravel()

    def best_first(self, max_leaves: int) -> None:
        """Only the splits that taking the open leaf of best gain first makes, up to so many leaves."""
        open_, chosen = [(-self.gain[1], 1)] if self.feature[1] >= 0 else [], set()
        while open_ and len(chosen) + 1 < max_leaves:
            _, i = heapq.heappop(open_)
            chosen.add(i)
            for child in (2 * i, 2 * i + 1):
                if self.feature[child] >= 0:
                    heapq.heappush(open_, (-self.gain[child], child))
        for i in range(1, len(self.feature)):
            if i > 1 and i // 2 not in chosen:
                self.feature[i] = _NONE
            elif self.feature[i] >= 0 and i not in chosen:
                self.feature[i] = -1

    def leaves(self) -> int:
        return int((self.feature == -1).sum())


def walk(ways: tuple[np.ndarray, np.ndarray], codes: np.ndarray, levels: int) -> np.ndarray:
    """The heap number at which each row arrives after so many levels, or ends before."""
    feature, following = ways
    at = np.ones(len(codes), np.int64)
    if not codes.size:
        return at
    held, begins = np.ascontiguousarray(codes).ravel(), np.arange(len(codes)) * codes.shape[1]
    for _ in range(levels):
        at = following[at * WIDTH + held[begins + feature[at]]]
    return at


def _weight(g, s: Settings):
    return np.sign(g) * np.maximum(np.abs(g) - s.alpha, 0.0)


def best_splits(hist: np.ndarray, layout: Layout, s: Settings, columns: np.ndarray, unit: float) -> dict:
    """Best split of every node from its histogram (nodes, bins, [gradient, hessian, rows if ``counted``]) in fixed-point units.

    Gain is score(left) + score(right) - score(node) with score T(G)^2 / (H + lambda). Of equal gains the first feature, the
    lowest cut and missing values to the right are taken.
    """
    sums = np.cumsum(hist, axis=1)
    before = np.where(layout.offsets > 0, layout.offsets - 1, 0)
    start = sums[:, before] * (layout.offsets > 0)[None, :, None]
    total = sums[:, layout.missing[0]]
    low = sums[:, layout.place] - start[:, layout.place_feature]
    absent = hist[:, layout.offsets + layout.missing]
    options = [low]
    if absent.any():
        options.append(low + absent[:, layout.place_feature])
    lam = max(s.lam, 1e-12)

    def score(x):
        return _weight(x[..., 0] / unit, s) ** 2 / (x[..., 1] / unit + lam)

    node = score(total)[:, None]
    allowed = np.zeros(len(layout.features), bool)
    allowed[columns] = True
    gains = []
    for left in options:
        right = total[:, None] - left
        fine = allowed[layout.place_feature] & (left[..., 1] >= s.min_hessian * unit) & (right[..., 1] >= s.min_hessian * unit)
        if counted(s):
            fine &= (left[..., 2] >= s.min_rows) & (right[..., 2] >= s.min_rows)
        gains.append(np.where(fine, score(left) + score(right) - node, -np.inf))
    n = np.arange(len(hist))
    if not len(layout.place):
        none = np.zeros(len(hist), np.int64)
        return {"gain": np.full(len(hist), -np.inf), "feature": none - 1, "code": none, "missing_left": none > 0,
                "g": total[:, 0], "h": total[:, 1], "left_g": none, "left_h": none}
    gains = np.stack(gains, axis=2)
    place, way = np.divmod(gains.reshape(len(hist), -1).argmax(axis=1), len(options))
    left = np.stack([o[n, place] for o in options], axis=1)[n, way]
    return {"gain": gains[n, place, way], "feature": layout.place_feature[place], "code": layout.place_code[place], "missing_left": way == 1,
            "g": total[:, 0], "h": total[:, 1], "left_g": left[:, 0], "left_h": left[:, 1]}


def counted(s: Settings) -> bool:
    """Whether splits depend on numbers of rows; a child of positive hessian has a row."""
    return s.min_rows > 1 or s.min_hessian <= 0


def histogram(packed: np.ndarray, node: np.ndarray, n_nodes: int, sums: np.ndarray, layout: Layout, with_rows: bool) -> np.ndarray:
    """(nodes, bins, 2 or 3) integer sums of the rows' gradients and hessians and, if wanted, their numbers.

    Rows come as ``Layout.packed``: features of few bins are added up together, cell by cell, and each gets the sums of its cells.
    """
    out = np.empty((n_nodes, layout.width, 3 if with_rows else 2), np.int64)
    weights = np.ascontiguousarray(sums.T)
    at = np.empty(len(node), np.int64)
    for codes, features, shares in zip(packed, layout.bundles, layout.shares):
        cells = int(np.prod(layout.missing[features] + 1))
        np.multiply(node, cells, out=at)
        at += codes
        for c in range(out.shape[2]):
            cell = np.bincount(at, weights[c] if c < 2 else None, n_nodes * cells).reshape(n_nodes, cells)
            if len(features) == 1:
                own = layout.offsets[features[0]]
                out[:, own: own + cells, c] = cell
            else:  # whole numbers that a double holds, so are their sums
                out[:, layout.bundled[features[0]], c] = cell @ shares
    return out


def gradients(margin: np.ndarray, y: np.ndarray, pos_weight: float, unit: float) -> np.ndarray:
    """Gradient and hessian of the weighted log loss, as whole numbers of 1 / unit."""
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, pos_weight, 1.0)
    return np.rint(np.stack((w * (p - y), np.maximum(w * p * (1 - p), 1e-16)), axis=1) * unit)


def unit_for(rows: int, pos_weight: float) -> float:
    """Fixed-point steps per 1, so that the sum over all rows fits a long."""
    return float(2 ** max(8, min(30, 60 - int(np.ceil(np.log2(max(rows, 1) * max(pos_weight, 1.0) + 1))))))


def sampled(key: np.ndarray, tree: int, s: Settings) -> np.ndarray:
    """Which rows a tree is grown on."""
    if s.subsample >= 1:
        return np.ones(len(key), bool)
    salt = mix(np.array([s.seed * 1_000_003 + tree], np.uint64))
    return (mix(key.view(np.uint64) ^ salt) >> np.uint64(11)) * 2.0 ** -53 < s.subsample


def sampled_columns(n: int, tree: int, s: Settings) -> np.ndarray:
    """Which features a tree may split."""
    return np.sort(np.random.default_rng([s.seed, tree]).permutation(n)[: max(1, int(s.colsample * n))])


def grow(codes: np.ndarray, packed: np.ndarray, sums: np.ndarray, layout: Layout, s: Settings, columns: np.ndarray, unit: float) -> Heap:
    """One tree over rows in memory. Of two children only the one with fewer rows is counted, the other is what is left."""
    tree, ids, sums = Heap(s.depth), np.array([1]), np.ascontiguousarray(sums.T)
    rows, at = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    flat, begins = np.ascontiguousarray(codes).ravel(), rows * codes.shape[1]
    hist = histogram(packed, at, 1, sums.T, layout, counted(s))
    for level in range(max(s.depth, 1)):
        best = best_splits(hist, layout, s, columns, unit)
        children = tree.put(ids, best, level, s, unit)
        if not len(children):
            break
        into = children[::2] // 2
        number = np.full(len(ids), -1)
        number[np.isin(ids, into)] = np.arange(len(into))
        parent = number[at]
        if len(into) < len(ids):
            stays = parent >= 0
            rows, parent = rows[stays], parent[stays]
        f, code = tree.feature[into], np.arange(WIDTH)
        goes_right = ~np.where(code == layout.missing[f][:, None], tree.missing_left[into][:, None], code <= tree.code[into][:, None]).ravel()
        at = 2 * parent + goes_right[parent * WIDTH + flat[begins[rows] + f[parent]]]
        counts = np.bincount(at, minlength=2 * len(into))
        small = 2 * np.arange(len(into)) + (counts[1::2] < counts[::2])
        which = np.full(2 * len(into), -1)
        which[small] = np.arange(len(into))
        own = which[at]
        taken = own >= 0
        some = rows[taken]
        part = histogram(packed.take(some, axis=1), own[taken], len(into), sums.take(some, axis=1).T, layout, counted(s))
        whole = hist[np.isin(ids, into)]
        hist = np.empty((2 * len(into), *whole.shape[1:]), np.int64)
        hist[small], hist[small ^ 1] = part, whole - part
        ids = children
    if s.max_leaves:
        tree.best_first(s.max_leaves)
    return tree


# ------------------------------------------------------------------ the model

class BoostedTrees:
    """A fitted ensemble: the margin of a row is ``base`` plus the leaf values, its probability the logistic of that."""

    def __init__(self, layout: Layout, settings: Settings, base: float, trees: list[Heap]):
        self.layout, self.settings, self.base, self.trees = layout, settings, base, trees

    @property
    def features(self) -> list:
        return self.layout.features

    def prefix(self, n: int) -> "BoostedTrees":
        """The model after its first ``n`` trees."""
        return BoostedTrees(self.layout, replace(self.settings, trees=n), self.base, self.trees[:n])

    def margins(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """The running margin of rows after every tree."""
        codes, margin = self.layout.codes(x), np.full(len(x), self.base)
        for t in self.trees:
            margin = margin + t.value[t.descend(codes, self.layout.missing)]
            yield margin

    def margin(self, x: np.ndarray) -> np.ndarray:
        last = np.full(len(x), self.base)
        for last in self.margins(x):
            pass
        return last

    def probability(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """(kept columns, p): the probability of class 1."""
        keep, shared, n = list(keep or []), df.sparkSession.sparkContext.broadcast(self), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = 1.0 / (1.0 + np.exp(-shared.value.margin(values_of(b, n))))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p)], names=[*keep, "p"])

        rows = matrix(df, self.features, *keep)
        fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema.fields)
        return rows.mapInArrow(run, fields + "p double")

    def staged(self, df: DataFrame, label: str, id_col: str) -> DataFrame:
        """(id, y, iteration, p) after every tree, from one running margin per row."""
        shared, n = df.sparkSession.sparkContext.broadcast(self), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    stages = np.stack(list(shared.value.margins(values_of(part, n)))) if shared.value.trees else np.zeros((0, part.num_rows))
                    k = len(stages)
                    row = np.tile(np.arange(part.num_rows), k)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(pa.array(row)), part.column("y").take(pa.array(row)),
                         pa.array(np.repeat(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(1.0 / (1.0 + np.exp(-stages.ravel())))],
                        names=["id", "y", "iteration", "p"])

        rows = matrix(df.filter(F.col(label).isNotNull()), self.features, F.col(id_col).cast("string").alias("id"), F.col(label).cast("int").alias("y"))
        return rows.mapInArrow(run, "id string, y int, iteration int, p double")

    def importances(self) -> list[float]:
        """Mean gain of each feature's splits, as shares of 1."""
        gain, uses = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(gain, t.feature[inner], t.gain[inner])
            np.add.at(uses, t.feature[inner], 1)
        mean = gain / np.maximum(uses, 1)
        return (mean / mean.sum() if mean.sum() else mean).tolist()

    def about(self) -> str:
        return json.dumps({"features": self.features, "cuts": [c.tolist() for c in self.layout.cuts], "base": self.base,
                           "settings": asdict(self.settings)})

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per tree under ``path``, beside one that describes the model; both as Parquet."""
        rows = [(i, pack(t)) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, nodes binary").write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.about(),)], "about string").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "BoostedTrees":
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        layout = Layout(about["features"], [np.array(c, float) for c in about["cuts"]])
        trees = [unpack(r.nodes) for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]
        return BoostedTrees(layout, Settings(**about["settings"]), about["base"], trees)


def pack(tree: Heap) -> bytes:
    held = io.BytesIO()
    np.savez_compressed(held, **{n: getattr(tree, n) for n in Heap.NAMES})
    return held.getvalue()


def unpack(held: bytes) -> Heap:
    with np.load(io.BytesIO(held)) as arrays:
        tree = Heap(len(arrays["feature"]).bit_length() - 2)
        for n in Heap.NAMES:
            setattr(tree, n, arrays[n])
    return tree


# ------------------------------------------------------------------ many fits at once

@dataclass(frozen=True)
class Fit:
    """Settings, the fold left out (None: none), and after how many trees the rows left out are scored."""
    settings: Settings
    held: int | None = None
    stages: tuple[int, ...] = ()


def _base(y: np.ndarray, s: Settings) -> float:
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
    return float(np.log(share / (1 - share))) if s.from_average else 0.0


_SCORED = "fit int, trees int, id string, y int, margin double"
_OUT = f"{_SCORED}, tree binary"
_BEST = (("gain", float), ("feature", np.int32), ("code", np.int32), ("missing_left", bool), ("g", np.int64), ("h", np.int64),
         ("left_g", np.int64), ("left_h", np.int64))


def _local(layout: Layout, fits: list[Fit], turn: list[int], pos_weight: float, unit: float, with_trees: bool):
    """All trees of one fit, whose rows are in one task: rows (fit, trees, id, y, margin) and, if wanted, (fit, trees, tree)."""
    def run(number: int, ids, key: np.ndarray, y: np.ndarray, fold: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        k = turn[number]
        fit, s = fits[k], fits[k].settings
        packed, learns = layout.packed(codes), fold != fit.held if fit.held is not None else np.ones(len(y), bool)
        margin, left = np.full(len(y), _base(y[learns], s)), np.flatnonzero(~learns)

        def rows(n: int, trees: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, v, np.int32)) for v in (k, trees)] + [
                columns.get(c.split()[0], pa.nulls(n, kind)) for c, kind in zip(_OUT.split(", ")[2:], (pa.string(), pa.int32(), pa.float64(), pa.binary()))],
                names=[c.split()[0] for c in _OUT.split(", ")])

        for t in range(s.trees):
            use = np.flatnonzero(learns & sampled(key, t, s))
            sums = gradients(margin[use], y[use], pos_weight, unit)
            tree = grow(codes[use], packed[:, use], sums, layout, s, sampled_columns(len(layout.features), t, s), unit)
            margin = margin + tree.value[tree.descend(codes, layout.missing)]
            if with_trees:
                yield rows(1, t, tree=pa.array([pack(tree)], pa.binary()))
            if t + 1 in fit.stages:
                yield rows(len(left), t + 1, id=ids.take(pa.array(left)), y=pa.array(y[left]), margin=pa.array(margin[left]))
    return run


def _level_sums(layout: Layout, fits, pos_weight: float, unit: float, wanted: dict, later: dict, growing: dict, tree: int, level: int):
    """One pass over blocks of rows: ((fit, node), hist) of the ``wanted`` nodes of a level, given by fit."""
    def run(blocks: Iterator[tuple]) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
        held: dict[tuple[int, int], np.ndarray] = {}
        now = {k: growing[k].ways(layout.missing) for k in wanted}
        since = {k: [(t.ways(layout.missing), t) for t in later[k]] for k in wanted}
        number = {k: np.full(2 << level, -1) for k in wanted}
        for k, nodes in wanted.items():
            number[k][nodes] = np.arange(len(nodes))
        for _, key, y, fold, codes, packed, margins in blocks:
            for k, nodes in wanted.items():
                fit = fits[k]
                use = sampled(key, tree, fit.settings) & (fold != fit.held if fit.held is not None else True)
                which = number[k][walk(now[k], codes, level)]
                use = np.flatnonzero(use & (which >= 0))
                if not len(use):
                    continue
                which = which[use]
                margin, own = margins[use, k], codes[use] if later[k] else codes
                for ways, t in since[k]:
                    margin = margin + t.value[walk(ways, own, t.depth)]
                hist = histogram(packed[:, use], which, len(nodes), gradients(margin, y[use], pos_weight, unit), layout, counted(fit.settings))
                for i in np.flatnonzero(np.bincount(which)).tolist():
                    name = k, int(nodes[i])
                    held[name] = held[name] + hist[i] if name in held else hist[i]
        return iter(held.items())
    return run


def _block(ids, key: np.ndarray, y: np.ndarray, fold: np.ndarray, codes: np.ndarray, layout: Layout, bases: list[float]) -> tuple:
    """Rows as arrays: (ids or None, key, y, fold, codes, packed codes, margins under each fit)."""
    return ids, key, y, fold, codes, layout.packed(codes), np.tile(np.array(bases, float), (len(key), 1))


def _blocks(rows: DataFrame, layout: Layout, bases: list[float], with_ids: bool, n: int) -> RDD:
    """The rows as blocks of arrays, a partition for every core that the work is enough for and at least one for every ``PART_ROWS`` rows."""
    worth = -(-n * len(bases) // LEAST_ROWS)
    parts = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, worth), -(-n // PART_ROWS))

    def read(r) -> tuple:
        codes = np.frombuffer(bytes(r.codes), np.uint8).reshape(-1, len(layout.features))
        return _block(np.array(r.ids, object) if with_ids else None, np.frombuffer(bytes(r.key), np.int64), np.frombuffer(bytes(r.y), np.int32),
                      np.frombuffer(bytes(r.fold), np.int32), codes, layout, bases)

    return in_blocks(rows.repartition(parts), BLOCK_ROWS // len(bases), with_ids).rdd.map(read)


def _best_of(layout: Layout, fits, unit: float, tree: int):
    """Best split of one node from its summed histogram."""
    def run(found: tuple) -> tuple:
        (k, node), hist = found
        s = fits[k].settings
        return k, node, best_splits(hist[None], layout, s, sampled_columns(len(layout.features), tree, s), unit)
    return run


def _added_up(state: RDD, layout: Layout, fits, pos_weight: float, unit: float, open_: dict, later: dict, growing: dict, known: dict,
              tree: int, level: int) -> dict:
    """(nodes, best splits) of a level by fit, the sums of the blocks added up by the driver.

    ``known`` has the sums of the nodes of the level above, with the child of smaller hessian; afterwards those of this level. Of two
    children with a known parent only that one is counted, the other is what is left.
    """
    wanted = {k: np.array([n for n in nodes.tolist() if (k, n // 2) not in known or known[k, n // 2][1] == n], np.int64) for k, nodes in open_.items()}
    sums: dict[tuple[int, int], np.ndarray] = {}
    for name, hist in state.mapPartitions(_level_sums(layout, fits, pos_weight, unit, wanted, later, growing, tree, level), True).collect():
        sums[name] = sums[name] + hist if name in sums else hist  # a row per block, fit and node
    out = {}
    for k, nodes in open_.items():
        s, counted_nodes = fits[k].settings, set(wanted[k].tolist())
        none = np.zeros((layout.width, 3 if counted(s) else 2), np.int64)
        own = [sums.get((k, n), none) if n in counted_nodes else known[k, n // 2][0] - sums.get((k, n ^ 1), none) for n in nodes.tolist()]
        best = best_splits(np.stack(own), layout, s, sampled_columns(len(layout.features), tree, s), unit)
        for name in [name for name in known if name[0] == k]:
            del known[name]
        small = 2 * nodes + (2 * best["left_h"] > best["h"])
        known.update({(k, n): (hist, child) for n, hist, child in zip(nodes.tolist(), own, small.tolist())})
        out[k] = nodes, best
    return out


def _added_up_by_node(state: RDD, layout: Layout, fits, pos_weight: float, unit: float, open_: dict, later: dict, growing: dict,
                      tree: int, level: int) -> dict:
    """(nodes, best splits) of a level by fit, the sums of the blocks added up by Spark."""
    sums = state.mapPartitions(_level_sums(layout, fits, pos_weight, unit, open_, later, growing, tree, level), True)
    tasks = min(state.context.defaultParallelism, -(-sum(map(len, open_.values())) // NODES_PER_TASK))
    found: dict[int, list] = {k: [] for k in open_}
    for k, node, best in sums.reduceByKey(np.add, tasks).map(_best_of(layout, fits, unit, tree)).collect():  # a row per fit and node
        found[k].append((node, best))
    out = {}
    for k, each in found.items():
        own = sorted(each, key=lambda f: f[0])
        best = {c: np.concatenate([b[c] for _, b in own]).astype(t) if own else np.zeros(0, t) for c, t in _BEST}
        out[k] = np.array([node for node, _ in own], np.int64), best
    return out


def _with_margins(layout: Layout, later: dict):
    """A block with its margins brought up to date."""
    def run(block: tuple) -> tuple:
        codes, margins = block[4], block[-1].copy()
        for k, trees in later.items():
            for t in trees:
                margins[:, k] += t.value[t.descend(codes, layout.missing)]
        return *block[:-1], margins
    return run


def _left_out(fits, staged: list[int], trees: int):
    """(fit, trees, id, y, margin) of the rows of a block that the fits leave out."""
    def run(block: tuple) -> Iterator[tuple]:
        ids, _, y, fold, _, _, margins = block
        for k in staged:
            left = np.flatnonzero(fold == fits[k].held)
            yield from zip([k] * len(left), [trees] * len(left), ids[left].tolist(), y[left].tolist(), margins[left, k].tolist())
    return run


def _by_levels(rows: DataFrame, layout: Layout, fits: list[Fit], pos_weight: float, unit: float, n: int) -> tuple[list[list[Heap]], DataFrame | None]:
    """The trees of all fits, a pass over the rows per level; the scores of rows left out as (fit, trees, id, y, margin).

    The executors keep the rows as blocks of arrays from pass to pass, in memory or on their disks, so a pass is one small
    stage, histograms of every block, or two: their sums by node with the best split of each.
    """
    spark, bases = rows.sparkSession, []
    ensure_checkpoint_dir(spark)
    for fit in fits:
        own = rows.filter(F.col("fold") != fit.held) if fit.held is not None else rows
        share = own.agg(F.avg("y")).first()[0] if fit.settings.from_average else None
        bases.append(_base(np.array([share]), fit.settings) if share is not None else 0.0)
    state = _blocks(rows, layout, bases, any(f.stages for f in fits), n).persist(StorageLevel.MEMORY_AND_DISK)
    state.checkpoint()  # tasks are sent with the lineage of what they read: without the steps up to here
    state.foreachPartition(lambda blocks: None)
    parts = state.getNumPartitions()
    done: list[list[Heap]] = [[] for _ in fits]
    later: dict[int, list[Heap]] = {k: [] for k in range(len(fits))}
    scored, refreshed, held_before = [], 0, []
    for tree in range(max(f.settings.trees for f in fits)):
        alive = [k for k, f in enumerate(fits) if tree < f.settings.trees]
        growing = {k: Heap(fits[k].settings.depth) for k in alive}
        open_ = {k: np.array([1]) for k in alive}
        known: dict[tuple[int, int], np.ndarray] = {}
        for level in range(max(1, *(fits[k].settings.depth for k in alive))):
            todo = [k for k in alive if len(open_[k])]
            while todo:
                jobs, held = [], 0
                while todo and (not jobs or held < HELD_BYTES):
                    jobs.append(todo.pop(0))
                    held += len(open_[jobs[-1]]) * layout.width * 24
                if held * parts <= DRIVER_BYTES:
                    found = _added_up(state, layout, fits, pos_weight, unit, {k: open_[k] for k in jobs}, later, growing, known, tree, level)
                else:
                    found = _added_up_by_node(state, layout, fits, pos_weight, unit, {k: open_[k] for k in jobs}, later, growing, tree, level)
                    known = {name: h for name, h in known.items() if name[0] not in jobs}
                while held_before:  # the pass has worked out the blocks that replace them
                    held_before.pop().unpersist()
                for k, (nodes, best) in found.items():
                    open_[k] = growing[k].put(nodes, best, level, fits[k].settings, unit)
        for k in alive:
            if fits[k].settings.max_leaves:
                growing[k].best_first(fits[k].settings.max_leaves)
            done[k].append(growing[k])
            later[k].append(growing[k])
        staged = [k for k in alive if tree + 1 in fits[k].stages]
        if staged or (tree + 1) % REFRESH == 0:
            held_before.append(state)
            state = state.map(_with_margins(layout, later), True).persist(StorageLevel.MEMORY_AND_DISK)
            refreshed += 1
            if refreshed % KEPT_STEPS == 0:
                state.checkpoint()
                state.foreachPartition(lambda blocks: None)
            later = {k: [] for k in later}
        if staged:
            scored.append(materialize(spark.createDataFrame(state.flatMap(_left_out(fits, staged, tree + 1)), _SCORED), "left-out"))
    for blocks in (*held_before, state):
        blocks.unpersist()
    out = scored[0] if scored else None
    for more in scored[1:]:
        out = out.unionByName(more)
    return done, out


def train(rows: DataFrame, layout: Layout, fits: list[Fit], pos_weight: float, with_trees: bool = True,
          local_rows: int | None = None) -> tuple[list[BoostedTrees], DataFrame | None]:
    """All fits over ``binned`` rows: their models (if wanted), and (fit, trees, id, y, margin) of the rows left out."""
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    n = rows.count()
    unit = unit_for(n, pos_weight)
    if n > local_rows:
        done, scored = _by_levels(rows, layout, fits, pos_weight, unit, n)
    else:
        # a task per fit, those of most work first
        turn = sorted(range(len(fits)), key=lambda k: -fits[k].settings.trees * (fits[k].settings.depth + 2))
        out = materialize(dealt(rows, len(fits), any(f.stages for f in fits), _local(layout, fits, turn, pos_weight, unit, with_trees), _OUT), "boosting")
        done = [[] for _ in fits]
        for r in out.filter("tree is not null").orderBy("fit", "trees").select("fit", "tree").collect() if with_trees else ():
            done[r.fit].append(unpack(r.tree))
        scored = out.filter("tree is null").drop("tree") if any(f.stages for f in fits) else None
    models = []
    for fit, trees in zip(fits, done) if with_trees else ():
        own = rows.filter(F.col("fold") != fit.held) if fit.held is not None else rows
        share = own.agg(F.avg("y")).first()[0] if fit.settings.from_average else None
        models.append(BoostedTrees(layout, fit.settings, _base(np.array([share]), fit.settings) if share is not None else 0.0, trees))
    return models, scored


def class_ratio(df: DataFrame, label: str) -> float:
    """Negatives per positive: the weight of class 1."""
    r = df.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    return r["neg"] / max(r["pos"], 1)


def fit(df: DataFrame, features: list[str], settings: Settings = SECOND_ORDER, label: str = "label", id_col: str = S.ID_COLUMN,
        local_rows: int | None = None) -> BoostedTrees:
    """One model over all rows of ``df`` that have a label; class 1 weighs negatives per positive."""
    layout = Layout.fit(df, features)
    rows = materialize(binned(df, layout, label, id_col), "binned")
    return train(rows, layout, [Fit(settings)], class_ratio(df, label), local_rows=local_rows)[0][0]


def evaluation_curve(model: BoostedTrees, df: DataFrame, label: str = "label", id_col: str = S.ID_COLUMN) -> DataFrame:
    """(iteration, log_loss, roc_auc) over the rows of ``df`` after every tree."""
    from churnlake.operators.evaluate import roc_auc
    rows = materialize(model.staged(df, label, id_col), "staged")
    p = F.least(F.greatest("p", F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = rows.groupBy("iteration").agg(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))
    return loss.join(roc_auc(rows, by="iteration"), "iteration")


def root_splits(df: DataFrame, features: list[str], settings: Settings = SECOND_ORDER, label: str = "label") -> DataFrame:
    """(feature, threshold, gain, left_gradient, left_hessian): the best first split of each feature, before any tree.

    The sums of all bins are taken in one pass, as for a level of a tree.
    """
    layout, weight = Layout.fit(df, features), class_ratio(df, label)
    rows = materialize(binned(df, layout, label, S.ID_COLUMN), "binned")
    n = rows.count()
    unit = unit_for(n, weight)
    fits = [Fit(replace(settings, subsample=1.0, colsample=1.0))]

    def per_feature(found: tuple) -> list[tuple]:
        hist, out = found[1][None], []
        for j, name in enumerate(features):
            best = best_splits(hist, layout, fits[0].settings, np.array([j]), unit)
            code, at = int(best["code"][0]), int(layout.offsets[j])
            if np.isfinite(best["gain"][0]) and code < len(layout.cuts[j]):
                low = hist[0, at: at + code + 1].sum(axis=0) / unit
                out.append((name, float(layout.cuts[j][code]), float(best["gain"][0]), float(low[0]), float(low[1])))
        return out

    sums = _blocks(rows, layout, [0.0], False, n).mapPartitions(_level_sums(layout, fits, weight, unit, {0: np.array([1])}, {0: []}, {0: Heap(0)}, 0, 0))
    return rows.sparkSession.createDataFrame(sums.reduceByKey(np.add, 1).flatMap(per_feature),
                                             "feature string, threshold double, gain double, left_gradient double, left_hessian double")
