"""Random forest of unlimited depth (M2, M6): large nodes split in passes over all rows, small ones grown to purity in one group.

Rows are binned (``bins``). A tree draws each row by a Poisson weight and each node its features, both by hashes of (row key or
node, tree), so any task can work them out alone; sums are whole numbers, so the partitioning cannot change a tree.

A node of more than ``LOCAL_ROWS`` rows is split by the sums of a pass over all rows, taken for all such nodes of several trees
together; only best splits reach the driver. As soon as a node has fewer rows, these are dealt to one Arrow group,
which grows the rest of the tree until leaves are pure or too small to split, however deep that is. Trees of a small table
start there: one group each.

The nodes of a forest of unlimited depth grow with its rows. A small forest is held by the driver (``RandomForest``); of a larger one
the driver has the trees' tops alone, the subtrees below stay in the shared folder (``StoredForest``), and rows to be scored are dealt to them.

Split search is that of the usual forests: Gini impurity, the best cut of a few features drawn for the node; if none of
these can be cut, further ones in drawn order up to the first that can. Cuts of no gain count, so leaves do get pure. Missing values go
right.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.operators.bins import Layout, binned, dealt, in_blocks, matrix, mix, unpacked, values_of
from churnlake.session import materialize

LOCAL_ROWS = 250_000
#: Rows that the groups of one job hold together; trees are grown in batches of so many.
JOB_ROWS = 50_000_000
#: Rows times trees of a forest that the driver holds whole; of larger ones it holds the tops.
HELD_DRAWS = 5_000_000
#: Nodes whose histograms are held at once.
NODES_AT_ONCE = 4096
WIDTH = 256
UNIT = 1 << 20


@dataclass(frozen=True)
class Settings:
    """The fixed preset by default. ``max_depth`` None: no limit."""
    trees: int = 200
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: str = "sqrt"
    balanced: bool = False
    seed: int = S.SEED

    def drawn(self, n: int) -> int:
        return max(1, int(math.sqrt(n) if self.features == "sqrt" else math.log2(n)))


class Nodes:
    """A tree as arrays; children of -1 mark a leaf. A value is the weighted share of class 1."""
    NAMES = ("left", "right", "feature", "code", "value", "cover", "gain")

    def __init__(self, **arrays):
        for n in self.NAMES:
            setattr(self, n, arrays[n])

    def descend(self, codes: np.ndarray, some: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row, or of ``some`` by their numbers."""
        some = np.arange(len(codes)) if some is None else some
        out = np.zeros(len(some), np.int64)
        if not len(some) or self.left[0] < 0:
            return out
        flat, child = np.ascontiguousarray(codes).ravel(), np.stack((self.right, self.left), axis=1).ravel()
        rows, begins, at = np.arange(len(some)), some * codes.shape[1], out
        while len(rows):  # those that have not come to a leaf
            at = child[2 * at + (flat[begins + self.feature[at]] <= self.code[at])]
            out[rows] = at
            goes_on = self.left[at] >= 0
            rows, begins, at = rows[goes_on], begins[goes_on], at[goes_on]
        return out

    def depth(self) -> int:
        deep = np.zeros(len(self.left), int)
        for i in range(len(self.left)):  # children stand behind their parents
            if self.left[i] >= 0:
                deep[[self.left[i], self.right[i]]] = deep[i] + 1
        return int(deep.max(initial=0))


def drawn_weights(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson with mean 1."""
    salt = mix(np.array([seed * 2_000_003 + tree], np.uint64))
    u = (mix(key.view(np.uint64) ^ salt) >> np.uint64(11)) * 2.0 ** -53
    return np.searchsorted(_POISSON, u, "right")


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def feature_order(names: np.ndarray, tree: int, n: int, seed: int, first: int | None = None) -> np.ndarray:
    """The order in which each node (by its name, a hash of the path to it) draws the features, or the ``first`` of it."""
    salt = mix(np.array([seed * 3_000_017 + tree], np.uint64))
    drawn = mix(mix(names ^ salt)[:, None] + np.arange(n, dtype=np.uint64))  # all different: ``mix`` maps no two numbers to one
    if first is None or first >= n:
        return np.argsort(drawn, axis=1, kind="stable")
    some = np.argpartition(drawn, first, axis=1)[:, :first]
    return np.take_along_axis(some, np.argsort(np.take_along_axis(drawn, some, axis=1), axis=1), axis=1)


def child_names(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(names * np.uint64(2)), mix(names * np.uint64(2) + np.uint64(1))


ROOT = np.uint64(1)


def histogram(codes: np.ndarray, node: np.ndarray, chosen: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(nodes, chosen features, codes, [class 1, weight, rows]) of rows by their node."""
    m, k = chosen.shape
    at = ((node[:, None] * k + np.arange(k)) * WIDTH + codes[np.arange(len(codes))[:, None], chosen[node]]).ravel()
    out = np.empty((m * k * WIDTH, 3), np.int64)
    for c in range(2):
        out[:, c] = np.bincount(at, np.repeat(sums[:, c], k), m * k * WIDTH)
    out[:, 2] = np.bincount(at, minlength=m * k * WIDTH)
    return out.reshape(m, k, WIDTH, 3)


def best_cuts(hist: np.ndarray, s: Settings, in_turn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, nth feature, code) per node; gain is -inf where nothing can be cut.

    ``in_turn`` takes the first feature that can be cut at all, otherwise the best of all.
    """
    left = np.cumsum(hist, axis=2)
    total = left[:, :1, -1:]
    right = total - left
    fine = (left[..., 2] >= s.min_leaf) & (right[..., 2] >= s.min_leaf)
    with np.errstate(divide="ignore", invalid="ignore"):
        score = lambda x: np.where(x[..., 1] > 0, (x[..., 0] / UNIT) ** 2 / (x[..., 1] / UNIT), 0.0)
        gain = np.where(fine, 2 * (score(left) + score(right) - score(total)), -np.inf)
    m, k, width = gain.shape
    if in_turn:
        able = np.isfinite(gain).any(axis=2)
        nth = able.argmax(axis=1)
        code = gain[np.arange(m), nth].argmax(axis=1)
    else:
        nth, code = np.divmod(gain.reshape(m, -1).argmax(axis=1), width)
    return gain[np.arange(m), nth, code], nth, code


def best_cuts_of_rows(codes: np.ndarray, node: np.ndarray, chosen: np.ndarray, sums: np.ndarray, s: Settings, in_turn: bool):
    """``best_cuts`` of rows sorted by their node: the same cuts, from the cells that features and nodes can have."""
    widths, flat = codes.max(axis=0, initial=0).astype(np.int64) + 1, np.ascontiguousarray(codes).ravel()
    return _best_cuts_of(flat, np.arange(len(codes)) * codes.shape[1], node, chosen, widths, sums[:, 0], sums[:, 1], s, in_turn)


#: Codes that are counted in cells of their own, however few rows a node has.
NARROW = 16
#: Codes of rows that are looked at together, so that they stay in a core's cache.
AT_ONCE = 40_000


def _best_cuts_of(flat: np.ndarray, begins: np.ndarray, node: np.ndarray, chosen: np.ndarray, widths: np.ndarray, one: np.ndarray,
                  weight: np.ndarray, s: Settings, in_turn: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gain, nth feature, code) per node, of rows that begin at such places of the codes, by the features that their nodes have drawn."""
    m, k = chosen.shape
    gain, code, counts = np.empty((k, m)), np.empty((k, m), np.int64), np.bincount(node, minlength=m)
    columns = [one, weight] + ([np.ones(len(node))] if s.min_leaf != 1 else [])
    step = max(1, AT_ONCE // max(len(node), 1))
    for lo in range(0, k, step):
        features = chosen[:, lo: lo + step].T
        seen = flat[begins + features.take(node, axis=1)]
        gain[lo: lo + step], code[lo: lo + step] = _best_cut_of_each(seen, node, counts, widths[features], columns, s)
    nth, n = (np.isfinite(gain) if in_turn else gain).argmax(axis=0), np.arange(m)
    return gain[nth, n], nth, code[nth, n]


def _best_cut_of_each(seen: np.ndarray, node: np.ndarray, counts: np.ndarray, sizes: np.ndarray, columns: list, s: Settings):
    """(gain, code) of the best cut of each (feature, node), from the codes that the nodes' rows have of these features.

    There is a cell for each of the ``sizes`` codes, or, where these are many more than the node's rows, for those that occur.
    """
    k, m = sizes.shape
    gain, code, size = np.full(k * m, -np.inf), np.zeros(k * m, np.int64), sizes.ravel()
    dense = (sizes <= np.maximum(NARROW, 2 * counts)).ravel()
    some = np.flatnonzero(dense)
    if len(some):
        begins = np.cumsum(size[some]) - size[some]
        place = np.full(k * m, -WIDTH)
        place[some] = begins
        at, n_cells = (place.reshape(k, m).take(node, axis=1) + seen).ravel(), int(size[some].sum())
        if len(some) == k * m:
            cells = [np.bincount(at, c if k == 1 else np.tile(c, k), n_cells) for c in columns]
        else:
            own = np.flatnonzero(at >= 0)
            row, at = own % len(node), at[own]
            cells = [np.bincount(at, c[row], n_cells) for c in columns]
        gain[some], best = _best_of_cells(cells, begins, s)
        code[some] = best - begins
    if len(some) < k * m:
        own = np.flatnonzero(~dense.reshape(k, m).take(node, axis=1).ravel())
        row = own % len(node)
        at = (own // len(node) * m + node[row]) * WIDTH + seen.ravel()[own]
        by = np.argsort(at)
        at, row = at[by], row[by]
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        at = at[starts]
        begins = np.flatnonzero(np.concatenate(([True], at[1:] // WIDTH != at[:-1] // WIDTH)))
        some = at[begins] // WIDTH
        gain[some], best = _best_of_cells([np.add.reduceat(c[row], starts) for c in columns], begins, s)
        code[some] = at[best] % WIDTH
    return gain.reshape(k, m), code.reshape(k, m)


def _best_of_cells(cells: list[np.ndarray], begins: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Gain of the best cut of each run of cells (class 1, weight and, if leaves must have several, rows), and the cell that it is behind."""
    which = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(cells[0]))))
    left, right, total = [], [], []
    for c in cells:
        running = np.cumsum(c)
        start = running[begins] - c[begins]
        whole = np.append(running[begins[1:] - 1], running[-1]) - start
        left.append(running - start[which])
        right.append(whole[which] - left[-1])
        total.append(whole)
    least = s.min_leaf if len(cells) > 2 else 1  # where one row is enough, its weight tells that it is there
    fine = (left[-1] >= least) & (right[-1] >= least)

    def score(x):
        return np.where(x[1] > 0, (x[0] / UNIT) ** 2 / (x[1] / UNIT), 0.0)

    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(fine, 2 * (score(left) + score(right) - score(total)[which]), -np.inf)
    top = np.maximum.reduceat(gain, begins)
    return top, np.minimum.reduceat(np.where(gain == top[which], np.arange(len(gain)), len(gain)), begins)


def _not_constant(codes: np.ndarray, node: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features in the order given, those first of which the node's rows (sorted by node) have two codes; and how many these are."""
    begins = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    varies = np.take_along_axis(np.maximum.reduceat(codes, begins) > np.minimum.reduceat(codes, begins), order, axis=1)
    return np.take_along_axis(order, np.argsort(~varies, axis=1, kind="stable"), axis=1), varies.sum(axis=1)


def _split_all(codes: np.ndarray, widths: np.ndarray, rows: np.ndarray, node: np.ndarray, one: np.ndarray, weight: np.ndarray, names, tree, s: Settings):
    """Best cut (gain, feature, code) of nodes given by their rows, sorted by node; -inf where none."""
    n_features, flat = len(widths), codes.ravel()
    gain, feature, code = np.full(len(names), -np.inf), np.zeros(len(names), int), np.zeros(len(names), int)
    edges = np.searchsorted(node, np.arange(0, len(names) + NODES_AT_ONCE, NODES_AT_ONCE))
    k = min(s.drawn(n_features), n_features)
    for lo, a, b in zip(range(0, len(names), NODES_AT_ONCE), edges[:-1], edges[1:]):
        part = slice(lo, min(lo + NODES_AT_ONCE, len(names)))
        chosen = feature_order(names[part], tree, n_features, s.seed, k)
        own, begins, ones, weights = node[a:b] - lo, rows[a:b] * n_features, one[a:b], weight[a:b]
        g, nth, c = _best_cuts_of(flat, begins, own, chosen, widths, ones, weights, s, False)
        gain[part], feature[part], code[part] = g, chosen[np.arange(len(chosen)), nth], c
        # none of the features drawn can be cut: go on in drawn order
        stuck = np.flatnonzero(~np.isfinite(g))
        if not len(stuck):
            continue
        number = np.full(len(chosen), -1)
        number[stuck] = np.arange(len(stuck))
        keep = number[own] >= 0
        own, begins, ones, weights = number[own[keep]], begins[keep], ones[keep], weights[keep]
        order, tried = _not_constant(codes[rows[a:b][keep]], own, feature_order(names[part][stuck], tree, n_features, s.seed)[:, k:])
        step = 1 if s.min_leaf == 1 else max(1, k)
        for lo2 in range(0, n_features - k, step):
            left = tried > lo2  # the others have no further feature of two codes
            if not left.all():
                number = np.where(left, np.cumsum(left) - 1, -1)
                stuck, order, tried, keep = stuck[left], order[left], tried[left], left[own]
                own, begins, ones, weights = number[own[keep]], begins[keep], ones[keep], weights[keep]
            if not len(stuck):
                break
            some = order[:, lo2: lo2 + step]
            g, nth, c = _best_cuts_of(flat, begins, own, some, widths, ones, weights, s, True)
            gain[lo + stuck], feature[lo + stuck], code[lo + stuck] = g, some[np.arange(len(some)), nth], c
            tried = np.where(np.isfinite(g), 0, tried)
    return gain, feature, code


def grow(codes: np.ndarray, sums: np.ndarray, tree: int, s: Settings, name: np.uint64 = ROOT, depth: int = 0) -> Nodes:
    """A (sub)tree over rows in memory, grown until its leaves are pure or may not be split."""
    n_features, out = codes.shape[1], {n: [] for n in Nodes.NAMES}
    codes, widths = np.ascontiguousarray(codes), codes.max(axis=0, initial=0).astype(np.int64) + 1
    flat, rows, one, weight = codes.ravel(), np.arange(len(codes)), sums[:, 0], sums[:, 1]
    at, names, base = np.zeros(len(codes), np.int64), np.array([name], np.uint64), 0  # rows are sorted by their node
    while len(names):
        m = len(names)
        ones, weights = (np.bincount(at, c, m) for c in (one, weight))
        count = np.bincount(at, minlength=m)
        may = (count >= max(s.min_split, 2, 2 * s.min_leaf)) & (ones > 0) & (ones < weights)
        if s.max_depth is not None and depth >= s.max_depth:
            may[:] = False
        gain, feature, code = np.full(m, -np.inf), np.zeros(m, int), np.zeros(m, int)
        if may.any():
            stays = may[at]
            rows, one, weight, at = rows[stays], one[stays], weight[stays], at[stays]
            number = np.cumsum(may) - 1
            gain[may], feature[may], code[may] = _split_all(codes, widths, rows, number[at], one, weight, names[may], tree, s)
        split = np.isfinite(gain)
        place = np.cumsum(split) - 1
        left = np.where(split, base + m + 2 * place, -1)
        for key, value in zip(Nodes.NAMES, (left, np.where(split, left + 1, -1), np.where(split, feature, -1), code,
                                            np.divide(ones, weights, out=np.zeros(m), where=weights > 0), weights / UNIT, np.where(split, gain, 0.0))):
            out[key].append(value)
        if not split.any():
            break
        stays = split[at]
        rows, one, weight, at = rows[stays], one[stays], weight[stays], at[stays]
        at = 2 * place[at] + (flat[rows * n_features + feature[at]] > code[at])
        order = np.argsort(at, kind="stable")
        rows, one, weight, at = rows[order], one[order], weight[order], at[order]
        names = np.stack(child_names(names[split]), axis=1).ravel()
        base, depth = base + m, depth + 1
    return Nodes(**{k: np.concatenate(v) for k, v in out.items()})


def _sums(key: np.ndarray, y: np.ndarray, tree: int, s: Settings, weights: tuple[float, float]) -> np.ndarray:
    """(class 1, weight) of rows as a tree draws them, in whole numbers; rows it does not draw have weight 0."""
    return _weighted(drawn_weights(key, tree, s.seed), y, weights)


def _weighted(drawn: np.ndarray, y: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    w = drawn * np.rint(np.where(y == 1, weights[1], weights[0]) * UNIT)
    return np.stack((w * (y == 1), w), axis=1)


# ------------------------------------------------------------------ the model

class RandomForest:
    """A fitted forest: the probability of a row is the mean of its leaves' shares."""

    def __init__(self, layout: Layout, settings: Settings, trees: list[Nodes]):
        self.layout, self.settings, self.trees = layout, settings, trees

    @property
    def features(self) -> list:
        return self.layout.features

    def predict(self, codes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(codes))
        for t in self.trees:
            total += t.value[t.descend(codes)]
        return total / max(len(self.trees), 1)

    def probability(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """(kept columns, p): the probability of class 1."""
        keep, layout, n = list(keep or []), self.layout, len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = layout.codes(values_of(b, n))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([r.tobytes() for r in codes], pa.binary())],
                                                 names=[*keep, "codes"])

        rows = matrix(df, self.features, *keep)
        return self.probability_of_codes(rows.mapInArrow(run, _fields(rows, keep) + "codes binary"), keep)

    def probability_of_codes(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """(kept columns, p) of rows that are binned already."""
        shared, n = rows.sparkSession.sparkContext.broadcast(self), len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = shared.value.predict(unpacked(b.column("codes"), n))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(p)], names=[*keep, "p"])

        return rows.mapInArrow(run, _fields(rows, keep) + "p double")

    def facts(self) -> list["Facts"]:
        """What splits and leaves of each tree add up to."""
        return [Facts.of(t, len(self.features)) for t in self.trees]

    def importances(self) -> list[float]:
        """Impurity decrease of each feature's splits: shares of 1 in every tree, averaged over the trees."""
        total = np.zeros(len(self.features))
        for f in self.facts():
            total += f.gains / f.gains.sum() if f.gains.sum() > 0 else 0.0
        return (total / total.sum() if total.sum() else total).tolist()

    def about(self) -> str:
        return json.dumps({"features": self.features, "cuts": [c.tolist() for c in self.layout.cuts], "settings": asdict(self.settings)})

    def save(self, spark: SparkSession, path: str) -> None:
        """A row per tree under ``path``, beside one that describes the model; both as Parquet."""
        spark.createDataFrame([(i, pack(t)) for i, t in enumerate(self.trees)], "tree int, nodes binary").write.mode(
            "overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.about(),)], "about string").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "RandomForest":
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        if about.get("stored"):
            return StoredForest.load(spark, path)
        layout = Layout(about["features"], [np.array(c, float) for c in about["cuts"]])
        trees = [unpack(r.nodes) for r in spark.read.parquet(f"{path}/trees").orderBy("tree").collect()]
        return RandomForest(layout, Settings(**about["settings"]), trees)


_KINDS = (np.int32, np.int32, np.int16, np.int16, np.float64, np.float64, np.float64)


def pack(tree: Nodes) -> bytes:
    held = io.BytesIO()
    np.savez_compressed(held, **{n: getattr(tree, n).astype(k) for n, k in zip(Nodes.NAMES, _KINDS)})
    return held.getvalue()


def unpack(held: bytes) -> Nodes:
    with np.load(io.BytesIO(held)) as arrays:
        return Nodes(**{n: arrays[n].astype(np.int64) if arrays[n].dtype.kind == "i" else arrays[n] for n in Nodes.NAMES})


def _fields(rows: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema.fields)


@dataclass(frozen=True)
class Facts:
    """Gains of a tree's splits by feature, and the impurity of its root and of its leaves."""
    gains: np.ndarray
    root: float
    leaves: float
    splits: int

    @staticmethod
    def of(t: Nodes, n_features: int) -> "Facts":
        inner = t.left >= 0
        impurity = np.where(t.cover == _STUB, 0.0, 2 * t.cover * t.value * (1 - t.value))
        return Facts(np.bincount(t.feature[inner], t.gain[inner], n_features), float(impurity[0]), float(impurity[~inner].sum()), int(inner.sum()))


_STUB = -1.0


def stub() -> Nodes:
    """The top of a tree that is one subtree."""
    return Nodes(**{n: np.array([v]) for n, v in zip(Nodes.NAMES, (-1, -1, -1, 0, 0.0, _STUB, 0.0))})


class StoredForest(RandomForest):
    """A forest whose subtrees are rows (tree, node, nodes) of a stored table, each below a stub of its tree's top."""

    def __init__(self, layout: Layout, settings: Settings, tops: list[Nodes], parts: DataFrame):
        self.layout, self.settings, self.tops, self.parts = layout, settings, tops, parts

    @property
    def trees(self) -> list[Nodes]:
        """The whole trees; only for a forest that the driver can hold."""
        below: dict = {t: {} for t in range(len(self.tops))}
        for r in self.parts.collect():
            below[r.tree][r.node] = unpack(r.nodes)
        return [_joined(_closed(top), below[t]) for t, top in enumerate(self.tops)]

    def probability_of_codes(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """(kept columns, p): rows go to the subtrees that they fall into, and the leaves' shares back to the rows.

        What moves is packed: a batch of rows is one record for each subtree that it reaches, and one with the shares on the way back.
        """
        numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
        tops, n, n_trees = numbered.sparkSession.sparkContext.broadcast(self.tops), len(self.features), max(len(self.tops), 1)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes, row = unpacked(b.column("codes"), n), b.column("_row").to_numpy()
                if not len(row):
                    continue
                for t, top in enumerate(tops.value):
                    nodes, packs = _packs(top.descend(codes), (row, codes))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), pa.array([int(row[0])] * len(nodes), pa.int64()), *packs],
                        names=["tree", "node", "chunk", "rows", "codes"])

        def vote(sent: pa.Table, held: pa.Table) -> pa.Table:
            values = []
            if sent.num_rows:
                tree, node = sent.column("tree")[0].as_py(), sent.column("node")[0].as_py()
                grown = unpack(held.column("nodes")[0].as_py()) if held.num_rows else None
                for c in sent.column("codes").to_pylist():
                    codes = np.frombuffer(c, np.uint8).reshape(-1, n)
                    share = np.full(len(codes), tops.value[tree].value[node]) if grown is None else grown.value[grown.descend(codes)]
                    values.append(share.astype(np.float64).tobytes())
            return pa.table({"chunk": sent.column("chunk"), "tree": sent.column("tree"), "rows": sent.column("rows"),
                             "shares": pa.array(values, pa.binary())})

        def mean(table: pa.Table) -> pa.Table:
            """The rows of a batch, their shares added up in the order of the trees."""
            rows = [np.frombuffer(r, np.int64) for r in table.column("rows").to_pylist()]
            shares = [np.frombuffer(v, np.float64) for v in table.column("shares").to_pylist()]
            names = np.unique(np.concatenate(rows))
            total = np.zeros(len(names))
            for i in np.argsort(table.column("tree").to_numpy(), kind="stable"):
                total[np.searchsorted(names, rows[i])] += shares[i]  # a row is once in each tree
            return pa.table({"_row": pa.array(names), "p": pa.array(total / n_trees)})

        sent = numbered.select("_row", "codes").mapInArrow(placed, "tree int, node int, chunk long, rows binary, codes binary")
        votes = sent.groupBy("tree", "node").cogroup(self.parts.groupBy("tree", "node")).applyInArrow(
            vote, "chunk long, tree int, rows binary, shares binary")
        scores = votes.groupBy("chunk").applyInArrow(mean, "_row long, p double")
        return numbered.select("_row", *keep).join(scores, "_row").select(*keep, "p")

    def facts(self) -> list[Facts]:
        n = len(self.features)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [Facts.of(unpack(x), n) for x in b.column("nodes").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("tree"), b.column("node"), pa.array([f.gains.tolist() for f in found], pa.list_(pa.float64())),
                                                  pa.array([f.root for f in found], pa.float64()), pa.array([f.leaves for f in found], pa.float64()),
                                                  pa.array([f.splits for f in found], pa.int64())],
                                                 names=["tree", "node", "gains", "root", "leaves", "splits"])

        each = self.parts.mapInArrow(run, "tree int, node int, gains array<double>, root double, leaves double, splits long")
        sums = each.groupBy("tree").agg(*(F.sum(F.col("gains")[j]).alias(f"g{j}") for j in range(n)),
                                        F.sum(F.when(F.col("node") == 0, F.col("root"))).alias("root"), F.sum("leaves").alias("leaves"),
                                        F.sum("splits").alias("splits"))
        below, out = {r.tree: r for r in sums.collect()}, []  # a row per tree
        for t, top in enumerate(self.tops):
            f, r = Facts.of(top, n), below.get(t)
            out.append(f if r is None else Facts(f.gains + np.array([r[f"g{j}"] for j in range(n)]), r.root if r.root is not None else f.root,
                                                 f.leaves + r.leaves, f.splits + r.splits))
        return out

    def about(self) -> str:
        return json.dumps(json.loads(super().about()) | {"stored": True})

    def save(self, spark: SparkSession, path: str) -> None:
        self.parts.write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(t, pack(top)) for t, top in enumerate(self.tops)], "tree int, nodes binary").write.mode(
            "overwrite").parquet(f"{path}/tops")
        spark.createDataFrame([(self.about(),)], "about string").write.mode("overwrite").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "StoredForest":
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        layout = Layout(about["features"], [np.array(c, float) for c in about["cuts"]])
        tops = [unpack(r.nodes) for r in spark.read.parquet(f"{path}/tops").orderBy("tree").collect()]
        return StoredForest(layout, Settings(**about["settings"]), tops, spark.read.parquet(f"{path}/trees"))


def _packs(at: np.ndarray, arrays: tuple) -> tuple[list, list]:
    """The nodes that occur in ``at``, and for each array the bytes of its rows by node."""
    by = np.argsort(at, kind="stable")
    nodes, begins = np.unique(at[by], return_index=True)
    edges = [*begins.tolist(), len(at)]
    return nodes.tolist(), [pa.array([x[lo:hi].tobytes() for lo, hi in zip(edges[:-1], edges[1:])], pa.binary()) for x in (a[by] for a in arrays)]


def _closed(top: Nodes) -> Nodes:
    """The top of a tree, its stubs as nodes that no row has reached."""
    return Nodes(**{n: getattr(top, n) for n in Nodes.NAMES if n != "cover"}, cover=np.where(top.cover == _STUB, 0.0, top.cover))


# ------------------------------------------------------------------ training

@dataclass(frozen=True)
class Fit:
    """Settings and the fold left out (None: none)."""
    settings: Settings
    held: int | None = None


def class_weights(rows: DataFrame) -> tuple[float, float]:
    """n / (2 n_c) of class 0 and 1."""
    r = rows.agg(F.count_if(F.col("y") == 0).alias("a"), F.count_if(F.col("y") == 1).alias("b")).first()
    n = r["a"] + r["b"]
    return tuple(n / (2.0 * c) if c else 1.0 for c in (r["a"], r["b"]))


def _weights_for(s: Settings, weights: tuple[float, float]) -> tuple[float, float]:
    return weights if s.balanced else (1.0, 1.0)


def _grown_here(fits: list[Fit], weights, n_features: int, stubs: dict):
    """The subtree of one (fit, tree, node) whose rows are in the group."""
    def run(table: pa.Table) -> pa.Table:
        k, tree, node = (table.column(c)[0].as_py() for c in ("fit", "tree", "node"))
        s, (name, depth) = fits[k].settings, stubs.get((k, tree, node), (int(ROOT), 0))
        key, y, codes = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("key", np.int64), ("y", np.int8), ("codes", np.uint8)))
        codes = codes.reshape(-1, n_features)
        sums = _sums(key, y, tree, s, _weights_for(s, weights))
        held = pack(grow(codes, sums, tree, s, np.uint64(name), depth))
        return pa.table({"fit": pa.array([k], pa.int32()), "tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int32()),
                         "nodes": pa.array([held], pa.binary())})
    return run


def _sent(fits: list[Fit], trees: list[tuple[int, int]], tops: dict, n_features: int):
    """The rows that each (fit, tree) draws, packed by the stub of the tree's top that they fall into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, y, fold, codes in _rows_of(batches, n_features):
            y = y.astype(np.int8)
            for k, tree in trees:
                use = drawn_weights(key, tree, fits[k].settings.seed) > 0
                if fits[k].held is not None:
                    use &= fold != fits[k].held
                own, top = np.flatnonzero(use), tops.get((k, tree))
                at = np.zeros(len(own), np.int64) if top is None else top.descend(codes, own)
                if top is not None:
                    below = top.cover[at] < 0  # a stub
                    own, at = own[below], at[below]
                nodes, packs = _packs(at, (key[own], y[own], codes[own]))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(nodes), pa.int32()), pa.array([tree] * len(nodes), pa.int32()),
                                                  pa.array(nodes, pa.int32()), *packs], names=["fit", "tree", "node", "key", "y", "codes"])
    return run


#: Rows of a block that passes over a larger table read.
BLOCK_ROWS = 50_000
#: Open nodes whose histograms a pass adds up; the others wait for the next one.
NODES_A_PASS = 2048


def _rows_of(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple]:
    """(key, y, fold, codes) of every block."""
    for b in batches:
        for held in zip(*(b.column(c).to_pylist() for c in ("key", "y", "fold", "codes"))):
            key, y, fold, codes = (np.frombuffer(v, kind) for v, kind in zip(held, (np.int64, np.int32, np.int32, np.uint8)))
            yield key, y, fold, codes.reshape(-1, n_features)


def _tops(blocks: DataFrame, layout: Layout, fits: list[Fit], trees: list[tuple[int, int]], weights, local_rows: int) -> tuple[dict, dict]:
    """The upper part of each tree, down to nodes of at most ``local_rows`` rows (stubs, of cover -1), a pass over the blocks of rows per level.

    Returns the tops and (name, depth) of the stubs. A node's features that cannot be cut are followed by further ones, pass by pass.
    """
    n_features = len(layout.features)
    parts = {t: {n: [v] for n, v in zip(Nodes.NAMES, (-1, -1, -1, 0, 0.0, 0.0, 0.0))} for t in trees}
    # open nodes: (fit, tree) -> node -> (name, depth, features tried so far)
    open_: dict = {t: {0: (int(ROOT), 0, 0)} for t in trees}
    stubs: dict = {}

    def arrays(t):
        return Nodes(**{n: np.array(v) for n, v in parts[t].items()})

    while any(open_.values()):
        asked, room = {}, NODES_A_PASS
        for t, nodes in open_.items():
            if nodes and room > 0:
                asked[t] = arrays(t), dict(list(nodes.items())[:room])
                room -= len(asked[t][1])
        found = blocks.mapInArrow(_node_sums(fits, asked, weights, n_features), "fit int, tree int, node int, hist binary").groupBy(
            "fit", "tree", "node").applyInArrow(_best_of(fits, asked, n_features), _CUT).collect()
        seen = set()
        for r in found:
            t, node = (r.fit, r.tree), r.node
            seen.add((t, node))
            s, part, (name, depth, tried) = fits[r.fit].settings, parts[t], open_[t].pop(node)
            part["value"][node], part["cover"][node] = r.one / r.weight if r.weight else 0.0, r.weight / UNIT
            if r.rows <= local_rows:
                part["cover"][node] = _STUB
                stubs[r.fit, r.tree, node] = (name, depth)
            elif r.rows < max(s.min_split, 2) or r.one in (0, r.weight) or s.max_depth is not None and depth >= s.max_depth:
                continue
            elif not math.isfinite(r.gain):
                if tried + s.drawn(n_features) < n_features:
                    open_[t][node] = (name, depth, tried + s.drawn(n_features))
            else:
                at = len(part["left"])
                part["left"][node], part["right"][node] = at, at + 1
                part["feature"][node], part["code"][node], part["gain"][node] = r.feature, r.code, r.gain
                for child in (int(c[0]) for c in child_names(np.array([name], np.uint64))):
                    for n, v in zip(Nodes.NAMES, (-1, -1, -1, 0, 0.0, 0.0, 0.0)):
                        part[n].append(v)
                    open_[t][len(part["left"]) - 1] = (child, depth + 1, 0)
        for t, (_, nodes) in asked.items():  # a node that no row reaches (nothing drawn) is a leaf
            for node in nodes:
                if (t, node) not in seen:
                    open_[t].pop(node)
    return {t: arrays(t) for t in trees}, stubs


def _tops_each(blocks: DataFrame, layout: Layout, fits: list[Fit], trees: list[tuple[int, int]], weights, local_rows: int) -> dict:
    """``_tops`` by tree: its top and the stubs of it."""
    tops, stubs = _tops(blocks, layout, fits, trees, weights, local_rows)
    own: dict = {t: {} for t in trees}
    for (k, tree, node), found in stubs.items():
        own[k, tree][k, tree, node] = found
    return {t: (tops[t], own[t]) for t in trees}


_CUT = "fit int, tree int, node int, rows long, one double, weight double, gain double, feature int, code int"


def _chosen(fit: Fit, tree: int, name: int, tried: int, n_features: int) -> np.ndarray:
    order = feature_order(np.array([name], np.uint64), tree, n_features, fit.settings.seed)
    return order[:, tried: tried + fit.settings.drawn(n_features)]


def _node_sums(fits, asked: dict, weights, n_features: int):
    """One pass over blocks of rows: the histograms of the features that open nodes have drawn."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        # nodes that look at equally many features are counted together
        groups: dict = {}
        for (k, tree), (top, nodes) in asked.items():
            for node, (name, _, tried) in nodes.items():
                chosen = _chosen(fits[k], tree, name, tried, n_features)[0]
                number, names, features = groups.setdefault((k, tree), {}).setdefault(len(chosen), (np.full(len(top.left), -1), [], []))
                number[node] = len(names)
                names.append(node)
                features.append(chosen)
        for key, y, fold, codes in _rows_of(batches, n_features):
            for (k, tree), (top, _) in asked.items():
                fit = fits[k]
                drawn = drawn_weights(key, tree, fit.settings.seed)
                rows = np.flatnonzero(drawn > 0 if fit.held is None else (drawn > 0) & (fold != fit.held))
                at = top.descend(codes, rows)
                for number, names, features in groups[k, tree].values():
                    own = number[at]
                    some = own >= 0
                    own, mine = own[some], rows[some]
                    if not len(mine):
                        continue
                    hist = histogram(codes[mine], own, np.stack(features), _weighted(drawn[mine], y[mine], _weights_for(fit.settings, weights)))
                    for i in np.flatnonzero(np.bincount(own, minlength=len(names))).tolist():
                        name = k, tree, names[i]
                        if name in held:
                            held[name] += hist[i]
                        else:
                            held[name] = hist[i].copy()
        yield pa.RecordBatch.from_arrays([*(pa.array([n[i] for n in held], pa.int32()) for i in range(3)),
                                          pa.array([h.tobytes() for h in held.values()], pa.binary())], names=["fit", "tree", "node", "hist"])
    return run


def _best_of(fits, asked: dict, n_features: int):
    def run(table: pa.Table) -> pa.Table:
        k, tree, node = (table.column(c)[0].as_py() for c in ("fit", "tree", "node"))
        s, (name, _, tried) = fits[k].settings, asked[k, tree][1][node]
        chosen = _chosen(fits[k], tree, name, tried, n_features)
        hist = sum(np.frombuffer(h, np.int64).reshape(1, chosen.shape[1], WIDTH, 3) for h in table.column("hist").to_pylist())
        gain, nth, code = best_cuts(hist, s, tried > 0)
        one, weight, rows = hist[0, 0].sum(axis=0)
        values = (k, tree, node, int(rows), float(one), float(weight), float(gain[0]), int(chosen[0, nth[0]]), int(code[0]))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32())
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds)], names=[c.split()[0] for c in _CUT.split(", ")])
    return run


def _joined(top: Nodes, below: dict[int, Nodes]) -> Nodes:
    """The top of a tree with its stubs replaced by the subtrees grown for them."""
    out = {n: [getattr(top, n)] for n in Nodes.NAMES}
    size = len(top.left)
    for node, sub in below.items():
        for n in Nodes.NAMES:
            value = getattr(sub, n)
            if n in ("left", "right"):
                value = np.where(value >= 0, value + size - 1, -1)
            out[n][0] = out[n][0].copy()
            out[n][0][node] = value[0]
            out[n].append(value[1:])
        size += len(sub.left) - 1
    return Nodes(**{n: np.concatenate(v) for n, v in out.items()})


def train(rows: DataFrame, layout: Layout, fits: list[Fit], local_rows: int | None = None,
          held_draws: int | None = None) -> list[RandomForest]:
    """All fits over ``binned`` rows; the driver holds them whole if rows times trees are at most ``held_draws``."""
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    n, weights, n_features = rows.count(), class_weights(rows), len(layout.features)
    todo = [(k, t) for k, f in enumerate(fits) for t in range(f.settings.trees)]
    stored = n * len(todo) > (HELD_DRAWS if held_draws is None else held_draws)
    made, parts = {}, None
    batch = max(1, JOB_ROWS // max(n, 1))
    blocks, grown_tops = in_blocks(rows, BLOCK_ROWS, False), {}
    if n > local_rows:
        blocks = materialize(blocks, "blocks")
    for lo in range(0, len(todo), batch):
        trees, stubs = todo[lo: lo + batch], {}
        if n > local_rows:  # the tops of many trees are grown by the same passes
            for first in range(lo - lo % TREES_AT_ONCE, lo + len(trees), TREES_AT_ONCE):
                some = todo[first: first + TREES_AT_ONCE]
                if some[0] not in grown_tops:
                    grown_tops |= _tops_each(blocks, layout, fits, some, weights, local_rows)
            stubs = {name: found for t in trees for name, found in grown_tops[t][1].items()}
        tops = {t: grown_tops[t][0] for t in trees if t in grown_tops}
        sent = blocks.mapInArrow(_sent(fits, trees, tops, n_features), "fit int, tree int, node int, key binary, y binary, codes binary")
        grown = sent.groupBy("fit", "tree", "node").applyInArrow(
            _grown_here(fits, weights, n_features, stubs), "fit int, tree int, node int, nodes binary")
        if stored:
            grown = materialize(grown, "subtrees")
            parts = grown if parts is None else parts.unionByName(grown)
            made |= {t: tops.get(t) or stub() for t in trees}
            continue
        below: dict = {}
        for r in grown.collect():
            below.setdefault((r.fit, r.tree), {})[r.node] = unpack(r.nodes)
        for t in trees:
            if tops:
                made[t] = _joined(_closed(tops[t]), below.get(t, {}))
            else:
                made[t] = below.get(t, {}).get(0) or grow(np.zeros((0, n_features), np.uint8), np.zeros((0, 2)), t[1], fits[t[0]].settings)
    trees_of = [[made[k, t] for t in range(f.settings.trees)] for k, f in enumerate(fits)]
    if stored:
        return [StoredForest(layout, f.settings, trees_of[k], parts.filter(F.col("fit") == k).drop("fit")) for k, f in enumerate(fits)]
    return [RandomForest(layout, f.settings, trees_of[k]) for k, f in enumerate(fits)]


def fit(df: DataFrame, features: list[str], settings: Settings = Settings(), label: str = "label", id_col: str = S.ID_COLUMN,
        local_rows: int | None = None, held_draws: int | None = None) -> RandomForest:
    layout = Layout.fit(df, features)
    rows = materialize(binned(df, layout, label, id_col), "binned")
    return train(rows, layout, [Fit(settings)], local_rows, held_draws)[0]


def held_out_scores(rows: DataFrame, layout: Layout, fits: list[Fit], stages: list[tuple[int, ...]], block: int,
                    local_rows: int | None = None) -> DataFrame:
    """(fit, trees, id, y, p) of the rows that each fit leaves out, after each of its ``stages`` (multiples of ``block``).

    The trees of a small table never leave their groups: a group is ``block`` trees of one fit and gives the sums of its
    trees' votes for the rows left out. Of larger tables the rows left out go to the groups that grow the subtrees.
    """
    local_rows = LOCAL_ROWS if local_rows is None else local_rows
    n, weights, n_features = rows.count(), class_weights(rows), len(layout.features)
    if n > local_rows:
        return _voted_by_subtrees(rows, layout, fits, stages, weights, n, local_rows)
    # a task per group, those of most work first
    groups = sorted(((k, b) for k, f in enumerate(fits) for b in range(f.settings.trees // block)),
                    key=lambda g: -min(fits[g[0]].settings.max_depth or math.inf, math.log2(max(n, 2))))

    def votes(number: int, ids, key: np.ndarray, y: np.ndarray, fold: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        k, b = groups[number]
        s, held = fits[k].settings, fold == fits[k].held
        total, asked = np.zeros(int(held.sum())), codes[held]
        for tree in range(b * block, (b + 1) * block):
            sums = _sums(key, y, tree, s, _weights_for(s, weights))
            use = (sums[:, 1] > 0) & ~held
            grown = grow(codes[use], sums[use], tree, s)
            total += grown.value[grown.descend(asked)]
        left = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(left), v, np.int32)) for v in (k, b)), ids.take(pa.array(left)), pa.array(y[left]),
                                          pa.array(total)], names=["fit", "block", "id", "y", "votes"])

    sums = materialize(dealt(rows, len(groups), True, votes, "fit int, block int, id string, y int, votes double"), "votes")
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, ts in enumerate(stages) for t in ts))).alias("w")
    pairs = rows.sparkSession.range(1).select(wanted).select(F.col("w.k").alias("fit"), F.col("w.t").alias("trees"))
    return sums.join(F.broadcast(pairs), "fit").filter(F.col("block") < F.col("trees") / block).groupBy("fit", "trees", "id", "y").agg(  # a row per stage
        (F.sum("votes") / F.col("trees")).alias("p"))


#: Rows left out whose shares of all trees are added up together: those whose numbers share the bits above these.
CHUNK_BITS = 14
#: Trees whose tops are grown together.
TREES_AT_ONCE = 256


def _voted_by_subtrees(rows: DataFrame, layout: Layout, fits: list[Fit], stages: list[tuple[int, ...]], weights, n: int, local_rows: int) -> DataFrame:
    """``held_out_scores`` of a larger table: trees of all fits in batches; no subtree leaves its group, what comes back are the shares."""
    n_features = len(layout.features)
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    blocks = materialize(in_blocks(numbered, BLOCK_ROWS, False), "blocks")
    todo, votes = [(k, t) for k, f in enumerate(fits) for t in range(f.settings.trees)], None
    batch = max(1, min(TREES_AT_ONCE, JOB_ROWS // max(n, 1)))
    for lo in range(0, len(todo), batch):
        trees = todo[lo: lo + batch]
        tops, stubs = _tops(blocks, layout, fits, trees, weights, local_rows)
        sent = numbered.mapInArrow(_sent_with_held(fits, trees, tops, n_features), _SENT_WITH_HELD)
        part = materialize(sent.groupBy("fit", "tree", "node").applyInArrow(
            _voted_here(fits, weights, n_features, stubs), "fit int, tree int, chunk long, rows binary, shares binary"), "votes")
        votes = part if votes is None else votes.unionByName(part)

    def means(table: pa.Table) -> pa.Table:
        """The rows of a chunk that a fit leaves out, their shares added up in the order of the trees."""
        k, tree = table.column("fit")[0].as_py(), table.column("tree").to_numpy()
        own = [np.frombuffer(r, np.int64) for r in table.column("rows").to_pylist()]
        shares = [np.frombuffer(v, np.float64) for v in table.column("shares").to_pylist()]
        names = np.unique(np.concatenate(own))
        total, by, parts = np.zeros(len(names)), np.argsort(tree, kind="stable"), []
        edges = np.searchsorted(tree[by], np.arange(fits[k].settings.trees + 1))
        for t in range(fits[k].settings.trees):
            for i in by[edges[t]: edges[t + 1]]:
                total[np.searchsorted(names, own[i])] += shares[i]  # a row is once in each tree
            if t + 1 in stages[k]:
                parts.append((np.full(len(names), t + 1, np.int32), names, total / (t + 1)))
        seen = [np.concatenate(c) for c in zip(*parts)] or [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"fit": pa.array([k] * len(seen[0]), pa.int32()), "trees": seen[0], "_row": seen[1], "p": seen[2]})

    scores = votes.groupBy("fit", "chunk").applyInArrow(means, "fit int, trees int, _row long, p double")
    return numbered.select("_row", "id", "y").join(scores, "_row").select("fit", "trees", "id", "y", "p")


_SENT_WITH_HELD = "fit int, tree int, node long, chunk long, rows binary, shares binary, key binary, y binary, codes binary"


def _sent_with_held(fits: list[Fit], trees: list[tuple[int, int]], tops: dict, n_features: int):
    """As ``_sent``; the rows that a fit leaves out go with them, those that end in a tree's top with their shares (node below 0)."""
    def record(k: int, tree: int, nodes: list, chunk: int, **columns) -> pa.RecordBatch:
        none, m = pa.nulls(len(nodes), pa.binary()), len(nodes)
        return pa.RecordBatch.from_arrays(
            [pa.array([k] * m, pa.int32()), pa.array([tree] * m, pa.int32()), pa.array(nodes, pa.int64()), pa.array([chunk] * m, pa.int64()),
             *(columns.get(c, none) for c in ("rows", "shares", "key", "y", "codes"))],
            names=["fit", "tree", "node", "chunk", "rows", "shares", "key", "y", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, key, fold = unpacked(b.column("codes"), n_features), b.column("key").to_numpy(), b.column("fold").to_numpy()
            y, row = b.column("y").to_numpy().astype(np.int8), b.column("_row").to_numpy()
            for k, tree in trees:
                held, top = fold == fits[k].held, tops[k, tree]
                at = top.descend(codes)
                below = top.cover[at] == _STUB
                use = (drawn_weights(key, tree, fits[k].settings.seed) > 0) & ~held & below
                nodes, (keys, ys, packs) = _packs(at[use], (key[use], y[use], codes[use]))
                yield record(k, tree, nodes, -1, key=keys, y=ys, codes=packs)
                for chunk in np.unique(row[held] >> CHUNK_BITS).tolist():
                    own = held & (row >> CHUNK_BITS == chunk)
                    ends, goes = own & ~below, own & below
                    nodes, (numbers, packs) = _packs(at[goes], (row[goes], codes[goes]))
                    yield record(k, tree, nodes, chunk, rows=numbers, codes=packs)
                    if ends.any():
                        nodes, (numbers, shares) = _packs(np.full(int(ends.sum()), -1 - chunk), (row[ends], top.value[at[ends]].astype(np.float64)))
                        yield record(k, tree, nodes, chunk, rows=numbers, shares=shares)
    return run


def _voted_here(fits: list[Fit], weights, n_features: int, stubs: dict):
    """Grows the subtree of one (fit, tree, node) from the rows that it draws, and gives its shares for the rows left out."""
    def run(table: pa.Table) -> pa.Table:
        k, tree, node = (table.column(c)[0].as_py() for c in ("fit", "tree", "node"))
        asked = table.filter(pa.compute.greater_equal(table.column("chunk"), 0))
        shares = asked.column("shares")
        if node >= 0:
            s, (name, depth) = fits[k].settings, stubs[k, tree, node]
            learnt = table.filter(pa.compute.less(table.column("chunk"), 0))
            key, y, codes = (np.frombuffer(b"".join(learnt.column(c).to_pylist()), kind) for c, kind in (("key", np.int64), ("y", np.int8), ("codes", np.uint8)))
            grown = grow(codes.reshape(-1, n_features), _sums(key, y, tree, s, _weights_for(s, weights)), tree, s, np.uint64(name), depth)
            found = (np.frombuffer(c, np.uint8).reshape(-1, n_features) for c in asked.column("codes").to_pylist())
            shares = pa.array([grown.value[grown.descend(c)].astype(np.float64).tobytes() for c in found], pa.binary())
        return pa.table({"fit": asked.column("fit"), "tree": asked.column("tree"), "chunk": asked.column("chunk"), "rows": asked.column("rows"),
                         "shares": shares})
    return run


def prefix(model: RandomForest, n: int) -> RandomForest:
    settings = replace(model.settings, trees=n)
    if isinstance(model, StoredForest):
        return StoredForest(model.layout, settings, model.tops[:n], model.parts.filter(F.col("tree") < n))
    return RandomForest(model.layout, settings, model.trees[:n])
