"""Path-dependent TreeSHAP for boosted trees and forests.

The fitted ensemble (bounded by trees x nodes) is shipped to the executors; rows are
explained in Arrow batches by ``mapInPandas``. The recursion over a tree is
the same for every row - only which child is "hot" differs - so it runs once
per tree with numpy vectors over the whole batch. The values are those of
Lundberg et al., "Consistent individualized feature attribution for tree
ensembles" (2018); they are computed in time linear in the nodes by polynomial
path summaries, taken at Gauss points (``tree_shap``).

Output explains the model margin: boosting F = base + sum of leaf values
(probability 1/(1+exp(-F))), random forest = mean of leaf class-1 fractions. SHAP values plus the base value add up to that margin for each row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake import schema as S
from churnlake.operators.boosting import BoostedTrees


@dataclass
class Tree:
    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    weight: float
    missing_left: np.ndarray | None = None

    def goes_left(self, X: np.ndarray, node) -> np.ndarray:
        """Which rows go left at a node (or each row at its own node)."""
        x = X[np.arange(len(X)), np.maximum(self.feature[node], 0)]
        left = x <= self.threshold[node]
        return left if self.missing_left is None else left | (np.isnan(x) & self.missing_left[node])


@dataclass
class Ensemble:
    kind: str  # "boosting" or "forest"
    trees: list
    n_features: int
    base: float = 0.0

    @staticmethod
    def of_boosting(model) -> "Ensemble":
        """The trees of a ``BoostedTrees`` model: nodes numbered without gaps, thresholds in place of bin codes."""
        trees = []
        for heap in model.trees:
            ids = np.flatnonzero(heap.feature >= -1)
            number = np.full(2 * len(heap.feature) + 2, -1)
            number[ids] = np.arange(len(ids))
            inner = heap.feature[ids] >= 0
            child = lambda i: np.where(inner, number[2 * ids + i], -1)  # noqa: E731, B023
            limits = [np.append(c, np.inf) for c in model.layout.cuts]
            threshold = np.array([limits[f][c] if f >= 0 else 0.0 for f, c in zip(heap.feature[ids], heap.code[ids])])
            trees.append(Tree(child(0), child(1), heap.feature[ids].astype(np.int64), threshold, heap.value[ids], heap.cover[ids], 1.0,
                              heap.missing_left[ids]))
        return Ensemble("boosting", trees, len(model.features), model.base)

    @staticmethod
    def of_forest(model) -> "Ensemble":
        """The trees of a ``RandomForest``: their mean share of class 1; missing values go right, so no cut is met by them."""
        limits = [np.append(c, np.inf) for c in model.layout.cuts]
        trees = [Tree(t.left, t.right, t.feature, np.array([limits[f][c] if f >= 0 else 0.0 for f, c in zip(t.feature, t.code)]), t.value,
                      t.cover, 1.0 / len(model.trees)) for t in model.trees]
        return Ensemble("forest", trees, len(model.features))

    def expected_value(self) -> float:
        total = self.base
        for t in self.trees:
            leaves = t.left < 0
            total += t.weight * float(np.sum(t.cover[leaves] * t.value[leaves]) / t.cover[0])
        return total

    def predict(self, X: np.ndarray) -> np.ndarray:
        out = np.full(X.shape[0], self.base)
        for t in self.trees:
            node = np.zeros(X.shape[0], dtype=np.int64)
            while (inner := t.left[node] >= 0).any():
                node = np.where(inner, np.where(t.goes_left(X, node), t.left[node], t.right[node]), node)
            out += t.weight * t.value[node]
        return out


# --------------------------------------------------------------- the algorithm

def tree_shap(tree: Tree, X: np.ndarray, phi: np.ndarray) -> None:
    """Add this tree's (weighted) SHAP values for all rows of X into phi (n x M).

    A feature i on the path to a leaf lets the row through (o = 1) or not (o = 0) and passes a share z of the cover.
    With k!(m-k-1)!/m! = integral of t^k (1-t)^(m-1-k) over [0, 1], its value at the leaf is (o - z) times the integral of
    the product of z_j (1-t) + o_j t over the other features j of the path: a polynomial, so a Gauss rule with
    half as many points as the path has features is exact. The products are summed over the leaves on the way back up, so each edge
    is looked at once: the work is nodes x points, whatever the length of the paths.
    """
    points, weights = np.polynomial.legendre.leggauss(max(1, (_longest_path(tree) + 1) // 2))
    t = ((points + 1) / 2)[:, None]
    weights = weights / 2
    zeros = np.zeros(len(X))

    def term(z, o, factor, below):
        """Integral of (o - z) times the product without this feature's own factor."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (o - z) * (weights @ np.where(factor > 0, below / factor, 0.0))

    def walk(node: int, product: np.ndarray, on_path: dict) -> np.ndarray:
        """The sum over the leaves below of value x product; credits the features of the edges below on the way."""
        if tree.left[node] < 0:
            return product * (tree.value[node] * tree.weight)
        d, total = int(tree.feature[node]), 0.0
        goes_left = tree.goes_left(X, node)
        z0, o0, factor0 = on_path.get(d, (1.0, None, None))
        for child, goes in ((int(tree.left[node]), goes_left), (int(tree.right[node]), ~goes_left)):
            z = z0 * (tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0)
            o = goes.astype(float) if o0 is None else o0 * goes
            factor = z * (1 - t) + o * t
            with np.errstate(divide="ignore", invalid="ignore"):
                onward = product * (factor if factor0 is None else np.where(factor0 > 0, factor / factor0, 0.0))
            below = walk(child, onward, {**on_path, d: (z, o, factor)})
            phi[:, d] += term(z, o, factor, below) - (term(z0, o0, factor0, below) if factor0 is not None else zeros)
            total = total + below
        return total

    walk(0, np.ones((len(t), len(X))), {})


def _longest_path(tree: Tree) -> int:
    """The most different features on a path."""
    longest, open_ = 0, [(0, frozenset())]
    while open_:
        node, seen = open_.pop()
        longest = max(longest, len(seen))
        if tree.left[node] >= 0:
            seen = seen | {int(tree.feature[node])}
            open_ += [(int(tree.left[node]), seen), (int(tree.right[node]), seen)]
    return longest


def explain_batch(ens: Ensemble, X: np.ndarray) -> np.ndarray:
    phi = np.zeros((X.shape[0], ens.n_features))
    for t in ens.trees:
        tree_shap(t, X, phi)
    return phi


def responses(ens: Ensemble, X: np.ndarray, feature: int, grid: np.ndarray) -> np.ndarray:
    """Margins (rows x grid) with one feature set to each value of a rising grid, without scoring a row once per value.

    A row reaches a leaf by its other features or not; if so, the leaf counts for an interval of this one.
    So each tree is walked once, leaves enter as steps at the ends of their intervals, and a running sum over the grid does the rest.
    """
    steps = np.zeros((len(grid) + 1, len(X)))
    for tree in ens.trees:
        open_ = [(0, np.ones(len(X), bool), -np.inf, np.inf)]
        while open_:
            node, reach, low, high = open_.pop()
            if not reach.any():
                continue
            if tree.left[node] < 0:
                value = np.where(reach, tree.weight * tree.value[node], 0.0)
                steps[np.searchsorted(grid, low, "right")] += value
                steps[np.searchsorted(grid, high, "right")] -= value
            elif tree.feature[node] == feature:
                at = float(tree.threshold[node])
                open_ += [(tree.left[node], reach, low, min(high, at)), (tree.right[node], reach, max(low, at), high)][
                    slice(at <= low, 1 if at >= high else 2)]
            else:
                left = tree.goes_left(X, node)
                open_ += [(tree.left[node], reach & left, low, high), (tree.right[node], reach & ~left, low, high)]
    return ens.base + np.cumsum(steps[:-1], axis=0).T


def probability_of(ens: Ensemble, margin: np.ndarray) -> np.ndarray:
    """Probability of class 1 for margins of this kind of ensemble."""
    return margin if ens.kind == "forest" else 1.0 / (1.0 + np.exp(-margin))


def response_rows(df: DataFrame, ens: Ensemble, features: list[str], feature: str, grid: list[float], id_col: str = S.ID_COLUMN) -> DataFrame:
    """(id, p: array over the grid) of every row, as ``responses`` gives them."""
    shared, at, values = df.sparkSession.sparkContext.broadcast(ens), features.index(feature), np.array(grid, float)

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 4096):
                part = pdf.iloc[lo: lo + 4096]
                X = np.stack(part["x"].to_numpy()).astype(float)
                yield pd.DataFrame({id_col: part[id_col], "p": list(probability_of(shared.value, responses(shared.value, X, at, values)))})

    return df.select(F.col(id_col).cast("string").alias(id_col), _vector(features)).mapInPandas(run, f"{id_col} string, p array<double>")


def _vector(features: list[str]):
    nan = F.lit(float("nan"))
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), nan) for c in features]).alias("x")


def ensemble_of(model) -> Ensemble:
    """The node tables of a fitted forest or boosting model."""
    return Ensemble.of_boosting(model) if isinstance(model, BoostedTrees) else Ensemble.of_forest(model)


def shap_tree_rows(df: DataFrame, model, features: list[str], id_col: str = S.ID_COLUMN) -> DataFrame:
    """One row per customer: (id, shap: array of (feature, value, shap), base_value, margin).

    ``margin`` is the ensemble output re-computed from the node table, so
    sum(shap) + base_value == margin per row (checked by the tests).
    """
    spark = df.sparkSession
    ens = ensemble_of(model)
    base = ens.expected_value()
    shared = spark.sparkContext.broadcast(ens)  # model-sized, not data-sized
    names = list(features)

    def run(batches):
        e = shared.value
        for pdf in batches:
            X = np.stack(pdf["x"].to_numpy()).astype(float) if len(pdf) else np.zeros((0, len(names)))
            yield pd.DataFrame({id_col: pdf[id_col], "values": list(X), "phi": list(explain_batch(e, X)),
                                "base_value": base, "margin": e.predict(X)})

    rows = df.select(F.col(id_col).cast("string").alias(id_col), _vector(features))
    out = rows.mapInPandas(run, f"{id_col} string, values array<double>, phi array<double>, base_value double, margin double")
    named = F.array(*[F.lit(n) for n in names])
    triples = F.transform(F.arrays_zip(named.alias("f"), F.col("values"), F.col("phi")), lambda z: F.struct(
        z["f"].alias("feature"), z["values"].alias("value"), z["phi"].alias("shap")))
    return out.select(id_col, triples.alias("shap"), "base_value", "margin")


def shap_tree(df: DataFrame, model, features: list[str], id_col: str = S.ID_COLUMN) -> DataFrame:
    """Long table (id, feature, value, shap, base_value, margin) for every row."""
    rows = shap_tree_rows(df, model, features, id_col)
    return rows.select(id_col, F.explode("shap").alias("s"), "base_value", "margin").select(
        id_col, "s.feature", "s.value", "s.shap", "base_value", "margin")
