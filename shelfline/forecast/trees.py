"""Reading a trained Spark tree ensemble as arrays, for use inside tasks.

The recursive forecast and the attribution both have to walk the trees next to
the data. The node table of a saved model is small (trees x nodes), so it is
read once and shipped to the tasks as arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import SparkSession, functions as F

from shelfline.session import work_path


@dataclass(frozen=True)
class TreeArrays:
    """One row per tree, one column per node; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    weight: np.ndarray
    depth: int

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """Ensemble output per row; all trees step down one level at a time."""
        tree = np.arange(len(self.weight))[:, None]
        at = np.zeros((len(self.weight), len(rows)), dtype=np.int64)
        row = np.arange(len(rows))[None, :]
        for _ in range(self.depth):
            go_left = rows[row, self.feature[tree, at]] <= self.threshold[tree, at]
            at = np.where(go_left, self.left[tree, at], self.right[tree, at])
        return self.weight @ self.value[tree, at]


def tree_arrays(model: GBTRegressionModel) -> TreeArrays:
    spark = SparkSession.getActiveSession()
    path = work_path(spark, "model")
    model.write().save(path)
    nodes = (spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("value"),
        F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.rawCount").alias("cover"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold")).toPandas())  # the model only
    shape = (model.getNumTrees, int(nodes["id"].max()) + 1)
    own = np.broadcast_to(np.arange(shape[1]), shape)
    inner = nodes["left"] >= 0
    t, i = nodes["tree"].to_numpy(), nodes["id"].to_numpy()
    ti, ii = t[inner], i[inner]

    def table(column: str, dtype, base) -> np.ndarray:
        out = np.array(base, dtype=dtype)
        rows = inner if column not in ("value", "cover") else slice(None)
        out[(ti, ii) if column not in ("value", "cover") else (t, i)] = nodes[column][rows].to_numpy(dtype)
        return out

    zeros = np.zeros(shape)
    return TreeArrays(table("feature", np.int64, zeros), table("threshold", float, zeros), table("left", np.int64, own),
                      table("right", np.int64, own), table("value", float, zeros), table("cover", float, zeros),
                      np.array(model.treeWeights, dtype=float), max(tree.depth for tree in model.trees))


def _subset_weights(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Shapley weights of a product game, per feature (rows of ``ones``) and data row.

    The game pays ``prod(ones over S) * prod(zeros off S)``. Element ``i`` of the
    result is the weighted sum over all S without ``i``, found from the
    size-indexed coefficients of ``prod(zeros + ones * x)`` over the others.
    """
    count, rows = ones.shape
    order = np.arange(count)
    fact = np.cumprod(np.r_[1.0, np.arange(1, count + 1)])
    share = fact[order] * fact[count - 1 - order] / fact[count]
    out = np.empty((count, rows))
    for i in range(count):
        coef = np.zeros((count, rows))
        coef[0] = 1.0
        for j in range(count):
            if j != i:
                coef[1:] = coef[1:] * zeros[j] + coef[:-1] * ones[j]
                coef[0] *= zeros[j]
        out[i] = share @ coef
    return out


def contributions(trees: TreeArrays, rows: np.ndarray) -> tuple[np.ndarray, float]:
    """Additive contribution of every feature per row, and the base value.

    Each leaf is a game over the features on its path: a feature in the set sends
    the row down its own branch, one outside it splits by the training cover.
    """
    phi = np.zeros(rows.shape)
    base = 0.0
    for k, weight in enumerate(trees.weight):
        stack = [(0, {}, {})]
        while stack:
            node, ones, zeros = stack.pop()
            left, right = trees.left[k, node], trees.right[k, node]
            if left != node:
                f = int(trees.feature[k, node])
                goes_left = rows[:, f] <= trees.threshold[k, node]
                for child, goes in ((left, goes_left), (right, ~goes_left)):
                    part = trees.cover[k, child] / trees.cover[k, node]
                    stack.append((child, {**ones, f: ones.get(f, True) & goes}, {**zeros, f: zeros.get(f, 1.0) * part}))
                continue
            paid = weight * trees.value[k, node]
            base += paid * float(np.prod(list(zeros.values())))
            if ones:
                on = np.array([ones[f] for f in ones], dtype=float)
                off = np.array([[zeros[f]] for f in ones])
                gain = paid * (on - off) * _subset_weights(on, np.broadcast_to(off, on.shape))
                np.add.at(phi, (slice(None), list(ones)), gain.T)
    return phi, base
