"""Extremely randomised trees: every node tries a few features at random cuts and keeps the best one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Trees:
    """Complete binary trees, node i's children being 2 i and 2 i + 1, the root 1: the feature (-1 in a leaf) and cut of
    each node, and how many training rows of each class it holds."""

    feature: np.ndarray
    cut: np.ndarray
    counts: np.ndarray

    def nodes(self, x: np.ndarray, tree: int) -> np.ndarray:
        """The node that each row ends in so far."""
        at, rows = np.ones(len(x), dtype=np.int64), np.arange(len(x))
        while True:
            f = self.feature[tree, at]
            inner = f >= 0
            if not inner.any():
                return at
            at = np.where(inner, 2 * at + (x[rows, np.maximum(f, 0)] > self.cut[tree, at]), at)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees of the class shares where each row ends."""
        out = np.zeros((len(x), self.counts.shape[2]))
        for tree in range(len(self.feature)):
            n = self.counts[tree, self.nodes(x, tree)]
            out += n / np.maximum(n.sum(axis=1, keepdims=True), 1)
        return out / len(self.feature)


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def _impurity(counts: np.ndarray) -> np.ndarray:
    """Gini impurity times rows, over the last axis."""
    n = counts.sum(axis=-1)
    return n - (counts.astype(np.float64) ** 2).sum(axis=-1) / np.maximum(n, 1)


def fit(rows: DataFrame, trees: int = 50, depth: int = 8, least: int = 5, seed: int = 42, vector: str = "vector", label: str = "label") -> Trees:
    """Learn from rows(vector, label), labels 0 to classes - 1, vectors of one length without nulls.

    A node tries the root of the number of features; its cuts are uniform within the box that the cuts above it leave of
    the features' ranges. Each level of all trees is one pass over the rows, in which a task puts out counts by node,
    feature, side and class; the driver holds the trees. Counts are whole numbers, so neither the order nor the
    partitions of the rows matter. Nodes of one class or fewer than ``least`` rows are leaves. No rows raise.
    """
    spark = rows.sparkSession
    ends = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.min("x"), F.max("x")).orderBy("pos").collect()
    if not ends:
        raise ValueError("no rows to learn from")
    low, high = (np.array([r[i] for r in ends], dtype=np.float64) for i in (1, 2))
    classes = int(rows.agg(F.max(label)).first()[0]) + 1
    rng, tried, size = np.random.default_rng(seed), max(1, round(len(low) ** 0.5)), 2 ** (depth + 1)
    model = Trees(np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size, classes), dtype=np.int64))
    for r in rows.groupBy(label).count().collect():
        model.counts[:, 1, int(r[0])] = r[1]
    boxes = {(t, 1): (low, high) for t in range(trees)}
    for _ in range(depth):
        boxes = {k: box for k, box in boxes.items() if model.counts[k].sum() >= max(2, least) and (model.counts[k] > 0).sum() > 1}
        if not boxes:
            break
        active = sorted(boxes)
        features = np.stack([rng.permutation(len(low))[:tried] for _ in active])
        cuts = np.stack([rng.uniform(boxes[k][0][f], boxes[k][1][f]) for k, f in zip(active, features)])
        counted = _counts(spark, rows.select(vector, label), model, active, features, cuts, classes)
        gain = _impurity(counted.sum(axis=2)) - _impurity(counted).sum(axis=2)
        below: dict = {}
        for i, (t, node) in enumerate(active):
            best = int(gain[i].argmax())
            if gain[i, best] <= 0:
                continue
            f, c = features[i, best], cuts[i, best]
            model.feature[t, node], model.cut[t, node] = f, c
            model.counts[t, 2 * node], model.counts[t, 2 * node + 1] = counted[i, best]
            lo, hi = boxes[t, node]
            for child, (a, b) in ((2 * node, (lo, np.where(np.arange(len(hi)) == f, c, hi))), (2 * node + 1, (np.where(np.arange(len(lo)) == f, c, lo), hi))):
                below[t, child] = a, b
        boxes = below
    return model


def _counts(spark, rows: DataFrame, model: Trees, active: list, features: np.ndarray, cuts: np.ndarray, classes: int) -> np.ndarray:
    """(active node, feature tried, side, class): how many rows."""
    number = np.full(model.feature.shape, -1)
    for i, k in enumerate(active):
        number[k] = i
    shape = (*features.shape, 2, classes)
    shared = spark.sparkContext.broadcast((model, number, features, cuts))

    def run(batches):
        own, number, features, cuts = shared.value
        out = np.zeros(shape, dtype=np.int64).ravel()
        for b in batches:
            if not len(b):
                continue
            x, y = _matrix(b.iloc[:, 0]), b.iloc[:, 1].to_numpy().astype(np.int64)
            for tree in range(len(own.feature)):
                i = number[tree, own.nodes(x, tree)]
                some = np.nonzero(i >= 0)[0]
                i = i[some]
                side = np.take_along_axis(x[some], features[i], axis=1) > cuts[i]
                cell = ((i[:, None] * shape[1] + np.arange(shape[1])) * 2 + side) * classes + y[some, None]
                out += np.bincount(cell.ravel(), minlength=len(out))
        at = np.nonzero(out)[0]
        yield pd.DataFrame({"cell": at, "n": out[at]})

    out = np.zeros(shape, dtype=np.int64).ravel()
    for cell, n in rows.mapInPandas(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():
        out[cell] = n
    return out.reshape(shape)


def predicted(model: Trees, rows: DataFrame, vector: str = "vector") -> DataFrame:
    """rows with probabilities (by class number), prediction and confidence; of equal probabilities the first class."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(list(shared.value.probabilities(_matrix(x))) if len(x) else [], dtype=object)

    out = rows.withColumn("probabilities", run(vector)).withColumn("confidence", F.array_max("probabilities"))
    return out.withColumn("prediction", (F.array_position("probabilities", F.col("confidence")) - 1).cast("double"))
