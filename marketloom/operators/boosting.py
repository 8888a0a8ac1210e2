"""Boosted trees for many classes under one softmax objective.

All classes are boosted together: a round grows one tree per class on the
gradients of the log loss. Trees grow level by level; a level is one pass over the rows, in
which tasks bincount gradients and hessians by node, class, feature and bin with
numpy, and Spark sums the tables and picks the best split of each node. What
reaches the driver is one row per node and class. Values go into at most
``bins`` bins at quantiles of the training rows; a missing value
(null or NaN) has a bin of its own, and each split learns to which side it goes.

Sizes that pass the driver or a task depend on features, bins, classes and depth only, never on the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.sources.durable import durable

#: Rounds after which the rows' margins are written again.
ROUNDS_KEPT = 5


@dataclass
class Trees:
    """The trees of one round: arrays over class and node, nodes numbered as in a heap from 0.

    ``feature`` is -1 at leaves; a row goes left if its bin is at most ``bin``, or by
    ``missing_left`` if it is 0. ``value`` is a leaf's margin.
    """

    feature: np.ndarray
    bin: np.ndarray
    missing_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, classes: int, depth: int) -> Trees:
        shape = (classes, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape, bool), np.zeros(shape))

    def nodes(self, bins: np.ndarray, k: int, levels: int) -> np.ndarray:
        """Where the rows stand in the tree of class ``k`` after some levels."""
        node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(levels):
            feature = self.feature[k][node]
            b = bins[rows, np.maximum(feature, 0)]
            left = np.where(b == 0, self.missing_left[k][node], b <= self.bin[k][node])
            node = np.where(feature < 0, node, 2 * node + np.where(left, 1, 2))
        return node

    def margins(self, bins: np.ndarray, depth: int) -> np.ndarray:
        return np.stack([self.value[k][self.nodes(bins, k, depth)] for k in range(len(self.feature))], axis=1)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def best_splits(g: np.ndarray, h: np.ndarray, ridge: float, least_hessian: float) -> tuple[float, int, int, bool]:
    """Gain, feature, last bin to the left and side of missing values of the best split of one node; gain 0 if none.

    ``g`` and ``h`` are sums by feature and bin, bin 0 for missing values. Of equal gains
    the first feature, then bin, with missing values to the right, wins.
    """
    all_g, all_h = g[0].sum(), h[0].sum()
    left_g, left_h = np.cumsum(g[:, 1:], axis=1)[:, :-1], np.cumsum(h[:, 1:], axis=1)[:, :-1]
    gains = []
    for missing_g, missing_h in ((0.0, 0.0), (g[:, :1], h[:, :1])):
        lg, lh = left_g + missing_g, left_h + missing_h
        rg, rh = all_g - lg, all_h - lh
        gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - all_g**2 / (all_h + ridge)
        gains.append(np.where((lh >= least_hessian) & (rh >= least_hessian), gain, 0.0))
    gain = np.stack(gains, axis=2)
    at = int(np.argmax(gain))
    feature, b, side = np.unravel_index(at, gain.shape)
    return float(gain.reshape(-1)[at]), int(feature), int(b) + 1, bool(side)


class SoftmaxBoosted:
    """A fitted model: ``transform`` adds ``probability`` (an array by class) and ``prediction``."""

    def __init__(self, features: list[str], edges: list[np.ndarray], classes: int, depth: int, rounds: list[Trees], history: list[float]) -> None:
        self.features, self.edges, self.classes, self.depth, self.rounds = features, edges, classes, depth, rounds
        #: Log loss of the validation rows before the first round and after each.
        self.history = history

    def transform(self, df: DataFrame) -> DataFrame:
        edges, rounds, depth, classes = self.edges, self.rounds, self.depth, self.classes

        @F.pandas_udf("array<double>")
        def probabilities(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                bins = binned(np.array(batch.tolist(), float).reshape(len(batch), len(edges)), edges)
                margins = np.zeros((len(bins), classes))
                for trees in rounds:
                    margins += trees.margins(bins, depth)
                yield pd.Series(list(softmax(margins)))

        found = df.withColumn("probability", probabilities(_vector(self.features)))
        return found.withColumn("prediction", (F.array_position("probability", F.array_max("probability")) - 1).cast("double"))


def _vector(features: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(float("nan"))) for f in features])


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` increasing edges per feature, at quantiles of the known values."""
    known = df.select([F.when(~F.isnan(F.col(f"`{f}`").cast("double")), F.col(f"`{f}`").cast("double")).alias(f"f{i}") for i, f in enumerate(features)])
    shares = [i / bins for i in range(1, bins)]
    return [np.unique(np.array(found, float)) for found in known.approxQuantile([f"f{i}" for i in range(len(features))], shares, 1 / (4 * bins))]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin numbers of values by column: 0 for NaN, 1 up to the first edge, and so on."""
    out = np.zeros(values.shape, np.uint8)
    for j, e in enumerate(edges):
        v = values[:, j]
        out[:, j] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, side="left"))
    return out


def _arrays(batch: pd.DataFrame, width: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch["bins"]), np.uint8).reshape(len(batch), width)
    margins = np.frombuffer(b"".join(batch["margins"]), np.float64).reshape(len(batch), classes)
    return bins, margins, batch["label"].to_numpy(), batch["stop"].to_numpy(bool)


def _summed(parts: DataFrame, reduce_rows) -> DataFrame:
    """``reduce_rows(key, table)`` over the summed tables of each key, in two steps so that no task reads those of all tasks."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(rows["table"].iloc[0]) // 8)
        for raw in rows["table"]:
            total += np.frombuffer(raw, np.float64)
        return pd.DataFrame({"node": rows["node"].iloc[:1], "class": rows["class"].iloc[:1], "table": [total.tobytes()]})

    salted = parts.groupBy("node", "class", "salt").applyInPandas(add, "node int, class int, table binary")

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        one = add(rows).iloc[0]
        return reduce_rows(int(one["node"]), int(one["class"]), np.frombuffer(one["table"], np.float64))

    return salted.groupBy("node", "class").applyInPandas(last, "node int, class int, gain double, feature int, bin int, missing_left boolean, value double, left_value double, right_value double")


def _lowest(history: list[float], otherwise: int) -> int:
    """The round after which the loss was lowest, if there were validation rows."""
    return otherwise if np.isnan(history).all() else int(np.nanargmin(history))


def fit_softmax_boosted(
    df: DataFrame, features: list[str], label: str, classes: int, *, rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32,
    ridge: float = 1.0, least_hessian: float = 1.0, validation: str | None = None, patience: int = 5,
) -> SoftmaxBoosted:
    """Boost ``rounds`` trees per class on the softmax log loss of ``label`` (0 to ``classes - 1``).

    ``validation`` names a boolean column of rows that only decide when to stop: after ``patience`` rounds
    without a lower log loss, with the rounds up to the lowest kept. A leaf's value is ``-rate * G / (H + ridge)``; both sides of a split need
    ``least_hessian``. Missing values go to the side that each split learns; rows without a label are left out.
    """
    if not 2 <= bins <= 255:
        raise ValueError("from 2 to 255 bins")
    stop = F.coalesce(F.col(validation), F.lit(False)) if validation else F.lit(False)
    known = df.filter(F.col(label).isNotNull())
    edges = bin_edges(known.filter(~stop), features, bins)
    width, most = len(features), bins + 1

    @F.pandas_udf("binary")
    def to_bins(values: pd.Series) -> pd.Series:
        return pd.Series([b.tobytes() for b in binned(np.array(values.tolist(), float).reshape(len(values), width), edges)], dtype=object)

    start = np.zeros(classes).tobytes()
    rows = durable(known.select(to_bins(_vector(features)).alias("bins"), F.col(label).cast("int").alias("label"), stop.alias("stop"), F.lit(start).alias("margins")))

    def moved(batch: pd.DataFrame, since: list[Trees]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        b, m, y, s = _arrays(batch, width, classes)
        for t in since:
            m = m + t.margins(b, depth)
        return b, m, y, s

    def level_splits(rows: DataFrame, since: list[Trees], trees: Trees, level: int) -> list:
        def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first, count = 2**level - 1, 2**level
            held, loss = np.zeros((count, classes, 2, width * most)), np.zeros(2)
            cell = np.arange(width) * most
            for batch in batches:
                b, m, y, s = moved(batch, since)
                p = softmax(m)
                loss += (-np.log(np.maximum(p[s, y[s]], 1e-15))).sum(), s.sum()
                b, p, y = b[~s], p[~s], y[~s]
                for k in range(classes):
                    node = trees.nodes(b, k, level) - first
                    g, h = p[:, k] - (y == k), p[:, k] * (1 - p[:, k])
                    for j in range(count):
                        here = np.flatnonzero(node == j)
                        if len(here):
                            at = (b[here] + cell).reshape(-1)
                            held[j, k, 0] += np.bincount(at, np.repeat(g[here], width), width * most)
                            held[j, k, 1] += np.bincount(at, np.repeat(h[here], width), width * most)
            out = [(first + j, k, held[j, k].tobytes()) for j in range(count) for k in range(classes) if held[j, k, 1].any()]
            yield pd.DataFrame([*out, (-1, -1, loss.tobytes())], columns=["node", "class", "table"])

        def pick(node: int, k: int, table: np.ndarray) -> pd.DataFrame:
            names = ["node", "class", "gain", "feature", "bin", "missing_left", "value", "left_value", "right_value"]
            if node < 0:
                return pd.DataFrame([(node, k, float(table[0]), 0, 0, False, float(table[1]), 0.0, 0.0)], columns=names)
            g, h = table.reshape(2, width, most)
            gain, feature, b, side = best_splits(g, h, ridge, least_hessian)
            leaf = lambda g, h: float(-rate * g / (h + ridge))
            lg, lh = (x[feature, 1 : b + 1].sum() + (x[feature, 0] if side else 0.0) for x in (g, h))
            value = leaf(g[0].sum(), h[0].sum())
            return pd.DataFrame([(node, k, gain, feature, b, side, value, leaf(lg, lh), leaf(g[0].sum() - lg, h[0].sum() - lh))], columns=names)

        parts = rows.mapInPandas(tables, "node int, class int, table binary")
        return _summed(parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64))), pick).collect()

    done: list[Trees] = []
    written, history = 0, []
    for r in range(rounds + 1):
        trees = Trees.empty(classes, depth)
        for level in range(depth if r < rounds else 1):
            found = level_splits(rows, done[written:], trees, level)
            if level == 0:
                loss = [x["gain"] / x["value"] for x in found if x["node"] < 0 and x["value"]]
                history.append(loss[0] if loss else float("nan"))
            for x in found:
                if x["node"] < 0 or r == rounds:
                    continue
                k, n = x["class"], x["node"]
                trees.value[k, n] = x["value"]
                if x["gain"] > 1e-12:
                    trees.feature[k, n], trees.bin[k, n], trees.missing_left[k, n] = x["feature"], x["bin"], x["missing_left"]
                    trees.value[k, 2 * n + 1], trees.value[k, 2 * n + 2] = x["left_value"], x["right_value"]
            if (trees.feature[:, 2**level - 1 : 2 ** (level + 1) - 1] < 0).all():
                break
        if r - _lowest(history, r) >= patience:
            break
        if r == rounds or (trees.feature[:, 0] < 0).all():
            break
        done.append(trees)
        if len(done) - written >= ROUNDS_KEPT:
            since = done[written:]

            def forward(batches: Iterator[pd.DataFrame], since: list[Trees] = since) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    margins = moved(batch, since)[1]
                    yield batch.assign(margins=[m.tobytes() for m in margins])

            rows, written = durable(rows.mapInPandas(forward, rows.schema)), len(done)
    return SoftmaxBoosted(features, edges, classes, depth, done[: _lowest(history, len(done))], history)
