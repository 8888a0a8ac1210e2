"""Softmax boosting against a plain booster in numpy, and against one model per class."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marketloom.operators import boosting, models

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(11)
    a, b, c = r.normal(size=(3, 900))
    kind = (a > 0.6).astype(int) + (a > -0.6) + 2 * (b > 0.2)
    gone = r.random(900) < 0.2  # b is missing more often where it is large
    b = np.where(gone & (b > 0), np.nan, b)
    data = [(i, float(x), None if np.isnan(y) and i % 2 else float(y), float(z), int(k)) for i, (x, y, z, k) in enumerate(zip(a, b, c, kind, strict=True))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, kind int").repartition(5).cache()
    return df.filter("id % 4 > 0"), df.filter("id % 4 = 0")


def values(df):
    got = df.orderBy("id").collect()
    return np.array([[np.nan if r[x] is None else r[x] for x in X] for r in got]), np.array([r.kind for r in got])


def plain_tree(x, g, h, depth, rate, edges):
    """A function from rows to margins, grown node by node."""
    G, H = g.sum(), h.sum()
    value, best = -rate * G / (H + 1), (1e-12, None)
    if depth and len(x):
        for j, cuts in enumerate(edges):
            for cut in cuts:
                for missing in (False, True):
                    left = np.where(np.isnan(x[:, j]), missing, x[:, j] <= cut)
                    lg, lh = g[left].sum(), h[left].sum()
                    if lh < 1 or H - lh < 1:
                        continue
                    gain = lg**2 / (lh + 1) + (G - lg) ** 2 / (H - lh + 1) - G**2 / (H + 1)
                    if gain > best[0] + 1e-10:
                        best = (gain, (j, cut, missing, left))
    if best[1] is None:
        return lambda z: np.full(len(z), value)
    j, cut, missing, left = best[1]
    low, high = (plain_tree(x[s], g[s], h[s], depth - 1, rate, edges) for s in (left, ~left))
    return lambda z: np.where(np.where(np.isnan(z[:, j]), missing, z[:, j] <= cut), low(z), high(z))


def test_equals_a_plain_booster(rows):
    train, test = rows
    model = boosting.fit_softmax_boosted(train, X, "kind", 5, rounds=7, depth=3, bins=12)
    (x, y), (z, _) = values(train), values(test)
    m, out = np.zeros((len(x), 5)), np.zeros((len(z), 5))
    for _ in range(7):
        p = boosting.softmax(m)
        trees = [plain_tree(x, p[:, k] - (y == k), p[:, k] * (1 - p[:, k]), 3, 0.3, model.edges) for k in range(5)]
        m, out = m + np.stack([t(x) for t in trees], axis=1), out + np.stack([t(z) for t in trees], axis=1)
    got = np.array([r.probability for r in model.transform(test).orderBy("id").collect()])
    assert len(model.rounds) == 7 and np.abs(got - boosting.softmax(out)).max() < 1e-9


def log_loss(p, y):
    return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-15)).mean()


def test_held_out_loss_is_below_that_of_one_model_per_class(rows):
    train, test = rows
    y = values(test)[1]
    scored = boosting.fit_softmax_boosted(train, X, "kind", 5, rounds=20, depth=3).transform(test).orderBy("id").collect()
    own = log_loss(np.array([r.probability for r in scored]), y)
    assert np.mean([r.prediction == k for r, k in zip(scored, y, strict=True)]) > 0.85
    filled = train.na.fill(0.0), test.na.fill(0.0)
    single = models.fit_boosted(filled[0].fillna(0.0), X, "kind", rounds=20, depth=3, classes=5)
    p = np.array([[r.p for r in m.transform(filled[1]).select("id", vector_to_array("probability")[1].alias("p")).orderBy("id").collect()] for m in single.models]).T
    assert own < log_loss(p / p.sum(axis=1, keepdims=True), y)


def test_stops_early_and_keeps_the_best_round(rows):
    train, _ = rows
    noise = train.withColumns({"kind": F.pmod(F.xxhash64("id"), F.lit(4)).cast("int"), "stop": F.col("id") % 3 == 0})
    model = boosting.fit_softmax_boosted(noise, X, "kind", 4, rounds=12, depth=3, validation="stop", patience=2)
    assert len(model.history) < 13 and len(model.rounds) == int(np.argmin(model.history)) < 12
    assert model.history[0] == pytest.approx(np.log(4))


def test_missing_values_learn_their_side(spark):
    r = np.random.default_rng(3)
    data = [(i, None if k else float(v), int(k)) for i, (v, k) in enumerate(zip(r.normal(size=400), r.random(400) < 0.5, strict=True))]
    df = spark.createDataFrame(data, "id long, a double, kind int")
    model = boosting.fit_softmax_boosted(df.withColumn("b", F.lit(None).cast("double")), ["a", "b"], "kind", 2, rounds=12, depth=2, rate=0.5)
    found = model.transform(df.withColumn("b", F.lit(None).cast("double"))).agg(F.avg((F.col("prediction") == F.col("kind")).cast("int"))).first()[0]
    assert found > 0.75  # a gap can be told from values on one side of a split only
    empty = boosting.fit_softmax_boosted(df.filter("false"), ["a"], "kind", 2, rounds=2)
    assert empty.transform(df).select("probability").first()[0] == [0.5, 0.5]
