"""Models against held-out rows or plain numpy, and draws against the distribution they follow."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import models, scale

X = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """Three features, of which c is noise; classes of a and b, a target of a."""
    r = np.random.default_rng(5)
    a, b, c = r.normal(size=(3, 600))
    three = (a > 0.5).astype(int) + (a > -0.5)
    data = [(i, float(x), float(y), float(z), int(x + y > 0), int(k), float(2 * x - y)) for i, (x, y, z, k) in enumerate(zip(a, b, c, three, strict=True))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, two int, three int, target double").repartition(3).cache()
    return df.filter("id % 4 > 0"), df.filter("id % 4 = 0")


def hit(df, label):
    return df.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]


def squared(df, label):
    return df.agg(F.avg((F.col("prediction") - F.col(label)) ** 2)).first()[0]


@pytest.mark.parametrize("criterion", ["gini", "entropy"])
def test_tree_learns_a_class(rows, criterion):
    train, test = rows
    assert hit(models.fit_tree(train, X, "three", depth=3, criterion=criterion).transform(test), "three") > 0.95


def test_tree_regression_beats_the_mean(rows):
    train, test = rows
    fitted = squared(models.fit_tree(train, X, "target", depth=6, regression=True).transform(test), "target")
    assert fitted < 0.2 * test.agg(F.var_pop("target")).first()[0]


def test_boosted_classes_and_early_stop(rows):
    train, test = rows
    marked = train.withColumn("stop", F.col("id") % 5 == 1)
    two = models.fit_boosted(marked, X, "two", rounds=10, depth=3, classes=2, validation="stop")
    assert hit(two.transform(test), "two") > 0.88
    many = models.fit_boosted(marked, X, "three", rounds=8, depth=2, classes=3, validation="stop")
    assert hit(many.transform(test), "three") > 0.93
    # classes of noise stop before the last round
    noise = marked.withColumn("three", (F.xxhash64("id") % 3 + 3) % 3)
    stopped = models.fit_boosted(noise, ["c"], "three", rounds=12, depth=4, classes=3, validation="stop")
    assert min(m.stages[-1].getNumTrees for m in stopped.models) < 12
    assert squared(models.fit_boosted(marked, X, "target", rounds=15, depth=4, rate=0.3, validation="stop").transform(test), "target") < 0.8


def test_linear_models(rows):
    train, test = rows
    assert hit(models.fit_linear(train, X, "two").transform(test), "two") > 0.97
    assert hit(models.fit_linear(train, X, "two", kind="svm").transform(test), "two") > 0.97
    assert hit(models.fit_linear(train, X, "three", kind="svm", classes=3).transform(test), "three") > 0.6


def test_bagging_errors_fall_with_trees(rows):
    train, test = rows
    found = {r["trees"]: r["mse"] for r in models.bagging_errors(train, test, X, "target", [1, 15], depth=8).collect()}
    assert found[15] < found[1] < test.agg(F.var_pop("target")).first()[0]
    fewer = squared(models.fit_bagging(train, X, "target", trees=10, share=0.25).transform(test), "target")
    assert fewer < 1.0


def test_grid_search_takes_the_deeper_trees(rows):
    train, test = rows
    best, grid = models.grid_search(train, X, "three", depths=[1, 4], trees=[5], folds=2)
    scores = {r["depth"]: r["score"] for r in grid.collect()}
    assert set(scores) == {1, 4} and scores[4] > scores[1]
    assert best.getMaxDepth() == 4


def test_imputation_fills_only_gaps(rows):
    train, _ = rows
    gaps = train.withColumn("target", F.when(F.col("id") % 3 > 0, F.col("target")))
    both = models.impute_forest(gaps, ["target"], [*X, "target"], trees=10, depth=8).select("id", F.col("target").alias("filled")).join(train, "id")
    assert both.filter("filled IS NULL").count() == 0
    assert both.filter("id % 3 > 0 AND filled <> target").count() == 0
    assert both.filter("id % 3 = 0").agg(F.avg((F.col("filled") - F.col("target")) ** 2)).first()[0] < 1.0


def test_importances_name_the_features_that_matter(spark, rows):
    train, test = rows
    forest = models.fit_forest(train, X, "three", trees=10, depth=4)
    own = {r["feature"]: r["importance"] for r in models.importances(forest, spark, X).collect()}
    assert max(own, key=own.get) == "a" and math.isclose(sum(own.values()), 1)
    lost = {r["feature"]: r["importance"] for r in models.permutation_importance(forest, test, X, "three", "id").collect()}
    assert set(lost) == set(X) and lost["a"] > 0.3 and abs(lost["b"]) < 0.1 and abs(lost["c"]) < 0.1


def test_permutation_is_repeatable(rows):
    train, test = rows
    tree = models.fit_tree(train, X, "three")
    one, two = (sorted(map(tuple, models.permutation_importance(tree, t, X, "three", "id").collect())) for t in (test, test.repartition(5)))
    assert one == two


@pytest.mark.parametrize("train_rows, test_rows", [(1 << 14, 1 << 11), (37, 11)])
def test_nearest_equals_brute_force(spark, train_rows, test_rows):
    r = np.random.default_rng(2)
    x = r.integers(0, 4, (150, 3)).astype(float) + 1000  # many ties, large levels
    df = spark.createDataFrame([(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)], "id long, embedding array<double>, label int")
    train, test = df.filter("id % 3 > 0"), df.filter("id % 3 = 0")
    found = {}
    for row in models.nearest(train, test, 4, train_rows=train_rows, test_rows=test_rows).collect():
        found.setdefault(row["id"], []).append((row["distance"], row["neighbour"]))
    ids = [i for i in range(150) if i % 3]
    for i in range(0, 150, 3):
        want = sorted((float(((x[i] - x[j]) ** 2).sum()), j) for j in ids)[:4]
        assert sorted(found[i]) == want


def test_nearest_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>, label int")
    some = spark.createDataFrame([(1, [0.0], 2)], none.schema)
    assert models.nearest(none, some, 3).count() == 0 and models.nearest(some, none, 3).count() == 0


def test_pca_equals_eigenvalues(spark):
    x = np.random.default_rng(1).normal(size=(400, 4)) @ np.diag([3, 2, 0.5, 0.1])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, p double, q double, r double, s double")
    rows = scale.pca_variance(df, ["p", "q", "r", "s"], 0.97).orderBy("k").collect()
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    want = values / values.sum()
    assert np.allclose([r["explained"] for r in rows], want)
    assert [r["kept"] for r in rows] == [bool(c - w < 0.97) for c, w in zip(want.cumsum(), want, strict=True)]
    projected = scale.pca_project(df, ["p", "q", "r", "s"], 0.97)
    assert len(projected.first()["pca"]) == sum(r["kept"] for r in rows)


@pytest.mark.parametrize("share", [0.25, 1.0, 20.0])
def test_bootstrap_weights_are_poisson(spark, share):
    weights = [r[0] for r in scale.bootstrap(spark.range(4000), 2, share).select("weight").collect()]
    mean, second = sum(weights) / 8000, sum(w * w for w in weights) / 8000
    assert abs(mean - share) < 5 * math.sqrt(share / 8000)
    assert abs(second - mean**2 - share) < 0.1 * share


def test_poisson_steps_cover_what_the_hash_can_tell():
    for mean in (0.0, 0.3, 20.0, 5000.0):
        first, steps = scale.poisson_steps(mean)
        assert steps[-1] > 1 - 2.0**-32 and len(steps) < 60 * math.sqrt(mean + 1) and first >= 0


def test_bagging_errors_come_from_one_fit(rows):
    train, test = rows
    counts = [1, 2, 4, 6]
    got = {r["trees"]: r["mse"] for r in models.bagging_errors(train, test, X, "target", counts, depth=6).collect()}
    *before, forest = models.fit_bagging(train, X, "target", trees=6, depth=6).stages
    vectors = before[0].transform(test).orderBy("id").collect()
    each = np.array([[t.predict(r.features) for r in vectors] for t in forest.trees])
    y = np.array([r.target for r in vectors])
    for t in counts:
        assert got[t] == pytest.approx(((each[:t].mean(axis=0) - y) ** 2).mean())
    assert got[6] == pytest.approx(squared(models.fit_bagging(train, X, "target", trees=6, depth=6).transform(test), "target"))


def test_random_search_repeats_and_takes_the_best(rows):
    train, test = rows
    drawn = {"maxDepth": (1, 6), "numTrees": [2, 5], "subsamplingRate": (0.5, 1.0)}
    assert models.drawn_parameters(drawn, 5, 1) == models.drawn_parameters(drawn, 5, 1) != models.drawn_parameters(drawn, 5, 2)
    assert all(1 <= p["maxDepth"] <= 6 and p["numTrees"] in (2, 5) and 0.5 <= p["subsamplingRate"] <= 1 for p in models.drawn_parameters(drawn, 30, 3))
    assert len(models.drawn_parameters({"maxDepth": [1, 2]}, 9, 1)) == 2
    model, scores = models.random_search(train, X, "three", {"maxDepth": [0, 5], "numTrees": [5]}, key="id", draws=4, folds=3)
    found = {r.params: r.score for r in scores.collect()}
    assert found['{"maxDepth": 5, "numTrees": 5}'] > found['{"maxDepth": 0, "numTrees": 5}'] and len(found) == 2
    assert model.stages[-1].getOrDefault("maxDepth") == 5 and hit(model.transform(test), "three") > 0.93
    fold = F.pmod(F.xxhash64("id", F.lit(42)), F.lit(3))
    by_hand = []
    for f in range(3):
        fitted = models.fit_forest(train.filter(fold != f), X, "three", trees=5, depth=5)
        by_hand.append(hit(fitted.transform(train.filter(fold == f)), "three"))
    assert found['{"maxDepth": 5, "numTrees": 5}'] == pytest.approx(np.mean(by_hand), abs=0.02)
    _, errors = models.random_search(train, X, "target", {"maxDepth": [1, 6]}, key="id", draws=2, folds=2, regression=True)
    assert all(r.score < 0 for r in errors.collect()) and errors.count() == 2
