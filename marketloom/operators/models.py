"""Models on Spark MLlib, and nearest neighbours.

Each fit takes a table with numeric feature columns and returns a fitted pipeline
model; ``transform`` adds predictions.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.sources.durable import durable
from marketloom.sources.tables import number_rows

def _fit(df: DataFrame, features: list[str], stage) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), stage]).fit(df)


def fit_forest(df: DataFrame, features: list[str], label: str, *, trees: int = 50, depth: int = 8, regression: bool = False, seed: int = 42) -> PipelineModel:
    kind = RandomForestRegressor if regression else RandomForestClassifier
    return _fit(df, features, kind(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed))


def fit_tree(df: DataFrame, features: list[str], label: str, *, depth: int = 5, criterion: str = "gini", regression: bool = False, seed: int = 42) -> PipelineModel:
    stage = DecisionTreeRegressor(labelCol=label, maxDepth=depth, seed=seed) if regression else DecisionTreeClassifier(labelCol=label, maxDepth=depth, impurity=criterion, seed=seed)
    return _fit(df, features, stage)


class OneAgainstRest:
    """Binary models, one per class; the class whose model is surest is predicted, the smallest on ties."""

    def __init__(self, models: list[PipelineModel]) -> None:
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        own = ["features", "rawPrediction", "probability", "prediction"]
        out = df
        for i, m in enumerate(self.models):
            out = m.transform(out).withColumn(f"__p{i}", vector_to_array("probability")[1]).drop(*own)
        sure = F.array(*[F.col(f"__p{i}") for i in range(len(self.models))])
        predicted = (F.array_position(sure, F.array_max(sure)) - 1).cast("double")
        return out.withColumn("prediction", predicted).drop(*[f"__p{i}" for i in range(len(self.models))])


def fit_boosted(df: DataFrame, features: list[str], label: str, *, rounds: int = 20, depth: int = 4, rate: float = 0.1, classes: int | None = None, validation: str | None = None, seed: int = 42):
    """Boosted trees: a regressor without ``classes``, a classifier for two, one against the rest for more.

    ``validation`` names a boolean column of rows that only decide when to stop;
    with one against the rest each class stops on its own.
    """
    options = {"maxIter": rounds, "maxDepth": depth, "stepSize": rate, "seed": seed}
    if validation:
        options["validationIndicatorCol"] = validation
    if classes is not None and classes > 2:
        own = (df.withColumn("__is", (F.col(label) == c).cast("double")) for c in range(classes))
        return OneAgainstRest([_fit(d, features, GBTClassifier(labelCol="__is", **options)) for d in own])
    return _fit(df, features, (GBTRegressor if classes is None else GBTClassifier)(labelCol=label, **options))


def fit_linear(df: DataFrame, features: list[str], label: str, *, kind: str = "logistic", classes: int = 2, regularisation: float = 0.0, iterations: int = 50) -> PipelineModel:
    if kind == "logistic":
        return _fit(df, features, LogisticRegression(labelCol=label, regParam=regularisation, maxIter=iterations))
    svm = LinearSVC(labelCol=label, regParam=regularisation, maxIter=iterations)
    return _fit(df, features, svm if classes <= 2 else OneVsRest(classifier=LinearSVC(regParam=regularisation, maxIter=iterations), labelCol=label))


def fit_bagging(df: DataFrame, features: list[str], label: str, *, trees: int = 20, share: float = 1.0, depth: int = 8, seed: int = 42) -> PipelineModel:
    """Regression trees over all features on bootstrap or subsample draws, averaged."""
    return _fit(df, features, RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", subsamplingRate=share, bootstrap=share >= 1.0, seed=seed))


def bagging_errors(train: DataFrame, test: DataFrame, features: list[str], label: str, counts: list[int], **options) -> DataFrame:
    """Mean squared test error by number of trees, from one fit: the first trees of the largest ensemble, averaged.

    The test rows are read once, whatever the number of counts.
    """
    model = fit_bagging(train, features, label, trees=max(counts), **options)
    *before, forest = model.stages
    scored = PipelineModel(before).transform(test)
    for i, tree in enumerate(forest.trees):
        scored = tree.setPredictionCol(f"__t{i}").transform(scored)
    first = lambda t: sum(F.col(f"__t{i}") for i in range(t)) / F.lit(float(t))
    errors = scored.agg(*[F.avg((F.col(label) - first(t)) ** 2).alias(f"mse_{t}") for t in counts])
    return errors.select(F.explode(F.array(*[F.struct(F.lit(t).alias("trees"), F.col(f"mse_{t}").alias("mse")) for t in counts])).alias("e")).select("e.*")


def drawn_parameters(distributions: dict[str, list | tuple], draws: int, seed: int) -> list[dict]:
    """Parameter sets: of a list one entry, of a pair ``(low, high)`` a number between them, whole if both are. The seed fixes them; equal sets count once."""
    rng, out, tries = np.random.default_rng(seed), [], 0
    while len(out) < draws and tries < 50 * draws:
        tries += 1
        one = {}
        for name, of in sorted(distributions.items()):
            if isinstance(of, list):
                one[name] = of[int(rng.integers(len(of)))]
            elif all(isinstance(x, int) for x in of):
                one[name] = int(rng.integers(of[0], of[1] + 1))
            else:
                one[name] = float(rng.uniform(*of))
        if one not in out:
            out.append(one)
    return out


def random_search(
    df: DataFrame, features: list[str], label: str, distributions: dict[str, list | tuple], *, key: str, draws: int = 10, folds: int = 3, seed: int = 42, regression: bool = False, parallelism: int = 4,
) -> tuple[PipelineModel, DataFrame]:
    """The best of randomly drawn forests by k-fold cross validation, fitted on all rows, and ``draw, params, score`` of every draw.

    ``distributions`` names parameters of MLlib's forests (``maxDepth``, ``numTrees``, ``subsamplingRate``,
    ...). A row's fold is a hash of ``key``. A model for each draw and fold is fitted, several at a time; all of them score the
    rows in one pass, each its own fold. The score is the mean over folds of accuracy, or of minus the root mean squared error.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(folds)).cast("int")
    data = durable(assembler.transform(df.withColumn("__fold", fold)).select("features", label, "__fold"))
    forest = (RandomForestRegressor if regression else RandomForestClassifier)(labelCol=label, seed=seed)
    sets = drawn_parameters(distributions, draws, seed)

    def fitted(job: tuple[int, int]):
        d, f = job
        own = forest.copy({forest.getParam(n): value for n, value in sets[d].items()})
        return own.fit(data.filter(F.col("__fold") != f))

    jobs = [(d, f) for d in range(len(sets)) for f in range(folds)]
    with ThreadPoolExecutor(parallelism) as pool:
        found = list(pool.map(fitted, jobs))
    scored, y = data, F.col(label)
    for (d, f), model in zip(jobs, found, strict=True):
        own = [model.setPredictionCol(f"__p_{d}_{f}")]
        if not regression:
            model.setRawPredictionCol("").setProbabilityCol("")
        scored = own[0].transform(scored)
    hit = lambda p: -F.pow(y - p, F.lit(2)) if regression else (y == p).cast("double")
    means = scored.agg(*[F.avg(F.when(F.col("__fold") == f, hit(F.col(f"__p_{d}_{f}")))).alias(f"s_{d}_{f}") for d, f in jobs]).first()
    each = [[means[f"s_{d}_{f}"] for f in range(folds)] for d in range(len(sets))]
    scores = [float(np.mean([-np.sqrt(-x) if regression else x for x in e if x is not None] or [np.nan])) for e in each]
    best = int(np.nanargmax(scores))
    model = forest.copy({forest.getParam(n): value for n, value in sets[best].items()}).fit(data)
    rows = [(d, json.dumps(sets[d], sort_keys=True), scores[d]) for d in range(len(sets))]
    return PipelineModel([assembler, model]), df.sparkSession.createDataFrame(rows, "draw int, params string, score double")


def grid_search(df: DataFrame, features: list[str], label: str, *, depths: list[int], trees: list[int], folds: int = 3, seed: int = 42, regression: bool = False, parallelism: int = 4) -> tuple[PipelineModel, DataFrame]:
    """The best forest by k-fold cross validation, and the mean score of every grid point. Vectors are assembled once."""
    data = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df).select("features", label).cache()
    forest = (RandomForestRegressor if regression else RandomForestClassifier)(labelCol=label, seed=seed)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, depths).addGrid(forest.numTrees, trees).build()
    judge = RegressionEvaluator(labelCol=label, metricName="rmse") if regression else MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy")
    fitted = CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, seed=seed, parallelism=parallelism).fit(data)
    data.unpersist()
    rows = [(int(p[forest.maxDepth]), int(p[forest.numTrees]), float(s)) for p, s in zip(grid, fitted.avgMetrics, strict=True)]
    return fitted.bestModel, df.sparkSession.createDataFrame(rows, "depth int, trees int, score double")


def impute_forest(df: DataFrame, cols: list[str], features: list[str], **options) -> DataFrame:
    """Fill nulls of each column by a forest fitted where it is known, on features whose nulls count as 0."""
    for c in cols:
        own = [f for f in features if f != c]
        filled = df.withColumns({f"__f_{f}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in own})
        model = fit_forest(filled.filter(F.col(c).isNotNull()), [f"__f_{f}" for f in own], c, regression=True, **options)
        df = model.transform(filled).withColumn(c, F.coalesce(c, "prediction")).drop("features", "prediction", *[f"__f_{f}" for f in own])
    return df


def importances(model: PipelineModel, spark, features: list[str]) -> DataFrame:
    """``feature, importance`` of a fitted tree model."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values, strict=True)), "feature string, importance double")


def permutation_importance(model: PipelineModel, df: DataFrame, features: list[str], label: str, key: str, seed: int = 42) -> DataFrame:
    """Loss of accuracy when one column's values are dealt out anew.

    Each row is paired with another by rank in two hash orders of the key, a
    random permutation that any rerun repeats and that all columns share; ranks
    come from range-partitioned numbering. Rows are scored once per column, as
    copies in which that column has the other row's value.
    """
    hashed = lambda salt: F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), F.col(key).cast("string")))
    own = number_rows(df.withColumn("__h", hashed("a")), ["__h", key], "__rank").drop("__h")
    other = number_rows(df.select(key, *features).withColumn("__h", hashed("b")), ["__h", key], "__rank")
    other = other.select("__rank", *[F.col(f).alias(f"__other_{f}") for f in features])
    paired = own.join(other, "__rank").withColumn("__swapped", F.explode(F.sequence(F.lit(-1), F.lit(len(features) - 1))))
    dealt = paired.withColumns({f: F.when(F.col("__swapped") == i, F.col(f"__other_{f}")).otherwise(F.col(f)) for i, f in enumerate(features)})
    hit = F.avg((F.col("prediction") == F.col(label)).cast("double"))
    scores = durable(model.transform(dealt).groupBy("__swapped").agg(hit.alias("a")))
    base = scores.filter("__swapped = -1").select(F.col("a").alias("base"))
    named = scores.filter("__swapped >= 0").withColumn("feature", F.array(*[F.lit(f) for f in features])[F.col("__swapped")])
    # one row of the score as it is
    return named.join(F.broadcast(base)).select("feature", (F.col("base") - F.col("a")).alias("importance"))


#: Rows of a block of training and of test vectors, between which a task computes distances.
TRAIN_ROWS, TEST_ROWS = 1 << 14, 1 << 11


def _nearest_in(k: int):
    """A function over a block of training and one of test rows: the ``k`` nearest in the block."""

    def find(train: pd.DataFrame, test: pd.DataFrame) -> pd.DataFrame:
        names = {"id": "int64", "neighbour": "int64", "distance": "float64", "label": "int32"}
        if not len(train) or not len(test):
            return pd.DataFrame({c: pd.Series(dtype=kind) for c, kind in names.items()})
        train = train.sort_values("id")
        own, y = train["id"].to_numpy(), train["label"].to_numpy()
        x, ids, found = np.array(train["v"].tolist(), float), test["asking"].to_numpy(), []
        q, most = np.array(test["w"].tolist(), float), min(k, len(own))
        squares = (x * x).sum(axis=1)
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            own_squares = (part * part).sum(axis=1)
            # distances by one matrix product; what rounding may have moved over the k-th is looked at exactly
            rough = squares + own_squares[:, None] - 2 * part @ x.T
            edge = np.partition(rough, most - 1, axis=1)[:, most - 1] + 1e-9 * (1 + own_squares + squares.max())
            rows, cols = np.nonzero(rough <= edge[:, None])
            exact = ((x[cols] - part[rows]) ** 2).sum(axis=1)
            order = np.lexsort((own[cols], exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            nth = np.arange(len(rows)) - np.searchsorted(rows, rows)
            keep = nth < most
            found.append(pd.DataFrame({"id": ids[at + rows[keep]], "neighbour": own[cols[keep]], "distance": exact[keep], "label": y[cols[keep]]}))
        return pd.concat(found)

    return find


#: Most pivots; they and a table of their distances go to all tasks.
PIVOTS = 256


class _Cells:
    """Pivots, the cells of training rows nearest to each, and which cells may hold a neighbour of a row."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        self.apart = np.sqrt(np.maximum(((pivots[:, None] - pivots[None]) ** 2).sum(axis=2), 0.0))
        self.count = np.zeros(len(pivots), np.int64)
        self.nearest, self.furthest = np.zeros(len(pivots)), np.zeros(len(pivots))

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([((x - p) ** 2).sum(axis=1) for p in self.pivots], axis=1))

    def first(self, d: np.ndarray, k: int) -> np.ndarray:
        """The cells of the nearest pivots that hold ``k`` rows together, as flags by row and cell."""
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(self.count[order], axis=1)
        flags = np.zeros(d.shape, bool)
        np.put_along_axis(flags, order, held - self.count[order] < k, axis=1)
        return flags & (self.count > 0)

    def least(self, d: np.ndarray) -> np.ndarray:
        """No row of a cell is nearer than this: by the cell's shell, and by the planes that part it from the other cells."""
        bound = np.maximum(np.maximum(d - self.furthest, self.nearest - d), 0.0)
        squares = d**2
        for j in range(len(self.pivots)):
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = (squares - squares[:, j : j + 1]) / (2 * self.apart[j])
            bound = np.maximum(bound, np.where(self.apart[j] > 0, plane, 0.0))
        return bound


def _vectors_of(values: pd.Series) -> np.ndarray:
    return np.array(values.tolist(), float)


def _meet(left: DataFrame, visits: DataFrame, k: int, train_rows: int, test_rows: int) -> DataFrame:
    """The ``k`` nearest of each visited cell: pieces of a cell meet blocks of the rows that visit it."""
    sizes = {r["cell"]: (-(-r["n"] // train_rows), -(-r["m"] // test_rows)) for r in (
        left.groupBy("cell").agg(F.count("*").alias("n")).join(visits.groupBy("cell").agg(F.count("*").alias("m")), "cell").collect()  # a row for each pivot
    )}
    table = left.sparkSession.createDataFrame([(c, n, m) for c, (n, m) in sizes.items()], "cell int, pieces int, blocks int")
    known, asked = left.join(F.broadcast(table), "cell"), visits.join(F.broadcast(table), "cell")
    cut = lambda of, n: F.pmod(F.xxhash64(of), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = known.withColumn("piece", cut("id", "pieces")).withColumn("block", every("blocks"))
    asked = asked.withColumn("block", cut("asking", "blocks")).withColumn("piece", every("pieces"))
    key = ["cell", "piece", "block"]
    met = known.select("id", "v", "label", *key).groupBy(*key).cogroup(asked.select("asking", "w", *key).groupBy(*key))
    return met.applyInPandas(_nearest_in(k), "id long, neighbour long, distance double, label int")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    return found.withColumn("__r", rank).filter(F.col("__r") <= k).drop("__r")


def nearest(
    train: DataFrame, test: DataFrame, k: int, vector: str = "embedding", label: str = "label", *, train_rows: int = TRAIN_ROWS, test_rows: int = TEST_ROWS, pivots: int | None = None,
) -> DataFrame:
    """``id, neighbour, distance, label``: the ``k`` nearest training rows of each test row by squared distance, ties to the smaller id.

    Training rows belong to the cell of the nearest of some pivots, rows drawn by a hash. A test row first
    visits the nearest cells that hold ``k`` rows; the distance of the k-th there bounds its search, and it goes on only to cells that can
    hold anything as near, by the triangle inequality. Cells are cut into pieces and their visitors
    into blocks, so that no group grows with the tables. Nothing but pivots and cell sizes passes the driver.
    """
    n_train = train.count()
    if not n_train:
        return test.sparkSession.createDataFrame([], "id long, neighbour long, distance double, label int")
    n_pivots = min(n_train, pivots or max(1, min(PIVOTS, int(n_train**0.5))))
    drawn = train.select("id", F.col(vector).alias("v")).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(n_pivots).collect()
    cells = _Cells(np.unique(np.array([r["v"] for r in drawn], float), axis=0))

    @F.pandas_udf("cell int, far double")
    def own_cell(v: pd.Series) -> pd.DataFrame:
        d = cells.distances(_vectors_of(v))
        return pd.DataFrame({"cell": d.argmin(axis=1).astype(np.int32), "far": d.min(axis=1)})

    left = durable(train.select("id", F.col(vector).alias("v"), F.col(label).cast("int").alias("label")).withColumn("own", own_cell("v")).select("id", "v", "label", "own.*"))
    for r in left.groupBy("cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high")).collect():
        cells.count[r["cell"]], cells.nearest[r["cell"]], cells.furthest[r["cell"]] = r["n"], r["low"], r["high"]

    @F.pandas_udf("array<int>")
    def first_cells(w: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(f).astype(np.int32) for f in cells.first(cells.distances(_vectors_of(w)), k)], dtype=object)

    @F.pandas_udf("array<int>")
    def more_cells(w: pd.Series, within: pd.Series) -> pd.Series:
        d = cells.distances(_vectors_of(w))
        tau = np.sqrt(within.fillna(np.inf).to_numpy(float))
        slack = 1e-7 * (1 + d.max(axis=1) + np.where(np.isinf(tau), 0.0, tau))  # for rounding
        flags = (cells.least(d) <= (tau + slack)[:, None]) & (cells.count > 0) & ~cells.first(d, k)
        return pd.Series([np.flatnonzero(f).astype(np.int32) for f in flags], dtype=object)

    asking = test.select(F.col("id").alias("asking"), F.col(vector).alias("w"))
    visits = asking.withColumn("cell", F.explode(first_cells("w")))
    near = durable(_best(_meet(left, visits, k, train_rows, test_rows), k))
    bound = near.groupBy("id").agg(F.max("distance").alias("within"), F.count("*").alias("n"))
    bounded = asking.join(bound.withColumnRenamed("id", "asking"), "asking", "left").withColumn("within", F.when(F.col("n") >= k, F.col("within")))
    further = durable(bounded.select("asking", "w", F.explode(more_cells("w", F.col("within").cast("double"))).alias("cell")))
    return _best(near.unionByName(_meet(left, further, k, train_rows, test_rows)), k)


def knn_classify(train: DataFrame, test: DataFrame, k: int, vector: str = "embedding", label: str = "label") -> DataFrame:
    """``id, predicted``: the most frequent label among the ``k`` nearest, the smallest on ties."""
    votes = nearest(train, test, k, vector, label).groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("predicted"))


def knn_sweep(train: DataFrame, test: DataFrame, ks: list[int], vector: str = "embedding", label: str = "label") -> DataFrame:
    """Accuracy by ``k`` from one search for the largest."""
    found = nearest(train, test, max(ks), vector, label)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "neighbour"))
    votes = found.withColumn("r", rank).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).filter("r <= k").groupBy("k", "id", "label").agg(F.count(F.lit(1)).alias("n"))
    said = votes.groupBy("k", "id").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("predicted"))
    truth = test.select("id", F.col(label).alias("y"))
    return said.join(truth, "id").groupBy("k").agg(F.avg((F.col("predicted") == F.col("y")).cast("double")).alias("accuracy"))
