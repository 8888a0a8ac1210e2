"""Model outputs: probabilities, thresholds, scores and reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.order_statistics import exact_quantile
from marketloom.operators.pricing import norm_cdf
from marketloom.sources.tables import running

_c = F.col


def softmax(scores: Column) -> Column:
    """Probabilities of a score array; the maximum is taken out first."""
    raised = F.transform(scores, lambda x: F.exp(x.cast("double") - F.array_max(scores).cast("double")))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def softmax_argmax(df: DataFrame, scores: str) -> DataFrame:
    """Columns ``proba`` and ``predicted``: the first class with the largest score."""
    s = _c(scores)
    return df.withColumn("predicted", (F.array_position(s, F.array_max(s)) - 1).cast("int")).withColumn("proba", softmax(s))


def proba_details(df: DataFrame, proba: str, classes: int = 0) -> DataFrame:
    """Largest and second probability, their margin, entropy (natural log), and ``class_i_prob`` columns."""
    p = _c(proba)
    ordered = F.array_sort(p)
    entropy = -F.aggregate(p, F.lit(0.0), lambda a, x: a + F.when(x > 0, x * F.ln(x)).otherwise(0.0))
    top, second = F.element_at(ordered, -1), F.element_at(ordered, -2)
    return df.withColumns({"max_prob": top, "second_prob": second, "margin": top - second, "entropy": entropy} | {f"class_{i}_prob": p[i] for i in range(classes)})


def pseudo_labels(df: DataFrame, features: DataFrame, t: float, key: str = "id", predicted: str = "predicted") -> DataFrame:
    """Confident predictions as labels, joined to their features."""
    return df.filter(_c("max_prob") >= t).select(key, _c(predicted).alias("label"), "max_prob").join(features, key)


def override_low_confidence(df: DataFrame, t: float, cls: int, predicted: str = "predicted") -> DataFrame:
    return df.withColumn(predicted, F.when(_c("max_prob") < t, F.lit(cls)).otherwise(_c(predicted)))


def accuracy(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    hit = F.avg((_c(y) == _c(p)).cast("double"))
    return df.agg(hit.alias("accuracy"), (F.lit(1.0) - hit).alias("error_rate"), F.count(F.lit(1)).alias("n"))


def constant_baseline(df: DataFrame, cls: int, y: str = "y") -> DataFrame:
    return df.agg(F.avg((_c(y) == cls).cast("double")).alias("accuracy"))


def confusion_matrix(df: DataFrame, y: str = "y", p: str = "p", normalize: bool = False) -> DataFrame:
    """``y, p, n`` over the whole class grid, with ``share`` of the true class if wanted. Sizes go with the classes."""
    counts = df.groupBy(_c(y).alias("y"), _c(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    classes = counts.select(F.explode(F.array("y", "p")).alias("c")).filter("c IS NOT NULL").distinct()
    grid = classes.select(_c("c").alias("y")).join(F.broadcast(classes.select(_c("c").alias("p"))))
    full = grid.join(counts, ["y", "p"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    if not normalize:
        return full
    return full.withColumn("share", F.coalesce(F.try_divide(_c("n"), F.sum("n").over(Window.partitionBy("y"))), F.lit(0.0)))


def classification_report(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 and support by class, and their macro and weighted means (class ``macro avg``, ``weighted avg``).

    Counts of (true, predicted) are dealt to both classes at once; the means are
    weighted sums over the classes, so that the table is read and counted once.
    """
    counts = df.groupBy(_c(y).alias("y"), _c(p).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("long")
    true = F.struct(_c("y").alias("c"), F.when(_c("y") == _c("p"), _c("n")).otherwise(none).alias("tp"), _c("n").alias("support"), none.alias("predicted"))
    said = F.struct(_c("p").alias("c"), none.alias("tp"), none.alias("support"), _c("n").alias("predicted"))
    dealt = counts.select(F.explode(F.array(true, said)).alias("x")).select("x.*").filter("c IS NOT NULL").groupBy("c").agg(*[F.sum(k).alias(k) for k in ("tp", "support", "predicted")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    rows = dealt.select(_c("c").cast("string").alias("class"), ratio(_c("tp"), _c("predicted")).alias("precision"), ratio(_c("tp"), _c("support")).alias("recall"), "support")
    rows = rows.withColumn("f1", ratio(2 * _c("precision") * _c("recall"), _c("precision") + _c("recall")))
    shares = F.array(*[F.struct(name.alias("name"), w.cast("double").alias("w")) for name, w in ((_c("class"), F.lit(1)), (F.lit("macro avg"), F.lit(1)), (F.lit("weighted avg"), _c("support")))])
    spread = rows.withColumn("x", F.explode(shares))
    means = [F.try_divide(F.sum(_c(k) * _c("x.w")), F.sum("x.w")).alias(k) for k in ("precision", "recall", "f1")]
    return spread.groupBy(_c("x.name").alias("class")).agg(*means, F.sum("support").alias("support"))


def log_loss(df: DataFrame, proba: str = "proba", y: str = "y", eps: float = 1e-15) -> DataFrame:
    p = F.get(_c(proba), _c(y).cast("int"))
    return df.agg((-F.avg(F.ln(F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))))).alias("log_loss"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    e = _c(y) - _c(p)
    out = df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("sse"), (F.var_pop(y) * F.count(y)).alias("__sst"))
    return out.withColumn("r2", F.lit(1.0) - F.try_divide("sse", "__sst")).drop("__sst")


def calibrate_threshold(df: DataFrame, score: str, target: float, exact: bool = True) -> DataFrame:
    """``alpha``: the smallest score size such that at least the target share of ``|score|`` lies at or below it.

    The exact form refines counts in a few passes over ``df``, and no task holds the sizes;
    ``exact=False`` takes Spark's percentile sketch (accuracy 1/10,000 of the ranks) in one pass.
    """
    size = df.select(F.abs(score).alias("a")).filter("a IS NOT NULL")
    if not exact:
        return size.agg(F.percentile_approx("a", target, 10_000).alias("alpha"))
    found = exact_quantile(size, "a", float(target))
    kind = size.schema["a"].dataType.simpleString()
    return df.sparkSession.range(1).select(F.lit(found).cast(kind).alias("alpha"))


def threshold_outcome(df: DataFrame, score: str, alpha: float | Column) -> DataFrame:
    """Home from ``alpha`` on, away down from ``-alpha`` on, draw between."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    s = _c(score)
    return df.withColumns({"home_wins": (s >= a).cast("int"), "draw": ((s < a) & (s > -a)).cast("int"), "away_wins": ((s <= -a) & ~(s >= a)).cast("int")})


def run_summary(df: DataFrame, model: str = "model", score: str = "score") -> DataFrame:
    return df.groupBy(model).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.count(F.lit(1)).alias("n"))


#: Up to so many differences without ties the exact distribution of the rank sum is used.
EXACT_RANKS = 50


def rank_sum_shares(most: int) -> list[tuple[int, int, float]]:
    """``n, statistic, p``: for up to ``most`` ranks with random signs, twice the chance of a rank sum at most the statistic (1 at most)."""
    ways, out = np.array([1.0]), []
    for n in range(1, most + 1):
        longer = np.zeros(len(ways) + n)
        longer[: len(ways)] += ways
        longer[n:] += ways
        ways = longer
        below = np.cumsum(ways) / 2.0**n
        out += [(n, t, min(1.0, 2 * float(below[t]))) for t in range(n * (n + 1) // 4 + 1)]
    return out


def wilcoxon(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """Signed-rank test of paired scores: ``statistic``, ``n`` and the two-sided ``p_value``; zero differences are left out.

    The statistic is the smaller sum of average ranks of ``|a - b|``. Without ties and up to ``EXACT_RANKS`` differences the
    p-value comes from the exact distribution, otherwise from the normal form with the variance corrected for ties; without any spread it is null.
    """
    by = by or []
    d = df.select(*by, (_c(a) - _c(b)).alias("d")).filter("d <> 0")
    # ties share the mean of their ranks: one row per size of difference is ranked, by a running count
    sizes = d.groupBy(*by, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(_c("d") > 0, 1)).alias("n_up"))
    ranked = running(sizes, by, ["size"], sums={"upto": "n"})
    rank = _c("upto") - (_c("n") - 1) / F.lit(2.0)
    up, down, m = F.sum(rank * _c("n_up")), F.sum(rank * (_c("n") - _c("n_up"))), _c("n").cast("double")
    summed = ranked.groupBy(*by).agg(F.least(up, down).alias("statistic"), F.sum("n").alias("n"), F.sum(m * m * m - m).alias("__ties"))
    # a table of at most EXACT_RANKS ** 3 / 12 rows
    table = df.sparkSession.createDataFrame(rank_sum_shares(EXACT_RANKS), "__n int, __t int, __exact double")
    joined = summed.join(F.broadcast(table), (_c("n") == _c("__n")) & (_c("statistic") == _c("__t")) & (_c("__ties") == 0), "left")
    n = _c("n").cast("double")
    spread = F.sqrt((n * (n + 1) * (2 * n + 1) - _c("__ties") / 2) / 24)
    z = F.try_divide(F.lit(0.0) - F.abs(_c("statistic") - n * (n + 1) / 4), spread)
    return joined.select(*by, "statistic", "n", F.coalesce("__exact", F.least(F.lit(1.0), 2 * norm_cdf(z))).alias("p_value"))


def multilabel_targets(pixels: DataFrame, annotated: DataFrame, n: int) -> DataFrame:
    """``picture, label, target`` for labels 1..n: 1 if present, 0 if annotated but absent, null where not annotated."""
    pictures = pixels.select("picture").unionByName(annotated.select("picture")).distinct()
    grid = pictures.withColumn("label", F.explode(F.sequence(F.lit(1), F.lit(n))))
    seen = pixels.select("picture", _c("label").cast("int").alias("label")).distinct().withColumn("__seen", F.lit(1))
    known = annotated.select("picture", _c("label").cast("int").alias("label")).distinct().withColumn("__known", F.lit(1))
    joined = grid.join(seen, ["picture", "label"], "left").join(known, ["picture", "label"], "left")
    return joined.select("picture", "label", F.when(_c("__known") == 1, F.coalesce("__seen", F.lit(0))).alias("target"))


def split_annotated(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Targets of pictures with any annotated label, and of those with none."""
    any_known = targets.filter("target IS NOT NULL").select("picture").distinct()
    return targets.join(any_known, "picture", "left_semi"), targets.join(any_known, "picture", "left_anti")


def masked_mean(df: DataFrame, col: str) -> DataFrame:
    """Mean without nulls and NaN."""
    return df.agg(F.avg(F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))).alias("mean"), F.count(F.nanvl(_c(col).cast("double"), F.lit(None).cast("double"))).alias("n"))


def early_stop(history: DataFrame, patience: int, by: str = "run", epoch: str = "epoch", loss: str = "loss") -> DataFrame:
    """``best_epoch, best_loss, stop_epoch`` per run: stop at the first epoch with ``patience`` epochs since an improvement, null if it never comes."""
    w = Window.partitionBy(by).orderBy(epoch)
    before = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = history.withColumn("__n", F.row_number().over(w)).withColumn("__up", F.when(before.isNull() | (_c(loss) < before), F.row_number().over(w)))
    since = better.withColumn("__since", _c("__n") - F.max("__up").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stops = since.withColumn("__stop", F.min(F.when(_c("__since") >= patience, _c("__n"))).over(Window.partitionBy(by)))
    seen = stops.filter(_c("__stop").isNull() | (_c("__n") <= _c("__stop")))
    return seen.groupBy(by).agg(F.min_by(epoch, F.struct(_c(loss), _c(epoch))).alias("best_epoch"), F.min(loss).alias("best_loss"), F.min(F.when(_c("__n") == _c("__stop"), _c(epoch))).alias("stop_epoch"))
