"""Order statistics by refined brackets, and nearest neighbours by pivots, against sorting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.operators import evaluate, models, pricing
from marketloom.operators.order_statistics import exact_quantile, order_statistics


@pytest.mark.parametrize("kind", ["normal", "ties", "two", "heavy"])
def test_ranks_equal_sorting(spark, kind):
    r = np.random.default_rng(2)
    x = {"normal": r.normal(size=20_000), "ties": np.floor(r.exponential(3, 20_000)), "two": (r.random(20_000) < 0.3) * 1.0, "heavy": np.where(r.random(20_000) < 0.4, 7.0, r.pareto(0.3, 20_000))}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").repartition(5).cache()
    ranks = [0, 1, 137, 6000, 9_999, 10_000, 19_998, 19_999, 20_000, -1]
    found, n = order_statistics(df, "x", ranks, accuracy=50, few=40)
    want = np.sort(x)
    assert n == 20_000 and found == [*want[ranks[:-2]].tolist(), None, None]


def test_quantiles(spark):
    df = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2, 10)], "x double")
    assert exact_quantile(df, "x", 0.4) == 2.0 and exact_quantile(df, "x", 0.41) == 3.0 and exact_quantile(df, "x", 0.0) == 1.0
    assert exact_quantile(df, "x", 0.9, interpolated=True) == pytest.approx(np.quantile([4, 1, 3, 2, 10], 0.9))
    assert exact_quantile(df.filter("false"), "x", 0.5) is None
    assert evaluate.calibrate_threshold(df.filter("false"), "x", 0.5).first()[0] is None


def test_no_task_holds_the_values(spark):
    df = spark.range(1000).select("id", F.col("id").alias("sim_id"), F.sin("id").alias("a"))
    plans = [evaluate.calibrate_threshold(df, "a", 0.3), pricing.portfolio_var(df, {"a": 2}, 0.95)]
    for out in plans:
        assert "percentile" not in out._jdf.queryExecution().executedPlan().toString()
    want = np.quantile(2 * np.sin(np.arange(1000)), 1 - 0.95)
    assert plans[1].first().value_at_risk == pytest.approx(want, abs=1e-12)


# --- nearest neighbours -----------------------------------------------------


def plain_nearest(x, q, k):
    d = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    return [[(int(j), float(row[j])) for j in np.lexsort((np.arange(len(x)), row))[:k]] for row in d]


@pytest.mark.parametrize("kind, pivots", [("clusters", 12), ("uniform", 9), ("copies", 5), ("uniform", 1)])
def test_nearest_equal_brute_force(spark, kind, pivots):
    r = np.random.default_rng(4)
    x = {"clusters": r.normal(size=(600, 4)) * 0.1 + r.integers(0, 8, (600, 4)), "uniform": r.random((600, 3)), "copies": np.where(r.random((600, 1)) < 0.4, 0.5, np.round(r.random((600, 2)), 1))}[kind]
    x = np.round(x, 3)
    q = np.concatenate((x[:40], x[40:80] + 0.01))
    vectors = lambda a: spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(a)], "id long, embedding array<double>, label int").repartition(3)
    found = models.nearest(vectors(x), vectors(q), 7, train_rows=100, test_rows=16, pivots=pivots).collect()
    got = {}
    for row in found:
        got.setdefault(row.id, []).append((row.distance, row.neighbour))
    for i, want in enumerate(plain_nearest(x, q, 7)):
        have = sorted(got[i])
        assert [n for _, n in have] == [n for n, _ in want] and [d for d, _ in have] == pytest.approx([d for _, d in want])


def test_few_rows_or_none(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [0.0, 1.0], 1)], "id long, embedding array<double>, label int")
    assert models.nearest(rows, rows, 5).count() == 4
    assert models.nearest(rows.filter("false"), rows, 5).count() == models.nearest(rows, rows.filter("false"), 5).count() == 0


def test_cells_leave_most_rows_out():
    """Of clustered rows a search looks at few cells."""
    r = np.random.default_rng(6)
    x = r.normal(size=(4000, 16)) * 0.05 + r.integers(0, 2, (40, 16))[r.integers(0, 40, 4000)]
    cells = models._Cells(x[:60])
    d = cells.distances(x)
    own = d.argmin(axis=1)
    for c in range(60):
        cells.count[c], cells.nearest[c], cells.furthest[c] = (own == c).sum(), d[own == c, c].min(initial=np.inf), d[own == c, c].max(initial=0)
    q = d[:200]
    tau = np.sqrt(np.sort(((x[:200, None] - x[None]) ** 2).sum(axis=2), axis=1)[:, 4])
    assert (cells.least(q) <= tau[:, None] + 1e-9).mean() < 0.2


# --- signed ranks -----------------------------------------------------------


def test_signed_rank_p_values(spark):
    from itertools import product

    exact = {(n, t): p for n, t, p in evaluate.rank_sum_shares(9)}
    for n in (1, 4, 9):
        sums = np.array([sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in product((0, 1), repeat=n)])
        for t in range(n * (n + 1) // 4 + 1):
            assert exact[n, t] == pytest.approx(min(1.0, 2 * (sums <= t).mean()))
    d = [1.1, -2.3, 3.7, 4.2, -5.9, 6.1, 7.8, 8.4]  # ranks 2 and 5 are negative
    tied = [1.0, 1.0, -1.0, 2.0, 3.0, 3.0, 0.0]
    many = [(-1.0 if i % 3 == 0 else 1.0) * (i + 0.5) for i in range(60)]
    rows = [("exact", x, 0.0) for x in d] + [("tied", x, 0.0) for x in tied] + [("many", x, 0.0) for x in many] + [("none", 1.0, 1.0)]
    got = {r.g: r for r in evaluate.wilcoxon(spark.createDataFrame(rows, "g string, a double, b double"), "a", "b", ["g"]).collect()}
    assert "none" not in got
    assert (got["exact"].statistic, got["exact"].n) == (7.0, 8) and got["exact"].p_value == pytest.approx(0.1484375)
    cdf = lambda z: 0.5 * (1 + math.erf(z / math.sqrt(2)))
    # six differences of which three share rank 2 and two rank 5.5
    assert got["tied"].statistic == 2.0
    assert got["tied"].p_value == pytest.approx(2 * cdf(-(abs(2 - 10.5)) / math.sqrt((6 * 7 * 13 - (24 + 6) / 2) / 24)))
    down = sum(i + 1 for i in range(60) if i % 3 == 0)
    assert got["many"].p_value == pytest.approx(2 * cdf(-abs(down - 60 * 61 / 4) / math.sqrt(60 * 61 * 121 / 24)))
