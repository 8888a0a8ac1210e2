"""Aggregates over series, classes, times and column pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.clean import signed_log
from marketloom.sources.tables import rank_within

KEY, ORDER = "obs_id", "event_idx"

#: Named aggregates of one column; a caller can hand in others.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum, "median": F.median, "std_pop": F.stddev_pop,
    "q25": lambda c: F.percentile(c, 0.25), "pct25": lambda c: F.percentile(c, 0.25), "pct75": lambda c: F.percentile(c, 0.75),
    "skew": lambda c: corrected_skewness(c), "q75": lambda c: F.percentile(c, 0.75), "last": lambda c: F.max_by(c, F.col(ORDER)), "first": lambda c: F.min_by(c, F.col(ORDER)),
}


def series_aggregate(df: DataFrame, cols: list[str], functions: dict[str, Callable[[Column], Column]] | list[str], key: str = KEY) -> DataFrame:
    """``<column>_<name>`` for each column and aggregate, one row per series. Null keys are left out."""
    named = functions if isinstance(functions, dict) else {n: AGGREGATES[n] for n in functions}
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[f(F.col(c)).alias(f"{c}_{n}") for c in cols for n, f in named.items()])


def summarize_series(df: DataFrame, spec: dict[str, list[str]], key: str = KEY) -> DataFrame:
    """A choice of aggregates per column."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[AGGREGATES[n](F.col(c)).alias(f"{c}_{n}") for c, names in spec.items() for n in names])


def corrected_skewness(col: str | Column) -> Column:
    """Bias-corrected skewness; 0 with fewer than three values or without spread."""
    n, spread = F.count(col).cast("double"), F.stddev_pop(col)
    return F.when((n >= 3) & (spread > 0), F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)


def corrected_kurtosis(col: str) -> Column:
    """Bias-corrected excess kurtosis; 0 with fewer than four values or without spread."""
    n, spread = F.count(col).cast("double"), F.stddev_pop(col)
    return F.when((n >= 4) & (spread > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6)).otherwise(0.0)


def series_moments(df: DataFrame, cols: list[str], key: str = KEY) -> DataFrame:
    return df.groupBy(key).agg(*[x for c in cols for x in (corrected_skewness(c).alias(f"{c}_skew"), corrected_kurtosis(c).alias(f"{c}_kurt"))])


def category_shares(df: DataFrame, cols: dict[str, list], key: str = KEY) -> DataFrame:
    """Share of each listed category in a series, as columns ``<column>_<category>``."""
    return df.groupBy(key).agg(*[F.avg(F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))).alias(f"{c}_{v}") for c, values in cols.items() for v in values])


def sequence_aggregates(df: DataFrame, cols: list[str], key: str = KEY) -> DataFrame:
    """Last value, median, quartiles and population deviation per series."""
    return series_aggregate(df, cols, ["last", "median", "q25", "q75", "std_pop"], key)


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation from sums; null where a side has no spread.

    Squares are taken around the mean of the whole column by Spark's own
    covariance, so that large levels don't cancel.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    # rounding may leave a constant column a little deviation: ends tell for sure
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.when(varies & (spread > 0), spread))


def autocorr1(df: DataFrame, col: str, key: str = KEY, order: str = ORDER) -> DataFrame:
    """Correlation of a series with itself one event before; 0 if there is none."""
    lagged = df.select(key, F.col(col).alias("__x"), F.lag(col).over(Window.partitionBy(key).orderBy(order)).alias("__y"))
    return lagged.groupBy(key).agg(F.coalesce(guarded_corr(F.col("__x"), F.col("__y")), F.lit(0.0)).alias(f"{col}_autocorr1"))


def class_stats(df: DataFrame, group: str, cols: list[str]) -> DataFrame:
    return df.groupBy(group).agg(*[x for c in cols for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def class_balance(df: DataFrame, col: str) -> DataFrame:
    """Rows of each class and their share; one row per class passes the total's window."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def mean_by_time(df: DataFrame, ts: str, key: str, col: str) -> DataFrame:
    """One mean per time and key."""
    return df.groupBy(ts, key).agg(F.avg(col).alias(col))


def pivot_wide(df: DataFrame, ts: str, key: str, col: str, prefix: str, values: list) -> DataFrame:
    """One row per time and one column per listed key value."""
    return df.groupBy(ts).agg(*[F.first(F.when(F.col(key) == v, F.col(col)), ignorenulls=True).alias(f"{prefix}{v}") for v in values])


def drift_volatility(returns: DataFrame, key: str, col: str = "log_return", days: int = 252) -> DataFrame:
    """Annual drift, volatility and risk-adjusted drift of daily log returns."""
    out = returns.groupBy(key).agg((F.avg(col) * days).alias("mu"), (F.stddev_samp(col) * F.sqrt(F.lit(float(days)))).alias("sigma"))
    return out.withColumn("adjusted_drift", F.col("mu") - F.col("sigma") * F.col("sigma") / 2)


def _number(col: str) -> Column:
    """A column as double; NaN counts as missing, as null does."""
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def correlation_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """``i, j, left_col, right_col, corr`` (absolute) for column pairs i < j, in one pass.

    A pair is judged by the rows that have both values; null for a column
    without spread there.
    """
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = df.agg(*[guarded_corr(_number(cols[i]), _number(cols[j])).alias(f"c{i}_{j}") for i, j in pairs])
    names = lambda i, j: (F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(cols[i]).alias("left_col"), F.lit(cols[j]).alias("right_col"))
    items = [F.struct(*names(i, j), F.abs(f"c{i}_{j}").alias("corr")) for i, j in pairs]
    return row.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def gram_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """The same rows for many columns: sums over the rows that have both values, by matrix products in numpy.

    Columns are shifted by their means first, which takes one more pass, so that
    large levels don't cancel.
    """
    import numpy as np
    import pandas as pd

    plain = df.select(*[_number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    means = [m or 0.0 for m in plain.agg(*[F.avg(f"c{i}") for i in range(len(cols))]).first()]
    left, right = np.triu_indices(len(cols), 1)

    def partial(batches):
        total = np.zeros((6, len(left)))
        for batch in batches:
            x = batch.to_numpy(float) - means
            present = ~np.isnan(x)
            x, m = np.where(present, x, 0.0), present.astype(float)
            level, square = x.T @ m, (x * x).T @ m  # [i, j]: over the rows that have j
            cells = (m.T @ m)[left, right], level[left, right], level[right, left], square[left, right], square[right, left], (x.T @ x)[left, right]
            total += np.stack(cells)
        yield pd.DataFrame({"i": left.astype("int32"), "j": right.astype("int32")} | dict(zip(("n", "x", "y", "xx", "yy", "xy"), total, strict=True)))

    sums = plain.mapInPandas(partial, "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    s = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    varying = lambda a, aa: F.greatest(F.lit(0.0), F.try_divide(F.col(aa), F.col("n")) - F.try_divide(F.col(a), F.col("n")) ** 2)
    # what rounding leaves of a constant column is no spread
    has_spread = lambda a, aa: varying(a, aa) > 1e-14 * F.try_divide(F.col(aa), F.col("n"))
    cov = F.try_divide(F.col("xy"), F.col("n")) - F.try_divide(F.col("x") * F.col("y"), F.col("n") * F.col("n"))
    spread = F.when(has_spread("x", "xx") & has_spread("y", "yy"), F.sqrt(varying("x", "xx") * varying("y", "yy")))
    names = F.array(*[F.lit(c) for c in cols])
    return s.select("i", "j", names[F.col("i")].alias("left_col"), names[F.col("j")].alias("right_col"), F.abs(F.try_divide(cov, spread)).alias("corr"))


def correlation_prune(df: DataFrame, cols: list[str], threshold: float, sample: int | None = None, wide_from: int = 60) -> list[str]:
    """Columns to drop: those with a correlation above the threshold to any earlier column, dropped or not.

    Reads back the dropped names. ``sample`` is an optional cap on rows; the
    default looks at all. From ``wide_from`` columns on the sums are taken by
    matrix products; the rule is the same.
    """
    rows = df if sample is None else df.limit(sample)
    pairs = (gram_pairs if len(cols) > wide_from else correlation_pairs)(rows, cols)
    dropped = {r["right_col"] for r in pairs.filter(F.col("corr") > threshold).select("right_col").distinct().collect()}
    return [c for c in cols if c in dropped]


def skew_screen(df: DataFrame, cols: list[str], t: float) -> list[str]:
    """Columns whose absolute population skewness exceeds ``t``; reads back one row."""
    row = df.agg(*[F.when(F.stddev_pop(c) > 0, F.abs(F.skewness(c))).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] > t]


def log_skewed(df: DataFrame, cols: list[str]) -> DataFrame:
    """Log copies of screened columns; the same list serves train and test."""
    return df.withColumns({f"log_{c}": signed_log(F.col(c)) for c in cols})


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal-width bins from 0; the maximum belongs to the last bin. Bins without rows are left out."""
    ends = df.agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"))
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(col) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0)) * bins)).cast("int")
    return df.filter(F.col(col).isNotNull()).join(F.broadcast(ends)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, group: str, col: str) -> DataFrame:
    """Minimum, quartiles and maximum per class (exact, linear between ranks).

    Values are ranked in range partitions and only the ranks next to a quartile
    are gathered, so that no task holds a class.
    """
    ranked = rank_within(df.select(group, col), [group], [F.asc_nulls_last(col)], "__rank")
    known = ranked.groupBy(F.col(group).alias("__g")).agg(F.count(col).alias("__known"), F.min(col).alias("min"), F.max(col).alias("max"))
    both = ranked.join(known, F.col(group).eqNullSafe(F.col("__g")))
    place = {n: (F.col("__known") - 1) * F.lit(q) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("__rank") == rank, F.col(col)))

    ends = [x for n, p in place.items() for x in (at(F.floor(p)).alias(f"{n}_lo"), at(F.ceil(p)).alias(f"{n}_hi"), F.max(p - F.floor(p)).alias(f"{n}_f"))]
    found = both.groupBy(group).agg(F.first("min").alias("min"), *ends, F.first("max").alias("max"))
    between = [(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_f")).alias(n) for n in place]
    return found.select(group, "min", *between, "max")
