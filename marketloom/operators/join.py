"""Joins and set operations between tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions.clean import prefix_columns
from marketloom.operators.aggregate import class_stats
from marketloom.sources.tables import running


def with_labels(df: DataFrame, labels: DataFrame, key: str = "obs_id") -> DataFrame:
    """Events with their series' label; series without one are left out."""
    return df.join(labels, key, "inner")


def outlier_series(df: DataFrame, group: str, cols: list[str], t: float, key: str = "obs_id") -> DataFrame:
    """Ids of series with a value more than ``t`` deviations from its class mean.

    Statistics are one row per class; rows are never shuffled by class.
    """
    stats = class_stats(df, group, cols).withColumnRenamed(group, "__group")
    # classes are few by definition of a class label; the optimizer decides how to join
    joined = df.join(stats, F.col(group) == F.col("__group"), "left")
    far = reduce(lambda a, b: a | b, [F.coalesce(F.abs(F.col(c) - F.col(f"{c}_mean")) > F.lit(t) * F.col(f"{c}_std"), F.lit(False)) for c in cols])
    return joined.filter(far).select(key).distinct()


def remove_outlier_series(df: DataFrame, group: str, cols: list[str], t: float, key: str = "obs_id", enabled: bool = True) -> DataFrame:
    """Without every series that holds an outlier in any column; ``enabled=False`` keeps all."""
    return df.join(outlier_series(df, group, cols, t, key), key, "left_anti") if enabled else df


def outer_join_all(dfs: list[DataFrame], on: str) -> DataFrame:
    """Full outer join of tables with one row per key: stacked and aggregated once, instead of a chain of joins.

    Rows without a key match nothing and stay on their own, as in an outer join.
    A column name that an earlier table has gets the number of its table behind it.
    """
    names, taken = [], {on}
    for i, d in enumerate(dfs):
        for c in d.columns:
            if c != on:
                out = f"{c}_{i}" if c in taken else c
                taken.add(out)
                names.append((i, c, out))
    kinds = {(i, f.name): f.dataType for i, d in enumerate(dfs) for f in d.schema}
    parts = []
    for i, d in enumerate(dfs):
        values = [F.col(c).alias(out) if i == j else F.lit(None).cast(kinds[j, c]).alias(out) for j, c, out in names]
        parts.append(d.select(on, F.lit(i).alias("__table"), *values))
    stacked = reduce(DataFrame.unionByName, parts)
    alone = F.when(F.col(on).isNull(), F.struct("__table", F.monotonically_increasing_id().alias("row")))
    merged = stacked.withColumn("__alone", alone).groupBy(on, "__alone").agg(*[F.first(out, ignorenulls=True).alias(out) for *_, out in names])
    return merged.drop("__alone")


def join_sides(home: DataFrame, away: DataFrame, key: str = "id") -> DataFrame:
    """Home and away statistics of a match side by side, with prefixes."""
    return prefix_columns(home, "HOME_", keep=(key,)).join(prefix_columns(away, "AWAY_", keep=(key,)), key)


def align_labels(labels: DataFrame, df: DataFrame, key: str = "id") -> DataFrame:
    """Labels of the ids that survived."""
    return labels.join(df.select(key), key, "left_semi")


def intersect_prices(bids: DataFrame, asks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Prices, rounded to cents, that both sides quote."""
    cols = by or []
    return bids.select(*cols, F.round("price", 2).alias("price")).intersect(asks.select(*cols, F.round("price", 2).alias("price")))


def interpolate(curve: DataFrame, points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Linear interpolation of a curve at query points by key; ends are held. Curve points win ties."""
    own = curve.select(key, F.col(x).alias("__x"), F.col(y).alias("__y"), F.lit(0).alias("__q"), F.lit(None).cast("long").alias("point_id"))
    ask = points.select(key, F.col(x).alias("__x"), F.lit(None).cast("double").alias("__y"), F.lit(1).alias("__q"), "point_id")
    pair = F.when(F.col("__y").isNotNull(), F.struct("__x", "__y"))
    both = own.unionByName(ask).withColumn("__point", pair)
    # a point at the query's own x comes before it: it is then the left end, and its share of the right one is 0
    both = running(both, [key], ["__x", "__q"], lasts={"__a": "__point"}, nexts={"__b": "__point"}).filter("__q = 1")
    x0, y0, x1, y1 = F.col("__a.__x"), F.col("__a.__y"), F.col("__b.__x"), F.col("__b.__y")
    between = y0 + (y1 - y0) * F.coalesce(F.try_divide(F.col("__x") - x0, x1 - x0), F.lit(0.0))
    return both.select(key, "point_id", F.col("__x").alias(x), F.when(F.col("__a").isNull(), y1).when(F.col("__b").isNull(), y0).otherwise(between).alias(y))
