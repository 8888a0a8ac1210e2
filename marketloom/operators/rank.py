"""Top-k, winners, latest and best values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_hours(df: DataFrame, k: int, pmax: float, ts: str = "ts", price: str = "price") -> DataFrame:
    """The best ``k`` hours of each day run at ``pmax``, the others at 0; of equal prices the earlier hour wins."""
    day = df.withColumn("day", F.to_date(ts))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(price), ts))
    return day.withColumn("production", F.when(rank <= k, F.lit(float(pmax))).otherwise(0.0))


def dispatch_summary(df: DataFrame, k: int, pmax: float, ts: str = "ts", price: str = "price") -> DataFrame:
    """Energy and price needed, with unlimited hours and with the best ``k`` a day."""
    run = top_hours(df, k, pmax, ts, price)
    days = run.groupBy("day").agg(F.sum("production").alias("energy"), F.avg(F.when(F.col("production") > 0, F.col(price))).alias("daily_price"), F.count(F.lit(1)).alias("hours"), F.sum(price).alias("all_price"))
    return days.agg(F.sum("energy").alias("energy_limited"), F.avg("daily_price").alias("price_limited"), (F.sum("hours") * F.lit(float(pmax))).alias("energy_unlimited"), (F.sum("all_price") / F.sum("hours")).alias("price_unlimited"))


def rank_one_hot(df: DataFrame, cols: list[str], constant_draw: str | None = None) -> DataFrame:
    """1 in the column with the largest value, 0 elsewhere; tied maxima leave all at 0. ``constant_draw`` is set to 0 and doesn't compete."""
    own = [c for c in cols if c != constant_draw]
    best = F.greatest(*[F.col(c) for c in own])
    alone = sum((F.coalesce((F.col(c) == best).cast("int"), F.lit(0)) for c in own), F.lit(0)) == 1
    out = {c: F.when(alone & (F.col(c) == best), 1).otherwise(0) for c in own}
    return df.withColumns(out | ({constant_draw: F.lit(0)} if constant_draw else {}))


def idxmax_label(df: DataFrame, cols: list[str], codes: dict[str, int], name: str = "outcome") -> DataFrame:
    """Code of the column with the largest value, the first one on ties."""
    best, out = F.greatest(*[F.col(c) for c in cols]), None
    for c in cols:
        out = F.when(F.col(c) == best, codes[c]) if out is None else out.when(F.col(c) == best, codes[c])
    return df.withColumn(name, out)


def rank_importance(df: DataFrame, feature: str = "feature", importance: str = "importance") -> DataFrame:
    """Importances by root feature (without an aggregate's suffix): sum, maximum, rank by maximum."""
    root = F.regexp_replace(feature, "(_mean|_std|_min|_max|_[0-9]+)+$", "")
    grouped = df.groupBy(root.alias("root")).agg(F.sum(importance).alias("total"), F.max(importance).alias("largest"))
    # one row per root feature
    return grouped.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("largest"), "root")))


def latest(df: DataFrame, key: str, ts: str, col: str) -> DataFrame:
    """The last value of each key."""
    return df.groupBy(key).agg(F.max_by(col, ts).alias(col), F.max(ts).alias(ts))


def best_by(df: DataFrame, key: str, parameter: str, score: str, largest: bool = True) -> DataFrame:
    """The parameter with the best score per key; the smallest one on ties."""
    order = F.struct(F.col(score) if largest else -F.col(score), -F.col(parameter))
    return df.groupBy(key).agg(F.max_by(parameter, order).alias(parameter), (F.max if largest else F.min)(score).alias(score))
