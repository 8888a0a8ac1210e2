"""Window features over event series.

Every function takes the series key and the order column (``obs_id`` and
``event_idx`` unless told otherwise). Windows that share them share one exchange
and one sort; the second key of order dynamics is a superset of the first and
needs no exchange of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.clean import EPS, signed_log
from marketloom.sources.tables import number_rows, running

#: Rows at the ends of partitions that a whole-table difference broadcasts; more are joined by a shuffle.
MOST_TAILS = 1 << 18
KEY, ORDER = "obs_id", "event_idx"
_c = F.col


def series(key=KEY, order=ORDER):
    return Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order)


def last_n(n: int, key=KEY, order=ORDER):
    return series(key, order).rowsBetween(-(n - 1), 0)


def change(col: str, k: int = 1, key=KEY, order=ORDER) -> Column:
    """k-step difference, null for the first k rows."""
    return _c(col) - F.lag(col, k).over(series(key, order))


def series_diff(df: DataFrame, col: str, k: int = 1, name: str | None = None) -> DataFrame:
    """k-step difference in a series; the first k rows get 0."""
    return df.withColumn(name or f"{col}_diff_{k}", F.coalesce(change(col, k), F.lit(0.0)))


def series_pct_change(df: DataFrame, col: str, k: int = 1, name: str | None = None) -> DataFrame:
    """k-step relative change; a zero base or a missing one gives 0."""
    ratio = F.try_divide(_c(col), F.lag(col, k).over(series())) - 1
    return df.withColumn(name or f"{col}_pct_{k}", F.coalesce(ratio, F.lit(0.0)))


def momentum_ratio(df: DataFrame, ks: list[int]) -> DataFrame:
    """``momentum_k`` and ``momentum_k / (|price| + eps)``."""
    for k in ks:
        df = series_diff(df, "price", k, f"momentum_{k}").withColumn(f"momentum_ratio_{k}", _c(f"momentum_{k}") / (F.abs("price") + EPS))
    return df


def cumulative_change(df: DataFrame, col: str) -> DataFrame:
    """Running sum of the changes in a series."""
    with_change = df.withColumn("__d", F.coalesce(change(col), F.lit(0.0)))
    return with_change.withColumn(f"cumulative_{col}_change", F.sum("__d").over(series().rowsBetween(Window.unboundedPreceding, 0))).drop("__d")


def rolling_std(df: DataFrame, col: str, w: int, min_periods: int | None = None, name: str | None = None) -> DataFrame:
    """Sample standard deviation of the last ``w`` rows; null with fewer than ``min_periods`` values (``w`` by default) or fewer than two."""
    least = w if min_periods is None else min_periods
    return df.withColumn(name or f"{col}_std_{w}", F.when(F.count(col).over(last_n(w)) >= least, F.stddev_samp(col).over(last_n(w))))


def ofi(df: DataFrame) -> DataFrame:
    """Plain order-flow imbalance: change of bid size minus change of ask size, the size before the first event being 0."""
    before = lambda c: F.coalesce(F.lag(c).over(series()), F.lit(0.0))
    return df.withColumn("ofi", (_c("bid_size") - before("bid_size")) - (_c("ask_size") - before("ask_size")))


def ofi_conditional(df: DataFrame) -> DataFrame:
    """Order-flow imbalance that counts bid sizes while the bid doesn't fall and ask sizes while the ask doesn't rise; 0 at the first event."""
    d = {c: F.coalesce(change(c), F.lit(0.0)) for c in ("bid", "ask", "bid_size", "ask_size")}
    return df.withColumn("ofi_conditional", F.when(d["bid"] >= 0, d["bid_size"]).otherwise(0.0) - F.when(d["ask"] <= 0, d["ask_size"]).otherwise(0.0))


def event_progress(df: DataFrame) -> DataFrame:
    """Event number from 0, its share of the last one, and its hundredth."""
    numbered = df.withColumn("event_number", (F.row_number().over(series()) - 1).cast("long"))
    last = F.max("event_number").over(Window.partitionBy(KEY))
    return numbered.withColumns({"progress": _c("event_number") / (last + EPS), "time_proportion": _c("event_number") / F.lit(100.0)})


def order_dynamics(df: DataFrame) -> DataFrame:
    """Events of an order in a series, age from 0 to 1, flux change, first-event flag."""
    own = series([KEY, "order_id"])
    place = F.row_number().over(own) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy(KEY, "order_id"))
    return df.withColumns({
        "order_event_count": n, "order_age_norm": place / (n - 1 + EPS), "order_flux_change": F.coalesce(_c("flux") - F.lag("flux").over(own), F.lit(0.0)),
        "is_new_order": (place == 0).cast("int"),
    })


def trend_consistency(df: DataFrame, w: int = 10) -> DataFrame:
    """Share of rising prices among the last ``w`` events."""
    up = df.withColumn("__up", (F.coalesce(change("price"), F.lit(0.0)) > 0).cast("double"))
    return up.withColumn("trend_consistency", F.avg("__up").over(last_n(w))).drop("__up")


def series_zscore(df: DataFrame, col: str) -> DataFrame:
    whole = Window.partitionBy(KEY)
    return df.withColumn(f"zscore_{col}", (_c(col) - F.avg(col).over(whole)) / (F.stddev_samp(col).over(whole) + EPS))


def global_zscore(df: DataFrame, col: str) -> DataFrame:
    """z-score over the whole table, by one row of statistics."""
    stats = df.agg(F.avg(col).alias("__m"), F.stddev_samp(col).alias("__s"))
    return df.join(F.broadcast(stats)).withColumn(f"{col}_z", (_c(col) - _c("__m")) / (_c("__s") + EPS)).drop("__m", "__s")


def flux_intensity(df: DataFrame) -> DataFrame:
    """``|change| / (|level| + eps)`` of the log flux."""
    logged = df.withColumn("log_flux", signed_log(_c("flux")))
    return logged.withColumn("flux_intensity", F.abs(F.coalesce(change("log_flux"), F.lit(0.0))) / (F.abs("log_flux") + EPS))


def rolling_share(df: DataFrame, col: str, w: int = 5, name: str | None = None) -> DataFrame:
    """A value over the sum of the last ``w``; 0 while there are fewer."""
    total = F.when(F.count(col).over(last_n(w)) >= w, F.sum(col).over(last_n(w)))
    return df.withColumn(name or f"{col}_strength", F.coalesce(_c(col) / (total + EPS), F.lit(0.0)))


def volume_change(df: DataFrame) -> DataFrame:
    """Change of both sizes, its signed log, and the spread over the rolling volatility of five prices."""
    out = df.withColumn("volume_change", F.coalesce(change("bid_size") + change("ask_size"), F.lit(0.0)))
    out = rolling_std(out.withColumn("log_volume_change", signed_log(_c("volume_change"))), "price", 5, 1, "__vol")
    return out.withColumn("volatility_adjusted_spread", F.coalesce((_c("ask") - _c("bid")) / (_c("__vol") + EPS), F.lit(0.0))).drop("__vol")


def group_mean(df: DataFrame, key: str, col: str) -> DataFrame:
    """The mean of a column by a key, on every row.

    Aggregated first and joined back, so that a key with few values doesn't gather
    its rows in one task; the optimizer broadcasts the means if they are few.
    """
    means = df.groupBy(F.col(key).alias("__key")).agg(F.avg(col).alias(f"{col}_mean_by_{key}"))
    return df.join(means, F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")


def global_diff(df: DataFrame, col: str, k: int = 1) -> DataFrame:
    """k-step difference over the whole table in the order of series and events.

    Rows lie in sorted range partitions with their global numbers. Inside a
    partition the difference is a lag; the first k rows of one look up the last k
    of those before it, of which there are k per partition.
    """
    placed = number_rows(df, [KEY, ORDER], "__at", keep_parts=True)
    lagged = placed.withColumn("__own", F.lag(col, k).over(Window.partitionBy("__part").orderBy("__place")))
    tails = placed.filter(F.col("__place") + k >= F.col("__part_rows")).select((F.col("__at") + k).alias("__want"), F.col(col).alias("__before"))
    few = placed.rdd.getNumPartitions() * k <= MOST_TAILS
    joined = lagged.join(F.broadcast(tails) if few else tails, F.col("__at") == F.col("__want"), "left")
    value = F.when(F.col("__place") >= k, F.col("__own")).otherwise(F.col("__before"))
    return joined.select(*df.columns, F.coalesce(F.col(col) - value, F.lit(0.0)).alias(f"{col}_global_diff_{k}"))


def vwap(df: DataFrame, price: str = "price", qty: str = "bid_size", key: str = KEY) -> DataFrame:
    """The volume-weighted mean price of a series on each of its rows."""
    whole = Window.partitionBy(key)
    return df.withColumn("vwap", F.try_divide(F.sum(F.col(price) * F.col(qty)).over(whole), F.sum(qty).over(whole)))


def log_returns(df: DataFrame, key: str, ts: str, close: str) -> DataFrame:
    """``ln(x / previous x)`` by instrument; the first row of each is left out."""
    before = F.lag(close).over(series(key, ts))
    return df.withColumn("log_return", F.when((before > 0) & (F.col(close) > 0), F.ln(F.try_divide(F.col(close), before)))).withColumn("__first", before.isNull()).filter("NOT __first").drop("__first")


def ffill_bfill(df: DataFrame, key: str | list[str], ts: str, cols: list[str]) -> DataFrame:
    """Fill nulls with the last value before, and at the start with the first one after, however long a series is."""
    keys = [key] if isinstance(key, str) else key
    filled = running(df, keys, [ts], lasts={f"__before_{c}": c for c in cols}, nexts={f"__after_{c}": c for c in cols})
    return filled.select(*[F.coalesce(f"__before_{c}", f"__after_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def _complete(df: DataFrame, key: str, ts: str, col: str, step: str) -> DataFrame:
    span = df.groupBy(key).agg(F.min(ts).alias("__a"), F.max(ts).alias("__b"))
    grid = span.select(key, F.explode(F.sequence("__a", "__b", F.expr(step))).alias(ts))
    joined = grid.join(df.select(key, ts, col), [key, ts], "left")
    return running(joined, [key], [ts], lasts={"__known": col}).select(key, ts, F.col("__known").alias(col))


def resample_hourly_ffill(df: DataFrame, key: str, ts: str, col: str) -> DataFrame:
    """Every hour between a key's first and last one, with the last value known. Expects one row per key and hour."""
    return _complete(df, key, ts, col, "interval 1 hour")


def complete_years(df: DataFrame, key: str, year: str, col: str) -> DataFrame:
    """Every year between a key's first and last one, with the previous year's value where it is missing."""
    return _complete(df, key, year, col, "1")


def event_edges(df: DataFrame) -> DataFrame:
    """Edges from the previous event at the same venue and of the same order, with the later event's attributes."""
    parts = []
    for kind, key in (("venue", [KEY, "venue"]), ("order", [KEY, "order_id"])):
        parts.append(df.select(KEY, F.lag(ORDER).over(series(key)).alias("source"), F.col(ORDER).alias("target"), F.lit(kind).alias("kind"), "action", "side", "trade").filter("source IS NOT NULL"))
    return parts[0].unionByName(parts[1]).distinct()
