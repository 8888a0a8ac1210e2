"""Whole datasets: event features with switches, the train/test loader, the energy table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.functions import clean, features
from marketloom.operators import aggregate, join, scale, window
from marketloom.sources.durable import durable

#: Feature groups and the columns that each gives.
GROUPS = {
    "structure": ("bid_ask_spread", "relative_spread", "spread_change"),
    "ofi": ("ofi_conditional",),
    "price": ("price_change", "rolling_volatility"),
    "momentum": ("momentum_5", "momentum_20"),
    "flux": ("flux_change",),
    "order": ("order_event_count", "order_age_norm", "order_flux_change", "is_new_order"),
    "imbalance": ("imbalance", "rel_bid_size"),
    "logs": ("log_bid_size", "log_ask_size", "log_flux"),
}
PRESETS = {
    "full": tuple(GROUPS),
    "reduced": ("structure", "ofi", "price", "flux", "imbalance", "logs"),
    "super_reduced": ("structure", "price", "logs"),
}
#: Columns that get a log copy where they are skewed.
SCREENED = ("flux_change", "rolling_volatility", "imbalance")
BASE = ("obs_id", "event_idx", "order_id", "venue", "action", "side", "trade")


def build_features(df: DataFrame, preset: str = "full", *, log_skewed: bool | list[str] = True, skew_limit: float = 3.0, corr_threshold: float | None = None, keep: tuple[str, ...] = (), **switches: bool) -> tuple[DataFrame, list[str]]:
    """Features of the preset's groups (``switches`` turn single groups on or off) and the list of output columns.

    All windows share the series key, so that one exchange and one sort serve
    them. ``log_skewed`` adds log copies of the columns whose skewness exceeds
    ``skew_limit``, or of those in a list, as found on other rows; it and
    ``corr_threshold`` read back one row of statistics, for which the rows are written
    to the checkpoint folder once.
    Infinities become 0.
    """
    on = [g for g in GROUPS if switches.get(g, g in PRESETS[preset])]
    df = clean.fill_zero(df, [c for c in ("price", "bid", "ask", "bid_size", "ask_size", "flux") if c in df.columns])
    if "structure" in on:
        df = window.series_diff(features.spread_features(df, "mid_price"), "bid_ask_spread", 1, "spread_change")
    if "ofi" in on:
        df = window.ofi_conditional(df)
    if "price" in on:
        df = window.series_diff(df, "price", 1, "price_change")
        df = window.rolling_std(df, "price_change", 5, 2, "rolling_volatility").fillna({"rolling_volatility": 0.0})
    if "momentum" in on:
        df = window.series_diff(window.series_diff(df, "price", 5, "momentum_5"), "price", 20, "momentum_20")
    if "flux" in on:
        df = window.series_diff(df, "flux", 1, "flux_change")
    if "order" in on:
        df = window.order_dynamics(df)
    if "imbalance" in on:
        df = features.imbalance_features(df)
    if "logs" in on:
        df = features.log_levels(df, ["bid_size", "ask_size", "flux"])
    names = [c for g in on for c in GROUPS[g]]
    held = [c for c in (*BASE, *keep) if c in df.columns]
    if log_skewed is True or corr_threshold:
        # the statistics and the caller read the rows: windows are computed once
        df = durable(df.select(*dict.fromkeys([*held, *names])))
    if log_skewed:
        can = [c for c in SCREENED if c in names]
        screened = aggregate.skew_screen(df, can, skew_limit) if log_skewed is True else [c for c in can if c in log_skewed]
        df = aggregate.log_skewed(df, screened)
        names += [f"log_{c}" for c in screened]
    if corr_threshold:
        dropped = aggregate.correlation_prune(df, names, corr_threshold)
        names = [c for c in names if c not in dropped]
    out = list(dict.fromkeys([*held, *names]))
    return clean.inf_to(df.select(*out), [c for c, kind in df.select(*names).dtypes if kind in ("double", "float")], 0.0), out


def prepare_dataset(train: DataFrame, labels: DataFrame, test: DataFrame, *, preset: str = "full", limits: tuple[float, float] = (10.0, 10.0), remove_outliers: bool = True) -> tuple[DataFrame, DataFrame]:
    """Encode, join labels, drop outlier series, build features, scale by train statistics, drop outlier series again.

    An action: the train features are computed once into the checkpoint folder.
    """
    categories = ["venue", "action", "side"]
    codes = clean.fit_ordinal(train, categories)
    train, test = clean.apply_ordinal(train, codes, categories), clean.apply_ordinal(test, codes, categories)
    train = join.with_labels(train, labels)
    train = join.remove_outlier_series(train, "eqt_code_cat", ["price", "bid", "ask"], limits[0], enabled=remove_outliers)
    own, names = build_features(train, preset, keep=("eqt_code_cat",))  # written; read for statistics, scaling and the second outlier pass
    other, _ = build_features(test, preset, log_skewed=[c for c in SCREENED if f"log_{c}" in names])
    scaled = [c for c in names if c not in (*BASE, "eqt_code_cat", "order_event_count")]
    train_z, test_z = scale.zscore_train(own, own, scaled), scale.zscore_train(own, other, scaled)
    logs = [c for c in ("log_bid_size", "log_ask_size", "log_flux") if c in scaled]
    return join.remove_outlier_series(train_z, "eqt_code_cat", logs, limits[1], enabled=remove_outliers and bool(logs)), test_z


def build_energy_dataset(tables: dict[str, DataFrame], *, target: str, zones: dict[str, list[str]], neighbours: list[str], base: str, start: str, end: str) -> DataFrame:
    """One row per hour: means per (time, zone) of each table, wide with prefixes, gaps filled, calendar and market features.

    ``tables`` have ``ts, zone, value``. All are stacked with prefixed zones and
    pivoted once. Filling goes series by series in long form, over a grid of all
    hours; then rows without target and outside the slice go.
    """
    stacked = None
    for name, df in tables.items():
        part = aggregate.mean_by_time(df, "ts", "zone", "value").select("ts", F.concat(F.lit(f"{name}_"), "zone").alias("zone"), "value")
        stacked = part if stacked is None else stacked.unionByName(part)
    known = [f"{name}_{z}" for name, zs in zones.items() for z in zs]
    hours = stacked.select("ts").distinct()
    grid = hours.withColumn("zone", F.explode(F.array(*[F.lit(z) for z in known])))
    long = grid.join(stacked, ["ts", "zone"], "left")
    filled = window.ffill_bfill(long.withColumn("known", F.col("value")), "zone", "ts", ["value"])
    filled = filled.withColumn("value", F.when(F.col("zone") == target, F.col("known")).otherwise(F.col("value")))
    wide = aggregate.pivot_wide(filled, "ts", "zone", "value", "", known)
    wide = features.season_flags(features.cyclic_features(features.time_features(wide, "ts"), "ts"), "ts")
    wide = features.spark_spreads(features.row_mean_std(wide, neighbours, "group"), neighbours, base)
    return scale.date_slice(wide.filter(F.col(target).isNotNull()), "ts", start, end)
