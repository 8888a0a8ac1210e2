"""Row features: projections that need one row only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.clean import EPS, signed_log

_c = F.col


def spread_features(df: DataFrame, rel_to: str = "price") -> DataFrame:
    """Spread, mid price, price minus mid, and the spread relative to ``price`` or ``mid_price``."""
    out = df.withColumns({"bid_ask_spread": _c("ask") - _c("bid"), "mid_price": (_c("bid") + _c("ask")) / 2})
    return out.withColumns({"relative_spread": _c("bid_ask_spread") / (_c(rel_to) + EPS), "mid_vs_price": _c("price") - _c("mid_price")})


def imbalance_features(df: DataFrame) -> DataFrame:
    total = _c("bid_size") + _c("ask_size") + EPS
    return df.withColumns({
        "imbalance": _c("bid_size") - _c("ask_size"), "normalized_imbalance": (_c("bid_size") - _c("ask_size")) / total,
        "rel_bid_size": _c("bid_size") / total, "bid_ask_ratio": _c("bid_size") / (_c("ask_size") + EPS),
    })


def liquidity_features(df: DataFrame) -> DataFrame:
    depth, spread = _c("bid_size") + _c("ask_size"), _c("ask") - _c("bid")
    return df.withColumns({
        "liquidity_depth": depth, "log_liquidity_depth": F.log1p(depth), "liquidity_ratio": depth / (spread + EPS),
        "turnover": _c("price") * depth, "flux_turnover": _c("price") * _c("flux"),
    })


def pressure_features(df: DataFrame) -> DataFrame:
    total = _c("bid_size") + _c("ask_size") + EPS
    return df.withColumns({
        "buy_pressure": _c("bid_size") / total, "sell_pressure": _c("ask_size") / total, "pressure_diff": _c("bid_size") / total - _c("ask_size") / total,
        "market_pressure": _c("bid_size") / (total + _c("ask") - _c("bid")), "aggressiveness": _c("flux") / total,
    })


def price_position(df: DataFrame) -> DataFrame:
    return df.withColumns({"price_bid_ratio": _c("price") / (_c("bid") + EPS), "price_ask_ratio": _c("price") / (_c("ask") + EPS)})


def trade_features(df: DataFrame) -> DataFrame:
    impact = _c("trade").cast("int") * _c("flux")
    return df.withColumns({"trade_impact": impact, "trade_flux_ratio": impact / (F.abs("flux") + EPS), "trade_volume": _c("trade").cast("int") * (_c("bid_size") + _c("ask_size"))})


def direction_features(df: DataFrame, change: str = "price_change") -> DataFrame:
    """Flags, sign, absolute move and intensity of a change column."""
    x = _c(change)
    return df.withColumns({
        "price_up": (x > 0).cast("int"), "price_down": (x < 0).cast("int"), "delta_sign": F.signum(x), "abs_price_change": F.abs(x),
        "direction_intensity": F.abs(x) / (F.abs("price") + EPS),
    })


def time_features(df: DataFrame, ts: str) -> DataFrame:
    """Hour, weekday (Monday 0), month and weekend flag."""
    return df.withColumns({"hour": F.hour(ts), "dayofweek": F.weekday(ts), "month": F.month(ts), "is_weekend": (F.weekday(ts) >= 5).cast("int")})


def _cycle(x: Column, n: int) -> tuple[Column, Column]:
    angle = F.lit(6.283185307179586) * x / n
    return F.sin(angle), F.cos(angle)


def cyclic_features(df: DataFrame, ts: str) -> DataFrame:
    out = {}
    for name, x, n in (("hour", F.hour(ts), 24), ("dow", F.weekday(ts), 7), ("month", F.month(ts), 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = _cycle(x, n)
    return df.withColumns(out)


def season_flags(df: DataFrame, ts: str) -> DataFrame:
    """Winter and summer months, the high-demand season, and off-peak hours (H1 to H8 and H21 to H24)."""
    month, hour = F.month(ts), F.hour(ts) + 1
    return df.withColumns({
        "winter": month.isin(11, 12, 1, 2).cast("int"), "summer": month.isin(6, 7, 8).cast("int"), "high_demand": month.isin(1, 2, 3, 11, 12).cast("int"),
        "off_peak": ((hour <= 8) | (hour >= 21)).cast("int"),
    })


def row_mean_std(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    """Mean and sample standard deviation across columns, nulls skipped; null for too few values."""
    n = sum((_c(c).isNotNull().cast("double") for c in cols), F.lit(0.0))
    mean = F.try_divide(sum((F.coalesce(_c(c), F.lit(0.0)) for c in cols), F.lit(0.0)), n)
    around = sum((F.coalesce((_c(c) - mean) * (_c(c) - mean), F.lit(0.0)) for c in cols), F.lit(0.0))
    return df.withColumns({f"{prefix}_mean": mean, f"{prefix}_std": F.when(n > 1, F.sqrt(F.try_divide(around, n - 1)))})


def spark_spreads(df: DataFrame, cols: list[str], base: str) -> DataFrame:
    """Each power price minus the gas price."""
    return df.withColumns({f"spark_spread_{c}": _c(c) - _c(base) for c in cols})


def log_levels(df: DataFrame, cols: list[str]) -> DataFrame:
    """Signed logarithms ``log_<column>``."""
    return df.withColumns({f"log_{c}": signed_log(_c(c)) for c in cols})
