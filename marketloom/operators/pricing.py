"""Option prices and risk over contract tables and path tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.operators.order_statistics import exact_quantile
from marketloom.sources.durable import durable

#: 1 / sqrt(2 pi)
INV_SQRT_2PI = 0.3989422804014327
#: Coefficients of West's double-precision rational approximation of the normal distribution function (fixed values).
CDF_TOP = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_BOTTOM = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def norm_pdf(x: Column) -> Column:
    """Density of the standard normal distribution."""
    return F.lit(INV_SQRT_2PI) * F.exp(-x * x / 2)


def norm_cdf(x: Column) -> Column:
    """Distribution function of the standard normal, to about 1e-15, in built-in arithmetic."""
    a = F.abs(x)

    def horner(coefficients) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * a + F.lit(c)
        return out

    bell = F.exp(-a * a / 2)
    near = bell * horner(CDF_TOP) / horner(CDF_BOTTOM)
    tail = F.lit(1.0) / (a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + F.lit(0.65))))))
    below = F.when(a > 37, F.lit(0.0)).when(a < F.lit(7.07106781186547), near).otherwise(bell * tail * INV_SQRT_2PI)
    return F.when(x > 0, F.lit(1.0) - below).otherwise(below)


def _with_d(df: DataFrame) -> DataFrame:
    """Intermediate columns ``__d1, __d2, __disc``, so that each is computed once."""
    s, k, t, r, sigma = (F.col(c) for c in ("s", "k", "t", "r", "sigma"))
    root = sigma * F.sqrt(t)
    d1 = F.try_divide(F.ln(s / k) + (r + sigma * sigma / 2) * t, root)
    out = df.withColumns({"__d1": d1, "__root": root, "__disc": F.exp(-r * t)}).withColumn("__d2", F.col("__d1") - F.col("__root"))
    return out.withColumns({"__n1": norm_cdf(F.col("__d1")), "__n2": norm_cdf(F.col("__d2")), "__p1": norm_pdf(F.col("__d1"))})


def _without_d(df: DataFrame) -> DataFrame:
    return df.drop("__d1", "__d2", "__disc", "__root", "__n1", "__n2", "__p1")


def black_scholes(df: DataFrame) -> DataFrame:
    """A column ``price`` for contracts ``s, k, t, r, sigma, option_type`` (call or put)."""
    d = _with_d(df)
    s, k, disc = F.col("s"), F.col("k"), F.col("__disc")
    call = s * F.col("__n1") - k * disc * F.col("__n2")
    put = k * disc * (F.lit(1.0) - F.col("__n2")) - s * (F.lit(1.0) - F.col("__n1"))
    return _without_d(d.withColumn("price", F.when(F.col("option_type") == "call", call).otherwise(put)))


def greeks(df: DataFrame) -> DataFrame:
    """Delta, gamma, vega, theta, rho and vomma."""
    d = _with_d(df)
    s, k, t, r, sigma, disc = (F.col(c) for c in ("s", "k", "t", "r", "sigma", "__disc"))
    call, n1, n2, p1 = F.col("option_type") == "call", F.col("__n1"), F.col("__n2"), F.col("__p1")
    decay = -s * p1 * sigma / (2 * F.sqrt(t))
    vega = s * p1 * F.sqrt(t)
    return _without_d(d.withColumns({
        "delta": F.when(call, n1).otherwise(n1 - 1), "gamma": p1 / (s * F.col("__root")), "vega": vega,
        "theta": F.when(call, decay - r * k * disc * n2).otherwise(decay + r * k * disc * (F.lit(1.0) - n2)),
        "rho": F.when(call, k * t * disc * n2).otherwise(-k * t * disc * (F.lit(1.0) - n2)),
        "vomma": vega * F.col("__d1") * F.col("__d2") / sigma,
    }))


def scenario_grid(df: DataFrame, param: str, lo: float, hi: float, n: int) -> DataFrame:
    """Each contract at ``n`` evenly spaced values of one parameter, the others as they are; ``point`` counts from 0."""
    grid = df.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.withColumn(param, F.lit(float(lo)) + F.col("point") * F.lit((hi - lo) / (n - 1)))


#: Steps times simulations that a task holds at once.
BLOCK_CELLS = 1 << 21


def gbm_paths(df: DataFrame, n_sims: int, n_steps: int, seed: int = 42, id_col: str = "contract_id") -> DataFrame:
    """``id, sim_id, last, highest`` of geometric Brownian paths from ``s, t, r, sigma``.

    Work is dealt in blocks of simulations; a block's normal shocks come from a
    generator seeded by seed, contract and block, so that retries repeat them.
    Steps live in one block of memory only; paths aren't written out.
    """
    block = max(1, min(4096, BLOCK_CELLS // n_steps))
    blocks = -(-n_sims // block)
    work = df.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("double") for c in ("s", "t", "r", "sigma")]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def frame(parts: list) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("id", "sim_id", "last", "highest"), (np.concatenate(c) for c in zip(*parts, strict=True)), strict=True)))

    def simulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.itertuples():
                n = min(block, n_sims - row.block * block)
                rng = np.random.default_rng([seed, int(row.id) % 2**64, row.block])
                dt = row.t / n_steps
                x = rng.standard_normal((n_steps, n))
                x *= row.sigma * np.sqrt(dt)
                x += (row.r - row.sigma**2 / 2) * dt
                np.cumsum(x, axis=0, out=x)
                parts.append((np.full(n, row.id), row.block * block + np.arange(n), row.s * np.exp(x[-1]), row.s * np.exp(np.maximum(x.max(axis=0), 0.0))))
                if len(parts) * block >= 1 << 18:
                    yield frame(parts)
                    parts = []
            if parts:
                yield frame(parts)

    return work.repartition("id", "block").mapInPandas(simulate, "id long, sim_id long, last double, highest double")


def apply_shocks(shocks: DataFrame, s0: float, mu: float, sigma: float, dt: float, key: str = "sim_id") -> DataFrame:
    """A column ``price``: the path that given standard shocks ``z`` make step by step."""
    w = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    move = F.lit((mu - sigma * sigma / 2) * dt) + F.lit(sigma * dt**0.5) * F.col("z")
    return shocks.withColumn("price", F.lit(float(s0)) * F.exp(F.sum(move).over(w)))


def payoff(df: DataFrame, price: str, strike: float, option_type: str = "call") -> DataFrame:
    """European payoff of a price column."""
    gain = F.col(price) - F.lit(float(strike)) if option_type == "call" else F.lit(float(strike)) - F.col(price)
    return df.withColumn("payoff", F.greatest(gain, F.lit(0.0)))


def barrier_payoff(paths: DataFrame, strike: float, barrier: float, key: str = "sim_id") -> DataFrame:
    """Up-and-out call per path: nothing once the price is above the barrier (touching it is not above)."""
    ends = paths.groupBy(key).agg(F.max("price").alias("highest"), F.max_by("price", "step").alias("last"))
    return ends.withColumn("payoff", F.when(F.col("highest") > F.lit(float(barrier)), F.lit(0.0)).otherwise(F.greatest(F.col("last") - F.lit(float(strike)), F.lit(0.0))))


def portfolio_var(pnl: DataFrame, weights: dict[str, float], level: float, key: str = "sim_id", exact: bool = True) -> DataFrame:
    """One row ``mean_pnl, value_at_risk``: weighted P&L by scenario and its (1 - level) percentile.

    The exact percentile is found by refining counts, no task holds the scenarios;
    ``exact=False`` takes Spark's percentile sketch (accuracy 1/10,000 of the ranks) in one pass.
    """
    total = sum((F.col(c) * F.lit(float(w)) for c, w in weights.items()), F.lit(0.0))
    by_sim = pnl.groupBy(key).agg(F.sum(total).alias("pnl"))
    if not exact:
        return by_sim.agg(F.avg("pnl").alias("mean_pnl"), F.percentile_approx("pnl", 1 - level, 10_000).alias("value_at_risk"))
    by_sim = durable(by_sim)
    at_risk = exact_quantile(by_sim, "pnl", 1 - level, interpolated=True)
    return by_sim.agg(F.avg("pnl").alias("mean_pnl")).withColumn("value_at_risk", F.lit(at_risk).cast("double"))
