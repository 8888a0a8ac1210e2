"""Exact order statistics of a whole column, without a task that holds its values.

Spark's percentile sketch brackets the values of the wanted ranks, exact counts tell
where in a bracket a rank lies, and the bracket is refined in the same way until few
enough values are left to sort. A round leaves about one value in ``ACCURACY / 4``,
so three rounds do for a trillion.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranks that the sketch tells apart, and values that are sorted at the end.
ACCURACY, FEW = 10_000, 10_000


@dataclass
class _Search:
    """A rank among the values strictly between ``low`` and ``high``, of which there are ``n``."""

    rank: int
    n: int
    low: float | None = None
    high: float | None = None
    found: float | None = None

    def inside(self):
        """Whether a value is still in the bracket, as a column."""
        v, ok = F.col("v"), F.lit(True)
        ok = ok if self.low is None else ok & (v > F.lit(self.low))
        return ok if self.high is None else ok & (v < F.lit(self.high))


def order_statistics(df: DataFrame, column: str, ranks: list[int], *, accuracy: int = ACCURACY, few: int = FEW) -> tuple[list[float | None], int]:
    """The values at ``ranks`` (from 0) of a numeric column in order, and how many values there are.

    Nulls and NaN aren't values; a rank that isn't there is None. ``df`` is read twice in each round:
    give a scan or a table that has been written.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    n = values.count()
    searches = {r: _Search(r, n) for r in ranks if 0 <= r < n}
    while open_ := [s for s in searches.values() if s.found is None]:
        small = [s for s in open_ if s.n <= few]
        for s in small:
            held = values.filter(s.inside()).groupBy("v").count().collect()  # few values
            left = s.rank
            for r in sorted(held, key=lambda r: r["v"]):
                if left < r["count"]:
                    s.found = r["v"]
                    break
                left -= r["count"]
        if not (large := [s for s in open_ if s.n > few]):
            continue
        sketch = [F.percentile_approx(F.when(s.inside(), F.col("v")), [max(0.0, s.rank / s.n - 2 / accuracy), min(1.0, (s.rank + 1) / s.n + 2 / accuracy)], accuracy).alias(f"s{i}") for i, s in enumerate(large)]
        edges = values.agg(*sketch).first()
        tally = lambda i, name, is_so: F.sum((large[i].inside() & is_so).cast("long")).alias(f"{name}{i}")
        v = F.col("v")
        counts = values.agg(*[c for i in range(len(large)) for low, high in [edges[f"s{i}"]] for c in (tally(i, "below", v < low), tally(i, "low", v == low), tally(i, "between", (v > low) & (v < high)), tally(i, "high", (v == high) & (v > low)))]).first()
        for i, s in enumerate(large):
            low, high = edges[f"s{i}"]
            below, at_low, between, at_high = (counts[f"{name}{i}"] for name in ("below", "low", "between", "high"))
            if s.rank < below:  # the sketch was off
                s.n, s.high = below, low
            elif s.rank < below + at_low:
                s.found = low
            elif s.rank < below + at_low + between:
                s.rank, s.n, s.low, s.high = s.rank - below - at_low, between, low, high
            elif s.rank < below + at_low + between + at_high:
                s.found = high
            else:
                taken = below + at_low + between + at_high
                s.rank, s.n, s.low = s.rank - taken, s.n - taken, high
    return [searches[r].found if r in searches else None for r in ranks], n


def exact_quantile(df: DataFrame, column: str, share: float, *, interpolated: bool = False, **options) -> float | None:
    """The smallest value with at least ``share`` of all values at or below it, or the value interpolated at that share."""
    n = df.filter(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).count()
    if not n:
        return None
    if not interpolated:
        return order_statistics(df, column, [max(0, math.ceil(share * n) - 1)], **options)[0][0]
    place = (n - 1) * share
    low, high = math.floor(place), math.ceil(place)
    (a, b), _ = order_statistics(df, column, [low, high], **options)
    return a if low == high else (high - place) * a + (place - low) * b
