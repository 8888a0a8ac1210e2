"""Scaling with train statistics, sequences, splits."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.sources.tables import rank_within

EPS = 1e-6


def _stats(df: DataFrame, cols: list[str], **functions) -> dict[str, dict[str, float]]:
    """Statistics of columns, read back as one row."""
    row = df.agg(*[f(c).alias(f"{n}__{c}") for c in cols for n, f in functions.items()]).first()
    return {n: {c: row[f"{n}__{c}"] for c in cols} for n in functions}


def zscore_train(train: DataFrame, df: DataFrame, cols: list[str], clip: float = 10.0) -> DataFrame:
    """z-scores of ``df`` by the mean and sample deviation of ``train``; no spread counts as 1e-6, scores are clipped."""
    s = _stats(train, cols, m=F.avg, s=F.stddev_samp)
    out = {}
    for c in cols:
        z = (F.col(c) - F.lit(s["m"][c])) / F.lit(s["s"][c] or EPS)
        out[c] = F.greatest(F.lit(-clip), F.least(F.lit(clip), z))
    return df.withColumns(out)


def minmax_zscore(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Min-max, then z-score (sample deviation), by train statistics. The second pass's statistics follow from the first's."""
    s = _stats(train, cols, lo=F.min, hi=F.max, m=F.avg, s=F.stddev_samp)

    def apply(df: DataFrame) -> DataFrame:
        out = {}
        for c in cols:
            width = (s["hi"][c] - s["lo"][c]) if s["hi"][c] is not None and s["hi"][c] > s["lo"][c] else 1.0
            lo = s["lo"][c]
            scaled = (F.col(c) - F.lit(lo)) / F.lit(width)
            mean, dev = (s["m"][c] - lo) / width, (s["s"][c] or 0.0) / width
            out[c] = (scaled - F.lit(mean)) / F.lit(dev or 1.0)
        return df.withColumns(out)

    return apply(train), apply(test)


def group_minmax(train: DataFrame, test: DataFrame, groups: list[list[str]]) -> tuple[DataFrame, DataFrame]:
    """Min-max with one minimum and maximum for all columns of a group."""
    cols = [c for g in groups for c in g]
    s = _stats(train, cols, lo=F.min, hi=F.max)

    def apply(df: DataFrame) -> DataFrame:
        out = {}
        for g in groups:
            lo, hi = min(s["lo"][c] for c in g), max(s["hi"][c] for c in g)
            out |= {c: (F.col(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0) for c in g}
        return df.withColumns(out)

    return apply(train), apply(test)


def standard_scale(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """z-score with the population deviation; no spread counts as 1."""
    s = _stats(train, cols, m=F.avg, s=F.stddev_pop)

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(s["m"][c])) / F.lit(s["s"][c] or 1.0) for c in cols})

    return apply(train), apply(test)


def pca_variance(df: DataFrame, cols: list[str], share: float = 0.97, key: str = "id") -> DataFrame:
    """``k, explained, cumulative, kept`` of the principal components; those needed for ``share`` are kept."""
    from pyspark.ml.feature import PCA, VectorAssembler

    data = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    explained = PCA(k=len(cols), inputCol="features", outputCol="pca").fit(data).explainedVariance.toArray().tolist()
    rows, total = [], 0.0
    for k, x in enumerate(explained, 1):
        rows.append((k, x, total + x, total < share))
        total += x
    return df.sparkSession.createDataFrame(rows, "k int, explained double, cumulative double, kept boolean")


def pca_project(df: DataFrame, cols: list[str], share: float = 0.97) -> DataFrame:
    """A column ``pca`` with the components that hold ``share`` of the variance."""
    from pyspark.ml.feature import PCA, VectorAssembler

    data = VectorAssembler(inputCols=cols, outputCol="features").transform(df)
    explained = PCA(k=len(cols), inputCol="features", outputCol="pca").fit(data).explainedVariance.toArray()
    k = int((explained.cumsum() < share).sum()) + 1
    return PCA(k=min(k, len(cols)), inputCol="features", outputCol="pca").fit(data).transform(data).drop("features")


def to_sequences(df: DataFrame, cols: list[str], length: int = 100, key: str = "obs_id", order: str = "event_idx") -> DataFrame:
    """The first ``length`` events of a series as one nested array, padded with zero rows."""
    first = df.filter(F.col(order) < length).groupBy(key)
    row = F.struct(F.col(order), F.array(*[F.col(c).cast("double") for c in cols]).alias("v"))
    rows = F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"])
    zeros = F.array_repeat(F.array(*[F.lit(0.0) for _ in cols]), F.greatest(F.lit(0), F.lit(length) - F.size("sequence")).cast("int"))
    return first.agg(rows.alias("sequence")).withColumn("sequence", F.concat("sequence", zeros))


def time_split(df: DataFrame, ts: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Up to a time (included), and after it."""
    edge = F.lit(at).cast(df.schema[ts].dataType)
    return df.filter(F.col(ts) <= edge), df.filter(F.col(ts) > edge)


def date_slice(df: DataFrame, ts: str, a: str, b: str) -> DataFrame:
    """From a to b, both included."""
    kind = df.schema[ts].dataType
    return df.filter(F.col(ts).between(F.lit(a).cast(kind), F.lit(b).cast(kind)))


def hash_share(key: Column, seed: int) -> Column:
    """A number in [0, 1) from a key, the same everywhere."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def hash_split(df: DataFrame, key: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """A column ``split``: all rows of a key on one side."""
    u, upto, out = hash_share(F.col(key), seed), 0.0, None
    for name, share in shares.items():
        upto += share
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return df.withColumn("split", out.otherwise(list(shares)[-1]))


def _hash_rank(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """``__rank`` and ``__group_rows`` of each row in its class, in hash order, without gathering a class."""
    hashed = df.withColumn("__hash", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    return rank_within(hashed, [label], ["__hash", key], "__rank").drop("__hash")


def stratified_split(df: DataFrame, key: str, label: str, share: float, seed: int = 42) -> DataFrame:
    """A flag ``in_test`` for the first share of each class in hash order. One row per key is expected."""
    flag = F.col("__rank") < F.floor(F.col("__group_rows") * F.lit(share))
    return _hash_rank(df, key, label, seed).select(*df.columns, flag.alias("in_test"))


def kfold(df: DataFrame, key: str, label: str, k: int, seed: int = 42) -> DataFrame:
    """Fold numbers whose sizes differ by one at most in each class."""
    return _hash_rank(df, key, label, seed).select(*df.columns, (F.col("__rank") % k).cast("int").alias("fold"))


def poisson_steps(mean: float) -> tuple[int, list[float]]:
    """The first count whose distribution value matters at 32 bits, and the values from there to where the rest doesn't."""
    from math import exp, lgamma, log

    if mean <= 0:
        return 0, [1.0]
    first, out, total, k = 0, [], 0.0, 0
    while not out or out[-1] < 1 - 2.0**-33:
        total += exp(k * log(mean) - mean - lgamma(k + 1))
        if not out and total < 2.0**-33:
            first = k + 1
        else:
            out.append(total)
        k += 1
        if k > mean + 60 * mean**0.5 + 100:  # the sum stays a little short of 1
            break
    return first, out


def bootstrap(df: DataFrame, t: int, share: float = 1.0, seed: int = 42, key: str = "id") -> DataFrame:
    """``estimator`` 0..t-1 and ``weight``: how often each draw takes a row.

    Weights are Poisson with mean ``share``, from a 32-bit hash of key and
    estimator; the table of the distribution ends where that hash can't tell.
    """
    drawn = df.withColumn("estimator", F.explode(F.sequence(F.lit(0), F.lit(t - 1))))
    u = hash_share(F.concat_ws("/", F.col(key), F.col("estimator")), seed)
    first, steps = poisson_steps(share)
    reached = F.filter(F.array(*[F.lit(p) for p in steps]), lambda p: p <= F.col("__u"))
    weighted = drawn.withColumn("__u", u).withColumn("weight", F.lit(first) + F.size(reached))
    return weighted.filter("weight > 0").drop("__u")
