"""Cleaning, casting and encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Added to denominators, as in the formulas this library follows.
EPS = 1e-6


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def fill_zero(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Nulls of numeric columns become 0."""
    return df.na.fill(0, subset=cols or numeric_columns(df))


def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """``column, nulls`` for each column, in one pass."""
    cols = cols or df.columns
    row = df.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias(c) for c in cols])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in cols])).alias("x")).select("x.*")


def inf_to(df: DataFrame, cols: list[str], value: float | None = None) -> DataFrame:
    """Infinities become null, or a value."""
    return df.withColumns({c: F.when(F.abs(c) == float("inf"), F.lit(value)).otherwise(F.col(c)) for c in cols})


def zero_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in cols})


def fit_ordinal(df: DataFrame, cols: list[str]) -> DataFrame:
    """``column, category, code``: sorted categories of each column from 0; nulls are no category.

    Categories are numbered by counting, for each, the smaller ones: one window
    per column over its distinct values.
    """
    from pyspark.sql import Window

    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in cols])).alias("x")).select("x.*")
    return long.filter("category IS NOT NULL").distinct().withColumn("code", F.dense_rank().over(Window.partitionBy("column").orderBy("category")) - 1)


def apply_ordinal(df: DataFrame, model: DataFrame, cols: list[str], unknown: str | int = -1) -> DataFrame:
    """Replace categories by codes. Unknown ones get ``unknown``, or raise if it is ``'error'`` (an action).

    The joins leave it to the optimizer whether a column's categories are few
    enough to broadcast.
    """
    for c in cols:
        codes = model.filter(F.col("column") == c).select(F.col("category").alias("__category"), F.col("code").alias("__code"))
        keyed = df.join(codes, F.col(c).cast("string") == F.col("__category"), "left")
        if unknown == "error" and not keyed.filter("__category IS NULL").isEmpty():
            raise ValueError(f"column {c} has categories that were not fitted")
        df = keyed.withColumn(c, F.coalesce("__code", F.lit(-1 if unknown == "error" else unknown))).drop("__category", "__code")
    return df


def one_hot(df: DataFrame, col: str, n: int) -> DataFrame:
    """Columns ``col_0 .. col_{n-1}`` of 0 and 1."""
    return df.withColumns({f"{col}_{i}": (F.col(col) == i).cast("int") for i in range(n)})


def cast_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(kind) for c, kind in mapping.items()})


def distinct_labels(df: DataFrame, key: str = "obs_id", label: str = "eqt_code_cat", order: str = "event_idx") -> DataFrame:
    """One label per series, that of its first event."""
    return df.groupBy(key).agg(F.min_by(label, order).alias(label))


def parse_datetime(col: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy")) -> Column:
    """ISO first, then day first; what fits no format is null."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats])


def semester_to_date(col: Column) -> Column:
    """``YYYY-S1`` is 1 January, ``YYYY-S2`` 1 July."""
    parts = F.split(col, "-S")
    return F.make_date(parts[0].cast("int"), F.when(parts[1] == "1", 1).otherwise(7), F.lit(1))


def duplicate_times(df: DataFrame, key: str, ts: str) -> DataFrame:
    """Times that a key has more than once, such as the repeated hour when clocks go back."""
    return df.groupBy(key, ts).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def round_to_tick(col: Column, tick: float) -> Column:
    """The nearest tick; halves go to the even one."""
    return F.rint(col / F.lit(tick)) * F.lit(tick)


def prefix_columns(df: DataFrame, prefix: str, skip: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Leave out the first ``skip`` columns and prefix the others, except those in ``keep``."""
    return df.select(*[F.col(c).alias(c if c in keep else prefix + c) for c in df.columns[skip:]])


def signed_log(col: Column) -> Column:
    """``sign(x) ln(1 + |x|)``; what isn't finite counts as 0."""
    finite = F.when(col.isNull() | F.isnan(col) | (F.abs(col) == float("inf")), F.lit(0.0)).otherwise(col)
    return F.signum(finite) * F.log1p(F.abs(finite))


def log_shift(col: Column, absolute: bool) -> Column:
    """``ln|x + 1|``, minus infinity at -1; or ``ln(x + 1)``, null from -1 down."""
    if not absolute:
        return F.when(col + 1 > 0, F.ln(col + 1))
    shifted = F.abs(col + 1)
    return F.when(shifted == 0, F.lit(float("-inf"))).otherwise(F.ln(shifted))  # Spark's ln(0) is null


def stack_with_flag(train: DataFrame, test: DataFrame, flag: str = "_is_train") -> DataFrame:
    return train.withColumn(flag, F.lit(1)).unionByName(test.withColumn(flag, F.lit(0)), allowMissingColumns=True)


def split_by_flag(df: DataFrame, flag: str = "_is_train") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.col(flag) == 1).drop(flag), df.filter(F.col(flag) == 0).drop(flag)


def validate_orders(df: DataFrame, price_range: tuple[float, float], qty_range: tuple[float, float]) -> DataFrame:
    """A column ``valid``: price and quantity are there and within their ranges (bounds included)."""
    ok = F.col("price").between(*price_range) & F.col("qty").between(*qty_range)
    return df.withColumn("valid", F.coalesce(ok, F.lit(False)))
