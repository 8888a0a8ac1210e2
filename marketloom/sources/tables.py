"""Readers with declared schemas, row numbers, shares of series, prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.sources.durable import durable

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


def read_table(spark: SparkSession, path: str, fmt: str, schema: T.StructType | str, drop_index: bool = False) -> DataFrame:
    """Read CSV (with header) or Parquet with a declared schema; ``drop_index`` leaves out a leading index column."""
    reader = spark.read.schema(schema).format(fmt)
    df = (reader.option("header", True) if fmt == "csv" else reader).load(path)
    return df.drop(df.columns[0]) if drop_index else df


def _ranged(df: DataFrame, order_cols: list, parts: int | None = None) -> DataFrame:
    """``df`` sorted into range partitions that a checkpoint fixes, with ``__part`` and the row's ``__place`` in it.

    The place is that in the stored partition, so that no window and no second
    shuffle is needed to number rows.
    """
    sorted_rows = df.repartitionByRange(*([parts] if parts else []), *order_cols).sortWithinPartitions(*order_cols)
    held = durable(sorted_rows).withColumn("__id", F.monotonically_increasing_id())
    part, place = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumns({"__part": part, "__place": place}).drop("__id")


def _offsets(ranged: DataFrame) -> DataFrame:
    """``__part, __before``: how many rows lie in earlier partitions; one row per partition."""
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    return counts.select("__part", F.col("__n").alias("__part_rows"), (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))


def number_rows(df: DataFrame, order_cols: list, name: str, parts: int | None = None, keep_parts: bool = False) -> DataFrame:
    """Global row numbers from 0 in the order of ``order_cols``, without passing through one task.

    Rows are range-partitioned, sorted and fixed by a checkpoint; the counts of
    the partitions, one row each, give the offsets. ``keep_parts`` leaves
    ``__part``, ``__place`` and ``__part_rows`` in.
    """
    ranged = _ranged(df, order_cols, parts)
    numbered = ranged.join(F.broadcast(_offsets(ranged)), "__part")
    numbered = numbered.withColumn(name, F.col("__before") + F.col("__place")).drop("__before")
    return numbered if keep_parts else numbered.drop("__part", "__place", "__part_rows")


def rank_within(df: DataFrame, keys: list[str], order_cols: list, name: str) -> DataFrame:
    """Row numbers from 0 inside each group, and ``__group_rows``, however large a group is.

    Groups lie side by side in range partitions; a group's first global number,
    one row per group, is taken off. Null keys are a group.
    """
    numbered = number_rows(df, [*keys, *order_cols], "__row")
    first = numbered.groupBy(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)])
    first = first.agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__group_rows"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    ranked = numbered.join(first, same) if keys else numbered.join(F.broadcast(first))
    return ranked.withColumn(name, F.col("__row") - F.col("__first")).drop("__row", "__first", *[f"__key_{i}" for i in range(len(keys))])


def running(df: DataFrame, keys: list[str], order_cols: list, *, sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, nexts: dict[str, str] | None = None, lags: dict[str, str] | None = None) -> DataFrame:
    """Running values inside each group in an order: sums and last known values up to a row, next known values from it on, values of the row before.

    ``sums``, ``lasts``, ``nexts`` and ``lags`` map new names to columns. No window is wider
    than a range partition: what a group has gathered in earlier partitions (for ``nexts`` in later
    ones), one row per group and partition, is added to the partition's own running value. One sort serves both directions.
    """
    sums, lasts, nexts, lags = sums or {}, lasts or {}, nexts or {}, lags or {}
    ranged = _ranged(df, [*keys, *order_cols])
    inside = Window.partitionBy("__part", *keys).orderBy("__place")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    fromon = Window.partitionBy("__part", *keys).orderBy(F.desc("__place")).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.desc("__part")).rowsBetween(Window.unboundedPreceding, -1)
    known = lambda c, by=F.max_by: by(c, F.when(F.col(c).isNotNull(), F.col("__place")))
    totals = ranged.groupBy("__part", *keys).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()], *[known(c).alias(f"__last_{n}") for n, c in lasts.items()],
        *[known(c, F.min_by).alias(f"__next_{n}") for n, c in nexts.items()],
        *[F.max_by(F.struct(F.col(c).alias("v")), "__place").alias(f"__lag_{n}") for n, c in lags.items()],
    )
    carried = totals.select(
        F.col("__part").alias("__p"), *[F.col(k).alias(f"__key_{i}") for i, k in enumerate(keys)],
        *[F.sum(f"__sum_{n}").over(earlier).alias(f"__sum_{n}") for n in sums],
        *[F.last(f"__last_{n}", ignorenulls=True).over(earlier).alias(f"__last_{n}") for n in lasts],
        *[F.last(f"__next_{n}", ignorenulls=True).over(later).alias(f"__next_{n}") for n in nexts],
        *[F.last(f"__lag_{n}").over(earlier).alias(f"__lag_{n}") for n in lags],
    )
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{i}"))
    own = ranged.withColumns(
        {f"__own_{n}": F.sum(c).over(upto) for n, c in sums.items()}
        | {f"__own_{n}": F.last(c, ignorenulls=True).over(upto) for n, c in lasts.items()}
        | {f"__own_{n}": F.last(c, ignorenulls=True).over(fromon) for n, c in nexts.items()}
        | {f"__own_{n}": F.lag(c).over(inside) for n, c in lags.items()}
        | ({"__nth": F.row_number().over(inside)} if lags else {})
    )
    joined = own.join(carried, same)
    zero = F.lit(0)
    added = lambda n: F.when(F.col(f"__own_{n}").isNull() & F.col(f"__sum_{n}").isNull(), None).otherwise(
        F.coalesce(f"__own_{n}", zero) + F.coalesce(f"__sum_{n}", zero))
    out = {n: added(n) for n in sums} | {n: F.coalesce(f"__own_{n}", f"__last_{n}") for n in lasts}
    out |= {n: F.coalesce(f"__own_{n}", f"__next_{n}") for n in nexts}
    out |= {n: F.when(F.col("__nth") == 1, F.col(f"__lag_{n}.v")).otherwise(F.col(f"__own_{n}")) for n in lags}
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def with_event_index(df: DataFrame, order_cols: list, series_len: int = 100, key: str | None = None) -> DataFrame:
    """Series id and position: from the row number if there is no key, inside the key otherwise."""
    if key:
        return df.withColumn("event_idx", (F.row_number().over(Window.partitionBy(key).orderBy(*order_cols)) - 1).cast("long"))
    numbered = number_rows(df, order_cols, "__row")
    return numbered.withColumn("obs_id", F.floor(F.col("__row") / series_len).cast("long")).withColumn("event_idx", F.col("__row") % series_len).drop("__row")


def head_series(df: DataFrame, labels: DataFrame, frac: float, key: str = "obs_id") -> tuple[DataFrame, DataFrame]:
    """The first share of whole series by id, and their labels."""
    ranked = durable(number_rows(df.select(key).distinct(), [key], "__rank"))
    share = F.floor(F.count(F.lit(1)) * frac)
    kept = ranked.join(F.broadcast(ranked.agg(share.alias("__most"))), F.col("__rank") < F.col("__most")).select(key)
    return df.join(kept, key, "left_semi"), labels.join(kept, key, "left_semi")


def write_predictions(df: DataFrame, path: str, id_col: str, fmt: str = "parquet") -> None:
    """Write predictions with the id first."""
    out = df.select(id_col, *[c for c in df.columns if c != id_col])
    writer = out.write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def rounded(df: DataFrame, columns: str, digits: int = 6) -> DataFrame:
    """Columns rounded for comparison; negative zero becomes zero."""
    names = columns.split()

    def one(c: str) -> Column:
        return (F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c)

    return df.select(*[one(c) if c in names else F.col(f"`{c}`") for c in df.columns])
