"""Mixing sources to target weights by Poisson replication (built-in functions only).

Every document of source *s* is repeated a Poisson-distributed number of times
with mean ``rate(s) = weight(s) * budget / bytes(s)``, so that source *s* makes
up ``weight(s)`` of the mixed corpus in expectation. The count is the inverse of
the Poisson distribution function at a uniform number that is hashed from the
document's id and a seed: the same corpus gives the same mixture on any cluster,
with any partitioning, and after any retry.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm._shared import durable, text_or_empty, with_columns

#: Hexadecimal digits of the MD5 digest behind the uniform number: 52 bits fit a double exactly.
_DIGITS = 13
#: Entries of all distribution tables that are broadcast together, eight bytes each.
MOST_ENTRIES = 1 << 21


def hashed_uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from a seed and column values; nulls count as empty."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(2 ** (4 * _DIGITS)))


def log_factorial(k: Column) -> Column:
    """ln k!: exact to 20, Stirling's series beyond (its next term is under 1e-14)."""
    x = k.cast("double")
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(k <= 20, F.ln(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(x * F.ln(x) - x + F.ln(2 * pi * x) / 2 + series)


def poisson_tables(rates: DataFrame, key: str = "source", rate: str = "mix_rate") -> DataFrame:
    """``rates`` plus ``first_count`` and ``cdf``: P(X <= k) for k from ``first_count`` on.

    The table of a rate spans the counts within twelve deviations of it, outside
    of which lies nothing that a double can tell; it grows with the square root of
    the rate. The last entry is 1: every number below has its count.
    """
    r = F.col(rate)
    reach = 12 * F.sqrt(r) + 30
    low, high = F.greatest(F.lit(0), F.floor(r - reach)).cast("long"), F.ceil(r + reach).cast("long")
    spread = rates.select(F.col(key).alias("__key"), r.alias("__r"), F.explode(F.sequence(low, high)).alias("k"))
    p = F.when(F.col("__r") > 0, F.exp(F.col("k") * F.ln("__r") - F.col("__r") - log_factorial(F.col("k")))).otherwise((F.col("k") == 0).cast("double"))
    upto = F.sum(p).over(Window.partitionBy("__key").orderBy("k"))
    tables = spread.withColumn("p", upto).groupBy("__key").agg(F.min("k").alias("first_count"), F.array_sort(F.collect_list(F.struct("k", "p"))).alias("rows"))
    most = F.size("rows") - 1
    cdf = F.concat(F.transform(F.slice("rows", 1, most), lambda x: F.least(x["p"], F.lit(1.0))), F.array(F.lit(1.0)))
    tables = tables.select("__key", "first_count", cdf.alias("cdf"))
    return rates.join(tables, F.col(key).eqNullSafe(F.col("__key"))).drop("__key")


def place_in(table: Column, u: Column) -> Column:
    """How many entries of an increasing array are at most ``u``, by binary search."""
    halvings = F.sequence(F.lit(1), F.length(F.bin(F.size(table))))
    start = F.struct(F.lit(0).alias("a"), F.size(table).alias("b"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["a"] + s["b"], 1)
        right = (s["a"] < s["b"]) & (F.get(table, middle) <= u)
        return F.struct(F.when(right, middle + 1).otherwise(s["a"]).alias("a"), F.when(right, s["b"]).otherwise(middle).alias("b"))

    return F.aggregate(halvings, start, halve)["a"]


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, *, source_col: str = "source", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """One row per source: ``source, source_bytes, mix_rate, first_count, cdf``.

    ``weights`` maps sources to shares (normalised here; a source that isn't
    listed gets none). Without it a source's share goes with the square root of
    its bytes, which damps the largest sources. ``budget`` is the size of the
    mixture in bytes, by default that of the corpus. A source without any byte
    can't reach a share and keeps rate 1.
    """
    size = F.octet_length(text_or_empty(text_col)).cast("long")
    sources = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("source_bytes"))
    if weights is None:
        sources = sources.withColumn("weight", F.sqrt(F.col("source_bytes").cast("double")))
    else:
        listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None)
        sources = sources.withColumn("weight", F.coalesce(F.try_element_at(listed, F.col("source")), F.lit(0.0)) if weights else F.lit(0.0))
    sources = durable(sources)
    totals = sources.agg(F.sum("weight").alias("all_weight"), F.sum("source_bytes").alias("all_bytes"))
    aim = F.col("all_bytes") if budget is None else F.lit(int(budget))
    rate = F.when(F.col("source_bytes") == 0, F.lit(1.0)).otherwise(F.coalesce(F.try_divide(F.col("weight") * aim, F.col("all_weight") * F.col("source_bytes")), F.lit(0.0)))
    # one row of totals: bounded, whatever the corpus
    rates = sources.join(F.broadcast(totals)).withColumn("mix_rate", rate)
    return poisson_tables(durable(rates.select("source", "source_bytes", "mix_rate")))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, seed: int = 17, budget: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", most_broadcast: int = 4096, salts: int = 64) -> DataFrame:
    """All columns of ``docs``, each row repeated, plus ``copy_no`` (from 1), ``mix_rate`` and ``mix_key``.

    Rows are dealt to partitions by ``mix_key``, a hash of id and copy number,
    and ordered by it inside: a global shuffle that leaves no trace of the input
    order. The table of rates is broadcast only if it has at most
    ``most_broadcast`` sources and ``MOST_ENTRIES`` entries; beyond that, documents are salted with a hash of
    their id and joined to the rates repeated once per salt, so that a hot
    source is spread over ``salts`` tasks.

    Repeats aren't bounded: a small source that is to make up a large share has
    its documents repeated as often as that takes. No row is held more than once
    in memory for it.

    Nulls: a null source is a source of its own; a null text has no bytes; a
    null id is hashed as the empty string. Rows that repeat an id draw the same
    count. Columns of the input named like an added one give way. An empty table
    gives an empty table.
    """
    rates = durable(source_rates(docs, weights, source_col=source_col, text_col=text_col, budget=budget)).withColumnsRenamed({"source": "__rate_source", "source_bytes": "__rate_bytes", "mix_rate": "__rate", "first_count": "__first", "cdf": "__cdf"})
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("copy_no", "mix_rate", "mix_key")])
    same = docs[source_col].eqNullSafe(rates["__rate_source"])
    sources, entries = rates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("__cdf")), F.lit(0))).first()
    if sources <= most_broadcast and entries <= MOST_ENTRIES:
        rated = docs.join(F.broadcast(rates), same)
    else:
        salted = docs.withColumn("__salt", F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(salts)))
        spread = rates.withColumn("__rate_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        rated = salted.join(spread, salted[source_col].eqNullSafe(spread["__rate_source"]) & (F.col("__salt") == F.col("__rate_salt"))).drop("__salt", "__rate_salt")
    count = F.col("__first") + place_in(F.col("__cdf"), F.col("__u"))
    drawn = rated.withColumn("__u", hashed_uniform(seed, F.col(id_col))).withColumn("__n", count.cast("int")).filter("__n > 0")
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__n")))).withColumn("mix_rate", F.col("__rate"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy_no").cast("string")))
    mixed = with_columns(copies, mix_key=key).drop("__rate_source", "__rate_bytes", "__rate", "__first", "__cdf", "__u", "__n")
    return mixed.repartition(F.col("mix_key")).sortWithinPartitions("mix_key")
