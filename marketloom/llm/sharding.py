"""Sharding by minimax contiguous partition (built-in functions only).

Groups of equal texts are atoms: they never straddle two shards. Atoms are laid
out in a fixed order and the order is cut into ``k`` runs. The cuts come from
the smallest capacity for which filling shard after shard needs at most ``k`` of
them, found by binary search with a greedy check.

The sums that search and check need are gathered by Spark: first per range of
group keys, then more finely only where a cut can fall. The driver never holds
more than a bounded number of range sums, however many groups there are.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm._shared import durable, text_or_empty, with_columns

#: Most range sums that one step of the search reads back.
MOST_SUMS = 1 << 17


def _lead(groups: DataFrame, k: int, total: int) -> tuple[list[tuple[str, int]], int, int]:
    """The largest groups that get a shard of their own, and bytes and shards left for the rest.

    A group that is at least as large as the mean of the shards still to be
    filled can't share one. There are fewer than ``k`` of them, so the ``k``
    largest rows suffice.
    """
    alone, rest, shards = [], total, k
    for key, size in ((r["key"], r["size"]) for r in groups.orderBy(F.desc("size"), "key").limit(k).collect()):
        if shards <= 1 or size * shards < rest:
            break
        alone.append((key, size))
        rest -= size
        shards -= 1
    return alone, rest, shards


class _Ranges:
    """Sums of adjacent key ranges in order, some of them single groups."""

    def __init__(self, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r["prefix"])
        self.prefix = [r["prefix"] for r in rows]
        self.size = [int(r["size"]) for r in rows]
        self.single = [r["n_groups"] == 1 for r in rows]
        self.largest = max((int(r["largest"]) for r in rows), default=0)
        self.sums = list(accumulate(self.size))

    def reach(self, at: float, capacity: int, hopeful: bool) -> float:
        """How far a shard that starts at ``at`` gets; hopeful: ranges that hold several groups can be cut anywhere."""
        aim = at + capacity
        i = bisect_right(self.sums, aim)
        if i == len(self.sums):
            return self.sums[-1]
        if hopeful and not self.single[i]:
            return aim
        return max(at, self.sums[i - 1] if i else 0)

    def cuts(self, capacity: int, k: int, hopeful: bool) -> list[float]:
        at, out = 0, []
        for _ in range(k):
            at = self.reach(at, capacity, hopeful)
            out.append(at)
        return out

    def smallest(self, k: int, hopeful: bool) -> int:
        low, high = max(self.largest, -(-self.sums[-1] // k)), self.sums[-1]
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, k, hopeful)[-1] >= self.sums[-1]:
                high = middle
            else:
                low = middle + 1
        return low

    def open(self, k: int) -> tuple[int, list[int]]:
        """The capacity as far as known, and the ranges that must be seen more finely."""
        low, high = self.smallest(k, True), self.smallest(k, False)
        unsure: set[int] = set()
        for a, b in zip(self.cuts(low, k, False), self.cuts(high, k, True), strict=True):
            first, last = bisect_right(self.sums, min(a, b)), bisect_right(self.sums, max(a, b))
            unsure.update(i for i in range(first, min(last + 1, len(self.sums))) if not self.single[i])
        return high, sorted(unsure)


def minimax_cuts(groups: DataFrame, k: int) -> list[str]:
    """Keys at which a new shard begins, for ``groups(key, size)`` in the order of their hexadecimal keys."""

    def sums(rows: DataFrame, digits: int) -> list:
        return rows.groupBy(F.substring("key", 1, digits).alias("prefix")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_groups"), F.max("size").alias("largest")).collect()

    found = {r["prefix"]: r.asDict() for r in sums(groups, 3)}
    if not found or k <= 1:
        return []
    while True:
        ranges = _Ranges(list(found.values()))
        capacity, unsure = ranges.open(k)
        if not unsure:
            break
        unsure = unsure[: MOST_SUMS // 16]
        deeper = 1
        while deeper < 4 and len(unsure) * 16 ** (deeper + 1) <= MOST_SUMS:
            deeper += 1
        chosen = [ranges.prefix[i] for i in unsure]
        for digits in sorted({len(p) for p in chosen}):
            some = [p for p in chosen if len(p) == digits]
            for p in some:
                del found[p]
            found |= {r["prefix"]: r.asDict() for r in sums(groups.filter(F.substring("key", 1, digits).isin(some)), digits + deeper)}
    at, begins = 0, []
    for _ in range(k - 1):
        at = ranges.reach(at, capacity, False)
        if at >= ranges.sums[-1]:
            break
        begins.append(ranges.prefix[bisect_right(ranges.sums, at)])
    return begins


def shard_documents(docs: DataFrame, k: int = 24, *, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``size, text_crc32, law, shard, slot, grown_shard``.

    Law ``bytes``: shard sizes (UTF-8 bytes of the text plus 8 per row) are as
    near equal as whole groups of equal texts allow. Groups are ordered by the
    MD5 digest of their text; those that are larger than a mean shard come
    first, on their own. ``slot`` numbers the rows of a shard from 0 without
    gaps, in the order of the MD5 digest of the id (a random order, as training
    wants); it is numbered in chunks of that digest whose offsets are summed, so
    that no shard has to pass through one task, and a hot group is spread over
    all chunks of its shard. Rows that repeat an id get neighbouring slots; where
    that must not be, ``order_col`` names a column that tells them apart: slots
    then follow the MD5 digest of it, and it is dropped.

    Nulls: a null text is an empty one, a null id is hashed as the empty string.
    Repeated rows are rows like others. Rows of one id in one shard are numbered
    by their text's digest. Input columns named like an added one give way. An
    empty table gives an empty one; with fewer groups than shards some shards
    stay empty.
    """
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")])
    text = text_or_empty(text_col)
    sized = with_columns(docs, __key=F.md5(text.cast("binary")), size=F.octet_length(text).cast("long") + F.lit(8))
    order = F.md5(F.coalesce(F.col(order_col or id_col).cast("string"), F.lit("")))
    # what the search and the numbering need of a row; texts are read again only to be dealt out
    narrow = durable(sized.select("__key", "size", order.alias("__order")))
    groups = durable(narrow.groupBy(F.col("__key").alias("key")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_rows")))
    total, rows = groups.agg(F.sum("size"), F.sum("n_rows")).first()
    alone, _, shards = _lead(groups, k, total or 0)
    rest = groups.filter(~F.col("key").isin([key for key, _ in alone])) if alone else groups
    begins = minimax_cuts(rest, shards)

    shard = F.lit(len(alone))
    for key in begins:
        shard = shard + (F.col("__key") >= F.lit(key)).cast("int")
    for i, (key, _) in enumerate(alone):
        shard = F.when(F.col("__key") == F.lit(key), F.lit(i)).otherwise(shard)

    # about 4096 rows to a chunk
    digits = 1
    while digits < 8 and (rows or 0) / k / 16**digits > 4096:
        digits += 1
    dealt = with_columns(sized, text_crc32=F.crc32(text.cast("binary")), law=F.lit("bytes"), shard=shard.cast("int"), __order=order)
    dealt = dealt.withColumn("__chunk", F.substring("__order", 1, digits))
    keyed = narrow.select(shard.cast("int").alias("__s"), F.substring("__order", 1, digits).alias("__c"))
    counts = keyed.groupBy("__s", "__c").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__s").orderBy("__c")) - F.col("__n")
    # one row for each shard and chunk: a 4096th of the documents at most
    offsets = counts.select("__s", "__c", before.alias("__before"))
    joined = dealt.join(offsets, (F.col("shard") == F.col("__s")) & (F.col("__chunk") == F.col("__c")))
    place = F.row_number().over(Window.partitionBy("shard", "__chunk").orderBy("__order", id_col, "__key")) - 1
    slotted = joined.withColumn("slot", (F.col("__before") + place).cast("long")).withColumn("grown_shard", F.lit(None).cast("int"))
    return slotted.drop("__key", "__order", "__chunk", "__s", "__c", "__before", *[order_col] * bool(order_col))
