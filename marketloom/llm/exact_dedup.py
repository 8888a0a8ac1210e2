"""Exact deduplication of arriving documents against immutable snapshots.

A snapshot is a table of digests that no longer changes, stored with the static
binary-fuse filters that are built once for its ranges. A new snapshot holds what
none of the earlier ones does, so that a batch is screened against all of them in
turn. Arriving digests are first reduced to
one row per digest, then screened by the filter of their range: a negative is
certainly new, a positive joins the snapshot's exact bucket and counts as known
only if all bytes of the SHA-256 and the length agree. New digests are grouped among themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm._shared import durable, text_or_empty, with_columns

#: Characters that don't count when texts are compared.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and seed."""
    x = keys + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, seed: int, segment: int, segments: int) -> np.ndarray:
    """Three slots of each key, in three neighbouring segments."""
    h = _mix(keys, seed)
    first = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    out = np.empty((3, len(keys)), np.int64)
    for j, shift in enumerate((0, 18, 36)):
        inner = (_mix(h, j + 1) >> np.uint64(shift % 23)) & np.uint64(segment - 1)
        out[j] = ((first + np.uint64(j)) * np.uint64(segment) + inner).astype(np.int64)
    return out


def _prints(keys: np.ndarray, seed: int) -> np.ndarray:
    return (_mix(keys, seed + 7919) & np.uint64(0xFFFF)).astype(np.uint16)


def build_fuse_filter(keys: np.ndarray) -> tuple[int, int, int, np.ndarray]:
    """``(seed, segment length, number of start segments, 16-bit fingerprints)`` for distinct uint64 keys.

    Keys that are alone in one of their slots are peeled off in rounds, all of a
    round at once; their fingerprints are set in the opposite order. A seed under
    which some keys can't be peeled is replaced by the next one, with a little
    more room.
    """
    keys = np.unique(np.asarray(keys, np.uint64))
    n = len(keys)
    segment = 1 << max(2, int(np.log(max(n, 2)) / np.log(3.33) + 2.25))
    for seed in range(1, 200):
        room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) + 0.02 * (seed - 1)
        segments = max(1, int(np.ceil(n * room / segment)) - 2)
        slots, size = _slots(keys, seed, segment, segments), (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)  # XOR of the keys' numbers in a slot
        for j in range(3):
            np.bitwise_xor.at(owner, slots[j], np.arange(n))
        rounds: list[tuple[np.ndarray, np.ndarray]] = []
        left, ready = n, np.flatnonzero(count == 1)
        while len(ready):
            found, where = np.unique(owner[ready], return_index=True)
            rounds.append((found, ready[where]))
            left -= len(found)
            touched = slots[:, found]
            np.subtract.at(count, touched.ravel(), 1)
            np.bitwise_xor.at(owner, touched.ravel(), np.tile(found, 3))
            ready = np.unique(touched.ravel())
            ready = ready[count[ready] == 1]
        if left:
            continue
        prints, want = np.zeros(size, np.uint16), _prints(keys, seed)
        for found, where in reversed(rounds):
            a, b, c = slots[:, found]
            prints[where] = 0
            prints[where] = want[found] ^ prints[a] ^ prints[b] ^ prints[c]
        return seed, segment, segments, prints
    raise ValueError("no seed peels these keys")


def in_fuse_filter(keys: np.ndarray, built: tuple[int, int, int, np.ndarray]) -> np.ndarray:
    """Whether the filter holds each key: always true for its own, for others once in 65,536."""
    seed, segment, segments, prints = built
    a, b, c = _slots(keys, seed, segment, segments)
    return (prints[a] ^ prints[b] ^ prints[c]) == _prints(keys, seed)


_FILTER = "part int, seed int, segment int, segments int, prints binary"


def snapshot_filters(snapshot: DataFrame, parts: int) -> DataFrame:
    """Build the filters of a snapshot with a long column ``digest``: one row per range of digests."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, prints = build_fuse_filter(pdf["digest"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"part": [pdf["part"].iat[0]], "seed": seed, "segment": segment, "segments": segments, "prints": [prints.tobytes()]})

    return snapshot.select(_part(parts), "digest").groupBy("part").applyInPandas(build, _FILTER)


def _part(parts: int):
    return F.pmod("digest", F.lit(parts)).cast("int").alias("part")


def screen(arriving: DataFrame, filters: DataFrame, parts: int) -> DataFrame:
    """Distinct ``digest`` values of ``arriving`` with ``maybe_known``: false is certain."""

    def test(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(left), bool)
        if len(right) and len(left):
            f = right.iloc[0]
            built = (int(f["seed"]), int(f["segment"]), int(f["segments"]), np.frombuffer(f["prints"], np.uint16))
            hit = in_fuse_filter(left["digest"].to_numpy(np.int64).view(np.uint64), built)
        return pd.DataFrame({"digest": left["digest"], "maybe_known": hit})

    left = arriving.select(_part(parts), "digest").groupBy("part")
    return left.cogroup(filters.groupBy("part")).applyInPandas(test, "digest long, maybe_known boolean")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, chars, sha, bytes, digest`` of every row: texts are compared without ASCII white space."""
    text = text_or_empty(text_col)
    bare = F.translate(text, WHITE_SPACE, "")
    out = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("chars"), F.sha2(bare.cast("binary"), 256).alias("sha"), F.octet_length(bare).cast("long").alias("bytes"))
    return out.withColumn("digest", F.conv(F.substring("sha", 1, 15), 16, 10).cast("long"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """One row per text: how many rows have it, and which stays (most code points, then smallest id).

    The aggregation combines before its shuffle, so that copies of one text cost
    one row per task however many there are.
    """
    best = F.min(F.struct(F.negative(F.col("chars")).alias("minus_chars"), F.col("id").isNull().alias("no_id"), "id"))
    return rows.groupBy("digest", "sha", "bytes").agg(F.count(F.lit(1)).alias("n"), best.alias("best"))


#: What makes a text known.
_EXACT = ["digest", "sha", "bytes"]


@dataclass(frozen=True)
class Snapshot:
    """Distinct texts as ``distinct_texts`` gives them, the filters of their digests and the number of filters."""

    texts: DataFrame
    filters: DataFrame
    parts: int


def _parts_of(texts: DataFrame, parts: int | None, keys_per_filter: int) -> int:
    return parts or max(1, -(-texts.count() // keys_per_filter))


def build_snapshot(texts: DataFrame, *, parts: int | None = None, keys_per_filter: int = 200_000) -> Snapshot:
    """A snapshot for this job. ``parts``: filters, by default so many that each holds about ``keys_per_filter`` digests."""
    parts = _parts_of(texts, parts, keys_per_filter)
    return Snapshot(texts, durable(snapshot_filters(texts.select("digest").distinct(), parts)), parts)


def save_snapshot(texts: DataFrame, path: str, *, parts: int | None = None, keys_per_filter: int = 200_000) -> Snapshot:
    """Store texts and filters under ``path``, once: a snapshot that is there already is an error, as it never changes."""
    texts.write.parquet(f"{path}/texts")
    stored = texts.sparkSession.read.parquet(f"{path}/texts")
    parts = _parts_of(stored, parts, keys_per_filter)
    snapshot_filters(stored.select("digest").distinct(), parts).withColumn("parts", F.lit(parts)).write.parquet(f"{path}/filters")
    return load_snapshot(texts.sparkSession, path)


def load_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """A stored snapshot; one without texts has no filter."""
    filters = spark.read.parquet(f"{path}/filters")
    parts = filters.agg(F.max("parts")).first()[0] or 1
    return Snapshot(spark.read.parquet(f"{path}/texts"), filters.drop("parts"), parts)


def _screened(arriving: DataFrame, snapshot: Snapshot) -> DataFrame:
    tested = screen(arriving.select("digest").distinct(), snapshot.filters, snapshot.parts)
    return durable(arriving.join(tested, "digest"))


def _unknown(screened: DataFrame, snapshot: Snapshot) -> DataFrame:
    """What the filter is sure of, and the false positives: nothing of the snapshot is behind them either."""
    false = screened.filter("maybe_known").join(snapshot.texts.select(*_EXACT), _EXACT, "left_anti")
    return screened.filter("NOT maybe_known").unionByName(false).select(*_EXACT, "n", "best")


def new_texts(arriving: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """The texts of a batch (as ``distinct_texts`` gives them) that no snapshot holds: the next snapshot."""
    for snapshot in snapshots:
        arriving = _unknown(_screened(arriving, snapshot), snapshot)
    return arriving


def dedup_against(arriving: DataFrame, snapshots: list[Snapshot]) -> DataFrame:
    """Merge the distinct texts of a batch into snapshots that share no text.

    Returns one row per text of any side, ``digest, sha, bytes, n, best``, with
    counts and the staying row over all.
    """
    sides = []
    for snapshot in snapshots:
        screened = _screened(arriving, snapshot)
        positives = screened.filter("maybe_known").select(*_EXACT, F.col("n").alias("n2"), F.col("best").alias("best2"))
        known = snapshot.texts.join(positives, _EXACT, "left")
        sides.append(known.select(*_EXACT, (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), F.least("best", "best2").alias("best")))
        arriving = _unknown(screened, snapshot)
    for side in sides:
        arriving = arriving.unionByName(side)
    return arriving


def dedup_arriving(arriving: DataFrame, snapshot: DataFrame, *, parts: int | None = None, keys_per_filter: int = 200_000) -> DataFrame:
    """``dedup_against`` one snapshot whose filters are built for it."""
    return dedup_against(arriving, [build_snapshot(snapshot, parts=parts, keys_per_filter=keys_per_filter)])


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text, plus ``keep_id, group_size, kept, text_sha256``.

    The rows are taken as two batches, by the parity of a hash of their id: the
    first makes the snapshot, the second arrives. Groups and counts cover both.
    Of equal texts the row with the most code points stays, then the smallest id,
    which may be of any type that has an order.

    Nulls: a null text is an empty one; a row without an id belongs to its
    group, and ``keep_id`` is null only if no row of the longest form has an id;
    such a group's rows with a null id are the kept ones. Rows that repeat id and
    text are all kept or all dropped together, as nothing tells them apart. Input
    columns named like an added one give way. Empty tables give empty ones.
    """
    rows = durable(digests(docs, id_col=id_col, text_col=text_col).withColumn("second", F.pmod(F.xxhash64("id"), F.lit(2)) == 1))
    groups = dedup_arriving(distinct_texts(rows.filter("second")), durable(distinct_texts(rows.filter("NOT second"))))
    stays = groups.select("sha", F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"), F.negative(F.col("best.minus_chars")).alias("keep_chars"))
    # a hot text is one row on the right: adaptive execution splits the left side
    joined = rows.select("id", "chars", "sha").join(stays.hint("merge"), "sha")
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("chars") == F.col("keep_chars"))
    return joined.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_duplicates`` drops; all columns stay.

    Rows without an id can't be named by a decision and stay.
    """
    dropped = exact_duplicates(docs, id_col=id_col, text_col=text_col).filter("NOT kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    keyed = with_columns(docs, __own=F.sha2(F.translate(text_or_empty(text_col), WHITE_SPACE, "").cast("binary"), 256))
    return keyed.join(dropped.distinct(), (F.col(id_col) == F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_anti").drop("__own")
