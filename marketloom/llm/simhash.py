"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint has 64 bits; two documents link if theirs differ in at most three.
Fingerprints are cut into three segments. By the pigeonhole principle three
differing bits leave either one segment untouched and another with one
difference at most, or exactly one difference in each segment. Differences of one
bit inside a segment are bridged by the binary Golay code: a segment is decoded
to its nearest codeword and to those a step further, so that segments one bit
apart share a codeword's index. Equal keys are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm._shared import durable

BITS = 64
#: Segment widths and the most differing bits of a link.
SEGMENTS = (21, 21, 22)
MOST_BITS = 3
#: Fingerprints of one key that a task compares among themselves; more go to ``_by_neighbourhood``.
MOST_IN_BUCKET = 20_000
#: The generator polynomial of the [23, 12, 7] Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


# --- fingerprints -----------------------------------------------------------


def shingles(text: str | None, words: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``words`` words, in order; a shorter text is one run, one without words has none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    line, words = b" ".join(parts), min(words, len(parts))
    if not parts:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    begins = np.concatenate(([0], ends[: len(parts) - words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], seed) for a, b in zip(begins, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(begins))


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text, of its shingles with repeats."""
    return fingerprint_of(shingles(text, words, seed))


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of some shingles: a bit is set if over half of their XXH64 have it set."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):  # bounded memory for long texts
        block = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text_col: str = "text", words: int = 3, seed: int = 42):
    """Fingerprints of a text column as signed longs, in Arrow batches."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out = np.fromiter((fingerprint(t, words, seed) for t in batch), np.uint64, len(batch))
            yield pd.Series(out.view(np.int64))

    return of(F.col(text_col))


# --- the Golay code ---------------------------------------------------------


@lru_cache(1)
def golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """``(syndromes, leaders)``: the syndrome of each 23-bit word's bits, and the error of weight 3 or less behind each of the 2048 syndromes.

    The code is perfect: every syndrome has exactly one such error.
    """
    syndromes = np.empty(23, np.int64)
    for i in range(23):
        r = 1 << i
        for j in range(i, 10, -1):
            if r >> j & 1:
                r ^= GENERATOR << (j - 11)
        syndromes[i] = r
    leaders = np.full(2048, -1, np.int64)
    leaders[0] = 0
    for i in range(23):
        leaders[syndromes[i]] = 1 << i
        for j in range(i):
            leaders[syndromes[i] ^ syndromes[j]] = 1 << i | 1 << j
            for k in range(j):
                leaders[syndromes[i] ^ syndromes[j] ^ syndromes[k]] = 1 << i | 1 << j | 1 << k
    return syndromes, leaders


def nearest_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (the 12 information bits) of the nearest codeword of each 23-bit word."""
    syndromes, leaders = golay_tables()
    s = np.zeros(len(words), np.int64)
    for i in range(23):
        s ^= np.where(words >> i & 1, syndromes[i], 0)
    return (words ^ leaders[s]) >> 11


def fuzzy_indices(words: np.ndarray, width: int) -> np.ndarray:
    """Codeword indices of each word, shape (n, 1 + width), -1 where there is none.

    The first is the nearest codeword. A word one bit away may have another one;
    of such a couple of codewords only the larger side also takes the smaller
    index, which is enough for both to share it.
    """
    own = nearest_codewords(words)
    out = np.full((len(words), 1 + width), -1, np.int64)
    out[:, 0] = own
    for i in range(width):
        other = nearest_codewords(words ^ (1 << i))
        out[:, 1 + i] = np.where(other < own, other, -1)
    rest = np.sort(out[:, 1:], axis=1)  # each index once
    rest[:, 1:][rest[:, 1:] == rest[:, :-1]] = -1
    out[:, 1:] = np.sort(rest, axis=1)[:, ::-1]
    most = int((out >= 0).sum(axis=1).max(initial=1))
    return out[:, :most]


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row numbers, keys)``: fingerprints at most three bits apart share a key.

    Kinds 0 to 5 combine one segment as it is with a codeword index of another;
    kind 6 combines codeword indices of all three.
    """
    prints, parts, at = prints.astype(np.uint64), [], 0
    for width in SEGMENTS:
        parts.append((prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64))
        at += width
    fuzzy = [fuzzy_indices(p, w) for p, w in zip(parts, SEGMENTS, strict=True)]
    rows, keys, number = [], [], np.arange(len(prints))
    kinds = [(a, b) for a in range(3) for b in range(3) if a != b]
    for kind, (a, b) in enumerate(kinds):
        for j in range(fuzzy[b].shape[1]):
            has = fuzzy[b][:, j] >= 0
            rows.append(number[has])
            keys.append((kind << 56) | parts[a][has] << 12 | fuzzy[b][has, j])
    for i in range(fuzzy[0].shape[1]):
        for j in range(fuzzy[1].shape[1]):
            for k in range(fuzzy[2].shape[1]):
                has = (fuzzy[0][:, i] >= 0) & (fuzzy[1][:, j] >= 0) & (fuzzy[2][:, k] >= 0)
                if has.any():
                    rows.append(number[has])
                    keys.append((6 << 56) | fuzzy[0][has, i] << 24 | fuzzy[1][has, j] << 12 | fuzzy[2][has, k])
    return np.concatenate(rows), np.concatenate(keys)


# --- links ------------------------------------------------------------------


def spanning_links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as two arrays of positions.

    Searches breadth first; each step compares one fingerprint with those not
    reached yet, so that output stays linear and memory is one row of distances.
    """
    left, right = [], []
    todo = np.arange(len(prints))
    while len(todo) > 1:
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            x = queue.pop()
            near = np.bitwise_count(prints[todo] ^ prints[x]) <= MOST_BITS
            if near.any():
                found = todo[near]
                left.append(np.full(len(found), x))
                right.append(found)
                queue.extend(found.tolist())
                todo = todo[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _link_buckets(most: int):
    """A function over key-ordered batches: links inside each key's fingerprints; (fp, null) for those of larger buckets."""

    def links(keys: np.ndarray, prints: np.ndarray) -> tuple[list, list]:
        a, b = [], []
        if not len(keys):
            return a, b
        begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.append(begins, len(keys)))
        two = begins[sizes == 2]  # most shared buckets: all at once
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= MOST_BITS]
        a.append(prints[near])
        b.append(prints[near + 1])
        for begin, size in zip(begins[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            own = prints[begin : begin + size]
            x, y = spanning_links(own)
            a.append(own[x])
            b.append(own[y])
        return a, b

    def batch(a: np.ndarray, b: np.ndarray | None) -> pa.RecordBatch:
        left = pa.array(a.view(np.int64))
        return pa.RecordBatch.from_arrays([left, pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64))], schema=_LINK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints, over = np.empty(0, np.int64), np.empty(0, np.uint64), False
        for piece in batches:
            keys = np.concatenate((keys, piece.column(0).to_numpy()))
            prints = np.concatenate((prints, piece.column(1).to_numpy().view(np.uint64)))
            last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
            if over and last:
                end = int(np.searchsorted(keys, keys[0], "right"))
                yield batch(prints[:end], None)
                keys, prints, over, last = keys[end:], prints[end:], False, last - end
            if last:
                a, b = links(keys[:last], prints[:last])
                if sum(map(len, a)):
                    yield batch(np.concatenate(a), np.concatenate(b))
                keys, prints = keys[last:], prints[last:]
            if over or len(keys) > most:
                yield batch(prints, None)
                keys, prints, over = keys[-1:], prints[-1:], True
        if over:
            yield batch(prints, None)
        else:
            a, b = links(keys, prints)
            if a and sum(map(len, a)):
                yield batch(np.concatenate(a), np.concatenate(b))

    return run


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in batches:
        prints = piece.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(prints), 1 << 14):
            own = prints[at : at + (1 << 14)]
            rows, keys = fuzzy_keys(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[rows].view(np.int64))], names=["key", "fp"])


def _by_neighbourhood(prints: DataFrame) -> DataFrame:
    """Links among ``fp`` without comparing pairs, for buckets too large to compare in one task.

    Two fingerprints at most three bits apart have a word between them that is one
    bit at most from one of them and two at most from the other. The smallest
    fingerprint in a word's ball of radius one links to all in its ball of radius
    two: each such link is a true one, and they connect whatever a true link connects.
    """
    one = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    flips = prints.sparkSession.range(1).select(one.alias("one"))
    pairs = flips.select(F.explode("one").alias("x"), "one").select("x", F.explode("one").alias("y")).select(F.col("x").bitwiseXOR(F.col("y")).alias("flip")).distinct()
    singles = flips.select(F.explode("one").alias("flip"))
    near = prints.join(F.broadcast(singles)).groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("word")).agg(F.min("fp").alias("a"))
    far = prints.join(F.broadcast(pairs)).select(F.col("fp").alias("b"), F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    return near.join(far, "word").filter("a <> b").select("a", "b").distinct()


def links(prints: DataFrame, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` (long) of a table that are three bits or fewer apart.

    Not every pair is listed, but what any pair connects is connected. Buckets of
    equal keys hold distinct fingerprints only, so copies don't enlarge them.
    """
    keyed = prints.select("fp").mapInArrow(_emit_keys, "key long, fp long")
    found = durable(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_link_buckets(most_in_bucket), "a long, b long"))
    crowded = found.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    plain = found.filter("b IS NOT NULL")
    return plain.unionByName(_by_neighbourhood(crowded)) if not crowded.isEmpty() else plain


# --- components -------------------------------------------------------------


def connected_components(edges: DataFrame, most_rounds: int = 50, tasks: int | None = None) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges(a, b)``: the smallest node that each can reach.

    Alternates two steps until nothing changes. Large step: a node hands its
    smallest neighbour to its larger neighbours. Small step: a node hands it to
    its smaller ones. Paths halve, so the rounds grow with the logarithm of the
    longest one. Every round is written to the shared checkpoint folder.
    ``tasks``: in how many tasks its small tables are held, if not as Spark sees fit.
    """
    fit = lambda df: df.coalesce(tasks) if tasks else df
    both = durable(fit(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()))
    before = None
    for _ in range(most_rounds):
        way = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = fit(way.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = fit(way.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        low = fit(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        both = durable(fit(small.filter("u <> v").distinct()))
        state = both.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    members = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return members.unionByName(both.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_components(rows: DataFrame, classes: DataFrame, found: DataFrame, tasks: int | None = None) -> DataFrame:
    """``rows(id, fp)`` plus ``component_id``, from ``classes(fp, first_id)`` and the links ``found(a, b)`` between values of ``fp``."""
    # rows of one id with different texts hold their classes together
    again = Window.partitionBy("id")
    same = rows.filter("id IS NOT NULL").distinct().withColumn("least", F.min("fp").over(again)).filter("least <> fp").select(F.col("least").alias("a"), F.col("fp").alias("b"))
    members = durable(connected_components(found.unionByName(same), tasks=tasks))
    named = classes.join(members, classes["fp"] == members["node"])
    ids = named.groupBy("component").agg(F.min("first_id").alias("least_id"))
    linked = members.join(ids, "component").select("node", "least_id")
    all_classes = durable(classes.join(linked, classes["fp"] == linked["node"], "left").select("fp", F.when(F.col("node").isNotNull(), F.col("least_id")).otherwise(F.col("first_id")).alias("component_id")))
    # a hot fingerprint is one row on the right: adaptive execution splits the left side
    return rows.join(all_classes.hint("merge"), "fp")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most_in_bucket: int = MOST_IN_BUCKET) -> DataFrame:
    """``doc_id, fingerprint (16 hexadecimal digits), component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id that a document reaches by links, its own
    included. Nulls: a null text counts as empty (fingerprint zero, linked like
    any other); a row without an id belongs to its component, whose id is null if
    no row in it has one. Rows that repeat an id are one document: what either of
    them links to is one component. Texts of any length are read whole. Empty
    tables give empty ones; other columns are left aside.
    """
    rows = durable(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, words).alias("fp")))
    classes = durable(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    found = links(classes, most_in_bucket)
    out = with_components(rows, classes, found)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, components: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose id is its own component's; of a repeated id the one with the smallest text."""
    kept = components.filter(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept")).distinct()
    named = docs.filter(F.col(id_col).isNotNull()).join(kept, F.col(id_col) == F.col("__kept"), "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_last())
    one = named.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth")
    return one.unionByName(docs.filter(F.col(id_col).isNull()))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; all columns stay.

    Rows without an id can't be named by a decision and stay as they are. Of rows
    that repeat an id the one with the smallest text stays.
    """
    return keep_least(docs, near_duplicates(docs, id_col=id_col, text_col=text_col), id_col, text_col)
