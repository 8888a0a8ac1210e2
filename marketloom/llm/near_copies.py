"""Near-dedup by SimHash with an exact similarity: five-word shingles, Jaccard 0.8.

Two documents link if the Jaccard similarity of their sets of five-word shingles
is at least 0.8. SimHash fingerprints of the sets and the Golay-code fuzzy keys of
``simhash`` bring the close ones together; a pair counts only if its sets are
similar. Sets of similarity 0.8 differ in some ten of 64 bits, beyond what keys of
three bits promise, so a join by prefixes finds the links that are left: all sets
are put into one order, and two similar sets of n and m shingles share one among
the first n - ceil(0.8 n) + 1 of the one and of the other. Only these prefixes are
shuffled. The sets of documents that meet are compared by bitmaps, whose differing
bits are no more than the differing shingles and rule out most pairs, and the rest
as a whole. No link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm._shared import durable, forget
from marketloom.llm.simhash import connected_components, fingerprint_of, keep_least, links, shingles, with_components

#: Words of a shingle and the similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: One of so many texts is looked at for frequent shingles; those in so many of them, the most frequent ones, are last in the order.
SAMPLED, FREQUENT, MOST_FREQUENT = 16, 4, 1 << 18
#: Digests of sets that are sent to all executors; more are joined by a shuffle.
MOST_BROADCAST = 1 << 20
_MET = pa.schema([("token", pa.int64()), ("fp", pa.int64()), ("size", pa.int32()), ("place", pa.int32()), ("before", pa.int64())])


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct shingles of a text, in increasing order."""
    return np.unique(shingles(text, words))


def set_digest(own: np.ndarray) -> int:
    """A long that stands for a set; equal sets have the same."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def parity_bitmap(own: np.ndarray) -> np.ndarray:
    """Bytes of a bitmap of as many bits as shingles at least, a power of two; a bit tells if an odd number of them falls on it."""
    bits = 1 << max(6, (len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def least_difference(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound, from their bitmaps, of the shingles in one of two sets only."""
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


#: Texts that a task looks at together.
_TEXTS = 512


def _slices(piece: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, some at a time."""
    for at in range(0, piece.num_rows, _TEXTS):
        yield at, piece.column(column).slice(at, _TEXTS).to_pylist()


def _new_sets(texts: list[str | None], words: int, known: dict[tuple[int, int], int], seen: set[int]) -> Iterator[tuple[int, np.ndarray | None]]:
    """The digest of each text's set, and the set where the task sees it first; copies of a text aren't cut again."""
    for text in texts:
        text = text or ""
        same = (hash(text), len(text))
        fp = known.get(same)
        if fp is None:
            own = shingle_set(text, words)
            fp = known[same] = set_digest(own)
            if len(own) and fp not in seen:
                seen.add(fp)
                yield fp, own
                continue
        yield fp, None


def prefix_size(n: int, least: Fraction) -> int:
    """How many of the first shingles of a set of ``n`` a similar set must meet."""
    return n + 1 - -(-least.numerator * n // least.denominator)


def _described(words: int, least: Fraction, frequent):
    """Ids with the digests of their sets; the first of each in a task also has size, bitmap, fingerprint and prefix."""

    def prefix(own: np.ndarray) -> np.ndarray:
        known, rank = frequent.value  # sorted shingles and how frequent each is
        often = np.zeros(len(own), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            often = np.where(known[at] == own, rank[at], 0)
        return own[np.argsort(often, kind="stable")[: prefix_size(len(own), least)]].view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = {}, set()
        for piece in batches:
            for at, texts in _slices(piece, 2):
                rows = []
                for fp, own in _new_sets(texts, words, known, seen):
                    if own is None:
                        rows.append((fp, None, None, None, None))
                    else:
                        bits = int(np.uint64(fingerprint_of(own)).view(np.int64))
                        rows.append((fp, len(own), parity_bitmap(own).tobytes(), bits, prefix(own)))
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
                columns = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                ids = [c.slice(at, len(texts)) for c in piece.columns[:2]]
                yield pa.RecordBatch.from_arrays([*ids, *columns], names=["id", "key", "fp", "size", "bitmap", "print", "prefix"])

    return run


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The sets of a task's texts with their digests, each once, some at a time."""
    known, seen = {}, set()
    for piece in batches:
        for _, texts in _slices(piece, piece.num_columns - 1):
            held, size = [], 0
            for fp, own in _new_sets(texts, words, known, seen):
                if own is not None:
                    held.append((fp, own))
                    size += len(own)
                if size > 1 << 20:
                    yield held
                    held, size = [], 0
            if held:
                yield held


def _all_tokens(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([s for _, s in held]).view(np.int64))], names=["token"])

    return run


def _possible(size, place, other_size, other_place, least: Fraction) -> np.ndarray:
    """Whether sets whose first common shingle has these places can be similar, by their sizes."""
    most = np.minimum(size - place, other_size - other_place).astype(np.int64)
    return most * (least.numerator + least.denominator) >= least.numerator * (size.astype(np.int64) + other_size)


def _meetings(least: Fraction):
    """A function over rows ordered by shingle, size and set: those of shingles in two sets or more, with the set before if the two can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, met = [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32)], False  # the last row, and whether it goes on a shingle
        before, possible = 0, False

        def emit(columns, keep, before, possible) -> pa.RecordBatch:
            out = [pa.array(c[keep]) for c in columns]
            return pa.RecordBatch.from_arrays([*out, pa.array(before[keep], mask=~possible[keep])], schema=_MET)

        for piece in batches:
            own = [np.concatenate((r, c.to_numpy(zero_copy_only=False))) for r, c in zip(rest, piece.columns, strict=True)]
            new = np.concatenate(([True], (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])))
            own = [c[new] for c in own]
            token, fp, size, place = own
            if not len(token):
                continue
            same = token[1:] == token[:-1]
            can = np.concatenate(([possible], same & _possible(size[:-1], place[:-1], size[1:], place[1:], least)))
            earlier = np.concatenate(([before], fp[:-1]))
            again = np.concatenate(([met], same))
            keep = again.copy()
            keep[:-1] |= same
            keep[-1] = False  # told by the next batch
            if keep.any():
                yield emit(own, keep, earlier, can)
            rest, met, before, possible = [c[-1:] for c in own], bool(again[-1]), int(earlier[-1]), bool(can[-1])
        if len(rest[0]) and met:
            yield emit(rest, np.array([True]), np.array([before]), np.array([possible]))

    return run


def most_difference(size: np.ndarray, other: np.ndarray, least: Fraction) -> np.ndarray:
    """How many shingles similar sets of these sizes have that are in one of them only, at most."""
    both = size.astype(np.int64) + other
    return both - 2 * -(-least.numerator * both // (least.numerator + least.denominator))


class _Bitmaps:
    """Bitmaps of some sets, compared pair by pair; of two sizes the larger one is folded."""

    def __init__(self, held: np.ndarray) -> None:
        self.held, self.size = held, np.array([len(b) for b in held], np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}

    def _of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.rows:
            own, twice = np.flatnonzero(self.size == n), np.flatnonzero(self.size == 2 * n)
            read = lambda which, k: np.frombuffer(b"".join(self.held[which]), np.uint64).reshape(len(which), k // 8)
            folded = read(twice, 2 * n)
            self.rows[n] = np.concatenate([read(own, n), folded[:, : n // 8] ^ folded[:, n // 8 :]])
            self.place[n] = np.full(len(self.held), -1, np.int64)
            self.place[n][np.concatenate([own, twice])] = np.arange(len(own) + len(twice))
        return self.rows[n], self.place[n]

    def difference(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """A lower bound of the differing shingles for pairs of positions; none for sizes too far apart."""
        small, out = np.minimum(self.size[x], self.size[y]), np.zeros(len(x), np.int64)
        for n in np.unique(small).tolist():
            own = np.flatnonzero((small == n) & (np.maximum(self.size[x], self.size[y]) <= 2 * n))
            rows, place = self._of(n)
            step = max(1, (1 << 22) // n)
            for at in range(0, len(own), step):
                part = own[at : at + step]
                out[part] = np.bitwise_count(rows[place[x[part]]] ^ rows[place[y[part]]]).sum(axis=1, dtype=np.int64)
        return out


def _across(least: Fraction, best_only: bool):
    """A function over rows ordered by shingle, size and set: pairs ``(a, b)`` of sets of different components that bitmaps don't rule out.

    ``best_only``: of each set and shingle the pair with the smallest difference.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("far", pa.int64())])

    def closest(found: list) -> list:
        """Of (row, difference, other row) the first with the smallest difference for each row."""
        row, far, other = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((other, far, row))
        first = order[np.flatnonzero(np.concatenate(([True], np.diff(row[order]) != 0)))] if len(order) else order
        return [(row[first], far[first], other[first])]

    def pairs(columns) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        token, fp, size, place, component, held = columns
        maps, best, x, d = _Bitmaps(held), [], np.arange(len(token)), 1
        while True:
            # rows d apart in the order of shingle and size, as long as the larger set isn't too large
            x = x[x + d < len(token)]
            x = x[(token[x] == token[x + d]) & (size[x + d].astype(np.int64) * least.numerator <= size[x].astype(np.int64) * least.denominator)]
            if not len(x):
                break
            y = x + d
            can = (component[x] != component[y]) & _possible(size[x], place[x], size[y], place[y], least)
            a, b = x[can], y[can]
            far = maps.difference(a, b)
            good = far <= most_difference(size[a], size[b], least)
            a, b, far = a[good], b[good], far[good]
            if best_only and len(a):
                best += [(a, far, b), (b, far, a)]
                if sum(len(r) for r, *_ in best) > 1 << 20:
                    best = closest(best)
            elif len(a):
                yield fp[a], fp[b], far
            d += 1
        if best:
            row, far, other = closest(best)[0]
            yield fp[row], fp[other], far

    def emitted(columns) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for found in pairs(columns):
            held.append(found)
            n += len(found[0])
            if n > 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)
                held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for piece in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in piece.columns]
            held = own if held is None else [np.concatenate(c) for c in zip(held, own, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last shingle may go on in the next batch
            if last:
                yield from emitted([c[:last] for c in held])
                held = [c[last:] for c in held]
        if held is not None:
            yield from emitted(held)

    return run


def _verified(least: Fraction):
    """A function over ``a, b`` and the bytes of their sets: the pairs that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            good = []
            for x, y in zip(piece.column(2), piece.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both * least.denominator >= least.numerator * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in piece.columns[:2]], names=["a", "b"])

    return run


def _set_bytes(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _sets(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array([fp for fp, _ in held], pa.int64()), pa.array([s.tobytes() for _, s in held], pa.binary())], names=["fp", "members"])

    return run


def _differences(least: Fraction):
    """A function over ``a, b``, the sizes and the bitmaps of their sets: the pairs that may be similar, with the lower bound of their difference."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in batches:
            n, m = (piece.column(i).to_numpy() for i in (2, 3))
            maps = [np.frombuffer(v.as_buffer(), np.uint8) for i in (4, 5) for v in piece.column(i)]
            far = np.array([least_difference(x, y) for x, y in zip(maps[: len(n)], maps[len(n) :], strict=True)], np.int64)
            good = pa.array(far <= most_difference(n, m, least))
            yield pa.RecordBatch.from_arrays([c.filter(good) for c in (*piece.columns[:2], pa.array(far))], names=["a", "b", "far"])

    return run


def _similar(pairs: DataFrame, maps: DataFrame, texts: DataFrame, words: int, least: Fraction) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar, from ``maps(fp, key)`` and ``texts(key, text)``."""
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct()
    # a text of each set is known by a hash that needs no cutting into shingles
    keys = durable(maps.select("fp", "key").join(needed, "fp", "left_semi").select("key"))
    few = keys.count() <= MOST_BROADCAST
    own = texts.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("text")
    sets = durable(own.mapInArrow(_set_bytes(words), "fp long, members binary").dropDuplicates(["fp"]))
    forget(sets.sparkSession)
    left, right = sets.select(F.col("fp").alias("a"), F.col("members").alias("x")), sets.select(F.col("fp").alias("b"), F.col("members").alias("y"))
    return durable(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verified(least), "a long, b long"))


def fuzzy_pairs(maps: DataFrame) -> DataFrame:
    """Candidate pairs ``(a, b)`` of sets whose fingerprints are three bits or fewer apart, for ``maps(fp, print)``.

    Sets of one fingerprint are paired with the smallest of them, and the smallest
    sets of fingerprints that share a fuzzy key with each other.
    """
    own = durable(maps.groupBy(F.col("print").alias("fp")).agg(F.min("fp").alias("least")))
    least = lambda c: own.select(F.col("fp").alias(c), F.col("least").alias(f"set_{c}"))
    same = maps.join(least("print"), "print").filter("fp <> set_print").select(F.col("set_print").alias("a"), F.col("fp").alias("b"))
    near = links(own).join(least("a"), "a").join(least("b"), "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    return same.unionByName(near)


def frequent_shingles(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a sample of the texts have, sorted, and how many; they come last in the order of all shingles."""
    sample = texts.filter(F.pmod("key", F.lit(SAMPLED)) == 0).select("text")
    counts = sample.mapInArrow(_all_tokens(words), "token long").groupBy("token").count().filter(F.col("count") >= FREQUENT)
    often = counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).toArrow()
    known, rank = often.column("token").to_numpy().view(np.uint64), often.column("count").to_numpy()
    order = np.argsort(known)
    return known[order], rank[order]


def _closest(pairs: DataFrame) -> DataFrame:
    """Of ``pairs(a, b, far)`` the one with the smallest difference for each set."""
    either = pairs.select("a", "b", "far").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "far"))
    best = either.groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def component_tasks(found: DataFrame) -> int:
    """Tasks for the components of some links: a partition is worth its files from so many links on."""
    return max(1, -(-found.count() // LINKS_IN_TASK))


#: Links of a task that looks for components.
LINKS_IN_TASK = 50_000
#: Times that sets are compared with the closest ones of other components before all that are left are.
CLOSEST_ROUNDS = 1


def similar_links(described: DataFrame, maps: DataFrame, texts: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Links ``(a, b)`` that connect all shingle sets of at least the similarity, from what ``similar_documents`` knows of them.

    Sets are compared as a whole only if they aren't connected yet: first each
    with the closest of those that fuzzy hashing and some shared shingles put
    beside it, then with the closest of other components under each shared
    shingle, and at last with all of other components that meet it and that
    bitmaps don't rule out. A large group of copies is thereby connected by about
    as many comparisons as it has sets.
    """
    least = Fraction(str(similarity))
    ordered = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    keyed = described.filter("size IS NOT NULL").select(F.posexplode("prefix").alias("place", "token"), "fp", "size").select("token", "fp", "size", "place")
    met = durable(keyed.repartition("token").sortWithinPartitions("token", "size", "fp").mapInArrow(_meetings(least), "token long, fp long, size int, place int, before long"))

    forget(met.sparkSession)
    beside = met.filter("before IS NOT NULL").groupBy("fp").agg(F.array(*[F.min_by("before", F.xxhash64("token", F.lit(i))) for i in range(2)]).alias("others"))
    close = beside.select(F.explode("others").alias("a"), F.col("fp").alias("b")).unionByName(fuzzy_pairs(maps)).select(*ordered("a", "b")).distinct()
    left, right = (maps.select(F.col("fp").alias(k), F.col("size").alias(f"size_{k}"), F.col("bitmap").alias(f"bitmap_{k}")) for k in "ab")
    known = close.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "bitmap_a", "bitmap_b")
    maybe = known.mapInArrow(_differences(least), "a long, b long, far long")
    tried = durable(_closest(maybe))
    found = _similar(tried, maps, texts, words, least)

    rows = met.select("token", "fp", "size", "place")
    for nth in range(CLOSEST_ROUNDS + 1):
        members = durable(connected_components(found, tasks=component_tasks(found)))
        named = rows.join(members, rows["fp"] == members["node"], "left").select("token", "fp", "size", "place", F.coalesce("component", "fp").alias("component"))
        group = Window.partitionBy("token")
        rows = durable(named.withColumns({"low": F.min("component").over(group), "high": F.max("component").over(group)}).filter("low < high").select("token", "fp", "size", "place", "component"))
        del named
        forget(rows.sparkSession)
        with_maps = rows.join(maps.select("fp", "bitmap"), "fp").select("token", "fp", "size", "place", "component", "bitmap")
        last = nth == CLOSEST_ROUNDS
        met_again = with_maps.repartition("token").sortWithinPartitions("token", "size", "fp").mapInArrow(_across(least, not last), "a long, b long, far long")
        more = met_again.select(*ordered("a", "b"), "far").distinct().join(tried, ["a", "b"], "left_anti")
        more = more.select("a", "b") if last else _closest(more)
        more, rows = durable(more), rows.select("token", "fp", "size", "place")
        if not more.isEmpty():
            tried, found = tried.unionByName(more), found.unionByName(_similar(more, maps, texts, words, least))
    return found


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """``id, component_id`` for every row of ``docs``: the smallest id that a document reaches by links, its own included.

    Texts without words are alike; one of fewer words than a shingle is a single
    one. Repeated and missing ids are treated as in ``simhash.near_duplicates``.

    A sample of the texts only settles the order of shingles: any order finds all
    links. Then texts are cut into shingles once, and once more those of sets that
    must be compared as a whole.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, words))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, key long, fp long, size int, bitmap binary, print long, prefix array<long>"
    described = durable(texts.mapInArrow(_described(words, Fraction(str(similarity)), frequent), schema))
    rows = described.select("id", "fp")
    maps = durable(described.filter("size IS NOT NULL").select("fp", "key", "size", "bitmap", "print").dropDuplicates(["fp"]))
    classes = durable(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    forget(docs.sparkSession)
    found = similar_links(described, maps, texts.select("key", "text"), words=words, similarity=similarity)
    return with_components(rows, classes, found, component_tasks(found)).select(F.col("id").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id; rows without an id stay."""
    return keep_least(docs, similar_documents(docs, id_col=id_col, text_col=text_col), id_col, text_col)
