"""Phrases that occur together more often than their parts suggest.

Words are 64-bit codes, hashed from language and word, so that phrases of different
languages never meet. One pass over the texts writes blocks of codes; the other passes read
those only:

1. Each level from 2 words up counts its phrases by a 64-bit hash, over the places where
   both phrases of one word less may be frequent (bitmaps of fixed size say so), and
   keeps the hashes that reach the least count. No frequent phrase is lost.
2. Each kept hash is given to one of the blocks that hold it, drawn at random, which spells out its phrase. These
   candidates, with all their parts, are dealt to tries by their first two words.
   Each trie is a double array, built on the driver and broadcast.
3. Numpy moves the states of all places of a text block through a trie together, one level
   after another, and bincounts the accepting states; a task sums its blocks, Spark the tasks. Where
   the exact counts of a hash don't add up to its count, two phrases share it, and all is hashed anew by another seed.

Scores, the phrases inside longer ones and the ranks are joins over the counted phrases.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm._shared import discarded, durable, written

#: Bytes of text whose words make one block of codes; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: log2 of the bits of a level's bitmap (4 MB).
BUCKET_BITS = 25
#: Phrases of one trie, about.
MOST_IN_TRIE = 1 << 18
#: Codes a task remembers to have told the words of; the memory is emptied beyond that.
REMEMBERED = 300_000
#: Seeds tried until no two words share a code and no two phrases a hash.
SEEDS = range(8)

#: All bytes that end a piece become a full stop, which then stands in no word; letters go lower, tabs become spaces.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"." * 9)
#: Bits of a block's number: half for its task, half for its place among the task's blocks.
_BLOCK_BITS = 42
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text in order, a full stop wherever a piece ends."""
    return (text or "").encode("utf-8", "replace").translate(_FOLD).replace(b".", b" . ").split()


# --- codes ------------------------------------------------------------------

#: Numbers and codes are packed: little-endian codes of 64 bits, numbers of 16 bits if there are codes for no more, of 32 otherwise.
CODES = "block long, ids binary, codes binary, new_codes array<long>, new_langs array<string>, new_words array<string>"


def _number_kind(n_codes: int) -> str:
    return "<u2" if n_codes <= 1 << 16 else "<u4"


class _Coder:
    """Numbers the words of a block of texts, and tells which codes are new to the task."""

    def __init__(self, seed: int) -> None:
        self.seed, self.told = seed, set()

    def block(self, texts: Iterator[tuple[str, str | None]]) -> tuple:
        """Word numbers (0 between pieces), the code of each number, and the words whose codes weren't told before."""
        if len(self.told) > REMEMBERED:
            self.told = set()
        numbers: dict[str, dict[bytes, int]] = {}
        ids, codes, fresh = array("i"), [0], []
        for lang, text in texts:
            words = words_of(text)
            of = numbers.setdefault(lang, {b".": 0})
            for w in [w for w in {*words} if w not in of]:
                of[w] = len(codes)
                code = xxhash.xxh64_intdigest(lang.encode() + b"\0" + w, self.seed) or 1
                codes.append(code)
                if code not in self.told:
                    self.told.add(code)
                    fresh.append((code, lang, w))
            ids.extend(map(of.__getitem__, words))
            ids.append(0)
        return np.frombuffer(ids, np.int32).astype(_number_kind(len(codes))), np.array(codes, np.uint64), fresh


def encoded(docs: DataFrame, seed: int, *, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Blocks of texts as numbers of words, the code of each number, and the words behind codes new to the task."""
    lists = {"new_codes": pa.int64(), "new_langs": pa.string(), "new_words": pa.string()}

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, made = _Coder(seed), TaskContext.get().partitionId(), itertools.count()

        def row(texts: list) -> pa.RecordBatch:
            ids, codes, fresh = coder.block(texts)
            new = np.array([c for c, _, _ in fresh], np.uint64).view(np.int64)
            held = (new, [lang for _, lang, _ in fresh], [w.decode("utf-8", "replace") for _, _, w in fresh])
            flat = [pa.array(x, kind) for x, kind in zip(held, lists.values(), strict=True)]
            packed = {"block": pa.array([part << _BLOCK_BITS // 2 | next(made)], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "codes": pa.array([codes.tobytes()], pa.binary())}
            return pa.RecordBatch.from_pydict(packed | {name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for name, x in zip(lists, flat, strict=True)})

        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # few texts at once become Python strings
                some = batch.slice(at, 64)
                for lang, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    held.append((lang, text))
                    size += len(text or "")
                    if size >= BLOCK_BYTES:
                        yield row(held)
                        held, size = [], 0
        if held:
            yield row(held)

    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    return docs.select(lang.alias("lang"), F.col(text_col).alias("text")).mapInArrow(encode, CODES)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Word numbers, codes and the values of further columns of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            packed, codes = (batch.column(c)[i].as_buffer() for c in (0, 1))
            codes = np.frombuffer(codes, "<u8")
            yield [np.frombuffer(packed, _number_kind(len(codes))), codes, *(column[i] for column in batch.columns[2:])]


def _of_blocks(work, schema: str, *more: str):
    """``mapInArrow`` over blocks: ``work`` takes word numbers, codes and the values of ``more`` columns and gives columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _unpacked(batches):
            yield pa.RecordBatch.from_pydict(work(*block))

    return lambda blocks: blocks.select("ids", "codes", *more).mapInArrow(run, schema)


def code_counts(blocks: DataFrame) -> DataFrame:
    """``code, count`` of all words."""

    def count(ids: np.ndarray, codes: np.ndarray) -> dict:
        return {"code": codes[1:].view(np.int64), "n": np.bincount(ids, minlength=len(codes))[1:]}

    return _of_blocks(count, "code long, n long")(blocks).groupBy("code").agg(F.sum("n").alias("count"))


# --- candidates -------------------------------------------------------------


def hashed(codes: np.ndarray, k: int, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the ``k`` codes from each place on."""
    h = np.full(len(at), k + 16 * seed, np.uint64)
    for d in range(k):
        h ^= codes[at + d]
        h *= _STEP
        h ^= h >> np.uint64(29)
    return h


def may_be_frequent(codes: np.ndarray, bitmaps: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """Places whose phrase of ``len(bitmaps)`` words, with all its parts, is in the bitmaps. Code 0 ends a piece."""
    places = np.flatnonzero(codes)
    for k, bits in enumerate(bitmaps, 1):
        if k > 1:
            places = places[:-1][np.diff(places) == 1]
        at = hashed(codes, k, places, seed) >> np.uint64(64 - ((8 * len(bits)).bit_length() - 1))
        places = places[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return places


def _bitmap(kept: DataFrame, bucket_bits: int) -> np.ndarray:
    """Bits of the buckets of the kept hashes, by their leading bits; the driver gets one row for each 32,768 bits at most."""
    bucket = kept.select((F.shiftrightunsigned("hash", 64 - bucket_bits) + 1).alias("bucket"))
    parts = bucket.groupBy(F.expr("bitmap_bucket_number(bucket)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bucket))").alias("bits")).collect()
    bits = np.zeros(1 << (bucket_bits - 3), np.uint8)
    for r in parts:  # Spark's buckets begin with 1 at bit 0
        held = np.frombuffer(r["bits"], np.uint8)
        bits[(r["part"] - 1) * 4096 : (r["part"] - 1) * 4096 + len(held)] = held
    return bits


def _word_hashes(words: DataFrame, seed: int) -> DataFrame:
    """Hashes of single words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_pydict({"hash": hashed(codes, 1, np.arange(len(codes)), seed).view(np.int64)})

    return words.select("code").mapInArrow(work, "hash long")


def _kept(blocks: DataFrame, shared: list, k: int, least: int, seed: int) -> DataFrame:
    """``hash, n, block`` of the hashes of ``k`` words that occur ``least`` times: the block is one of those that hold it, drawn by a hash."""

    def count(ids: np.ndarray, codes: np.ndarray, block) -> dict:
        text = codes[ids]
        places = may_be_frequent(text, [b.value for b in shared], seed)
        places = places[:-1][np.diff(places) == 1]
        found, n = np.unique(hashed(text, k, places, seed), return_counts=True)
        return {"hash": found.view(np.int64), "n": n, "block": np.full(len(found), block.as_py(), np.int64)}

    counts = _of_blocks(count, "hash long, n long, block long", "block")(blocks)
    drawn = F.shiftleft(F.pmod(F.xxhash64("hash", "block"), F.lit(1 << 20)), _BLOCK_BITS).bitwiseOR(F.col("block"))
    kept = counts.groupBy("hash").agg(F.sum("n").alias("n"), F.min(drawn).alias("drawn")).filter(F.col("n") >= least)
    return kept.select("hash", "n", F.col("drawn").bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1)).alias("block"))


def phrases_of_hashes(text: np.ndarray, most: int, own: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of 2 to ``most`` codes in a text whose hash is among ``own``, and these hashes: rows of codes, 0 behind the last.

    All different phrases of a hash are there.
    """
    rows, hashes = [], []
    places, own = np.flatnonzero(text), np.sort(own)
    for k in range(2, most + 1):
        places = places[:-1][np.diff(places) == 1]
        if not len(places) or not len(own):
            break
        key = hashed(text, k, places, seed)
        wanted = own[np.minimum(np.searchsorted(own, key), len(own) - 1)] == key
        out = np.zeros((int(wanted.sum()), most), np.int64)
        for d in range(k):
            out[:, d] = text[places[wanted] + d].view(np.int64)
        out, first = np.unique(out, axis=0, return_index=True)
        rows.append(out)
        hashes.append(key[wanted][first])
    return (np.concatenate(rows), np.concatenate(hashes)) if rows else (np.zeros((0, most), np.int64), np.zeros(0, np.uint64))


def _candidates(blocks: DataFrame, kept: DataFrame, most: int, seed: int) -> DataFrame:
    """``hash, c1, c2, ...``: the phrase of each kept hash, spelled out by the block it was given to; 0 behind the last word."""

    def find(ids: np.ndarray, codes: np.ndarray, own) -> dict:
        rows, hashes = phrases_of_hashes(codes[ids], most, own.values.to_numpy().view(np.uint64), seed)
        return {"hash": hashes.view(np.int64)} | {f"c{d + 1}": np.ascontiguousarray(rows[:, d]) for d in range(most)}

    given = kept.groupBy("block").agg(F.collect_list("hash").alias("own"))  # no more than the block's own phrases
    return _of_blocks(find, "hash long, " + ", ".join(f"c{d + 1} long" for d in range(most)), "own")(blocks.join(given, "block"))


# --- tries ------------------------------------------------------------------


class Trie:
    """A double array over phrases of word codes: ``base[state] + symbol`` is the next state if its ``check`` is the state.

    State 0 is the root; ``symbols`` holds the codes in order, a word's symbol is its place there.
    """

    def __init__(self, phrases: np.ndarray) -> None:
        """``phrases``: rows of codes, 0 behind the last word."""
        self.symbols = np.unique(phrases[phrases != 0])
        n, depth = phrases.shape
        sym = np.where(phrases == 0, -1, np.searchsorted(self.symbols, phrases)).astype(np.int64)
        room = 2 * (n * depth + len(self.symbols)) + 16
        self.check, self.base = np.full(room, -1, np.int32), np.zeros(room, np.int32)
        state = np.zeros(n, np.int64)
        free_from = 1
        for d in range(depth):
            here = np.flatnonzero(sym[:, d] >= 0)
            edges, edge_of = np.unique(state[here] * len(self.symbols) + sym[here, d], return_inverse=True)
            parents, symbols = np.divmod(edges, max(1, len(self.symbols)))
            if d == 0:
                self.base[0] = 1
            else:
                self._place(parents, symbols, free_from)
            slots = self.base[parents] + symbols
            self.check[slots] = parents
            while free_from < room and self.check[free_from] >= 0:
                free_from += 1
            state[here] = slots[edge_of]
        #: The state that accepts each phrase.
        self.accepting = state
        last = int(np.flatnonzero(self.check >= 0).max(initial=0)) + len(self.symbols) + 1
        self.check, self.base = np.append(self.check, np.full(last, -1, np.int32))[:last], np.append(self.base, np.zeros(last, np.int32))[:last]

    def _place(self, parents: np.ndarray, symbols: np.ndarray, free_from: int) -> None:
        """A base for each parent such that its children's slots are free; those with most children first."""
        if not len(parents):
            return
        begins = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
        sizes = np.diff(np.append(begins, len(parents)))
        from_here: dict[int, int] = {}  # by order of size, where the last search ended
        for i in np.argsort(-sizes, kind="stable").tolist():
            mine = symbols[begins[i] : begins[i] + sizes[i]]
            if sizes[i] == 1:
                break
            order = int(sizes[i]).bit_length()
            start, width = from_here.get(order, free_from), 64
            while True:
                free = start + np.flatnonzero(self.check[start : start + width] == -1)
                self._room(int(free.max(initial=start)) + int(mine[-1] - mine[0]) + width + 2)
                fits = np.flatnonzero((self.check[free[:, None] + (mine - mine[0])] == -1).all(axis=1)) if len(free) else free
                if len(fits):
                    base = int(free[fits[0]]) - int(mine[0])
                    break
                start, width = start + width, min(2 * width, max(64, (1 << 20) // len(mine)))
                self._room(start + width)
            from_here[order] = start
            self.base[parents[begins[i]]] = base
            self.check[base + mine] = parents[begins[i]]
        alone = np.flatnonzero(sizes == 1)
        if len(alone):
            self._room(len(self.check) + len(alone))
            free = free_from + np.flatnonzero(self.check[free_from:] == -1)[: len(alone)]
            self.base[parents[begins[alone]]] = free - symbols[begins[alone]]
            self.check[free] = parents[begins[alone]]

    def _room(self, most: int) -> None:
        if most >= len(self.check):
            more = most + len(self.check) // 2 - len(self.check) + 1
            self.check, self.base = np.append(self.check, np.full(more, -1, np.int32)), np.append(self.base, np.zeros(more, np.int32))

    def count(self, ids: np.ndarray, codes: np.ndarray, depth: int) -> np.ndarray:
        """How often each state is reached from any place of a text, by phrases of 2 to ``depth`` words."""
        signed = codes.view(np.int64)
        at = np.minimum(np.searchsorted(self.symbols, signed), len(self.symbols) - 1)
        symbol = np.where(self.symbols[at] == signed, at, -1)
        symbol[0] = -1  # ends of pieces
        text = symbol[ids]
        places = np.flatnonzero(text >= 0)
        state = np.zeros(len(places), np.int64)
        counts = np.zeros(len(self.check), np.int64)
        for d in range(depth):
            step = text[places + d]  # texts end with an end of a piece, so no place runs out
            known = step >= 0
            places, state, step = places[known], state[known], step[known]
            slot = self.base[state] + step
            slot[(slot < 0) | (slot >= len(self.check))] = 0
            moved = self.check[slot] == state
            places, state = places[moved], slot[moved]
            if d:
                counts += np.bincount(state, minlength=len(counts))
        return counts


def _state_counts(blocks: DataFrame, shared, depth: int) -> DataFrame:
    """``state, n`` of a broadcast trie: a task adds up all its blocks before it gives a row for each state it has met.

    There is at most a task for each core, so that the rows follow the states, not states times blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        counts = np.zeros(len(trie.check), np.int64)
        for ids, codes in _unpacked(batches):
            counts += trie.count(ids, codes, depth)
        states = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"state": states, "n": counts[states]})

    cores = blocks.sparkSession.sparkContext.defaultParallelism
    return blocks.select("ids", "codes").coalesce(cores).mapInArrow(run, "state long, n long")


def _trie_counts(blocks: DataFrame, candidates: DataFrame, n_candidates: int, columns: list[str]) -> DataFrame:
    """The candidates with their exact ``count``, one trie after another."""
    spark, out = blocks.sparkSession, None
    tries = -(-n_candidates // MOST_IN_TRIE)
    dealt = candidates.withColumn("trie", F.pmod(F.xxhash64("c1", "c2"), F.lit(tries)))
    if tries > 1:
        dealt = durable(dealt.repartition("trie"))
    for t in range(tries):
        rows = dealt.filter(F.col("trie") == t).select("hash", *columns).toArrow()
        phrases = np.stack([rows.column(c).to_numpy() for c in columns], axis=1)
        if not len(phrases):
            continue
        trie = Trie(phrases)
        shared = spark.sparkContext.broadcast(trie)
        named = spark.createDataFrame(pa.table([rows.column(c) for c in ("hash", *columns)] + [pa.array(trie.accepting)], names=["hash", *columns, "state"]))
        summed = durable(_state_counts(blocks, shared, len(columns)).groupBy("state").agg(F.sum("n").alias("count")).join(named, "state").select("hash", *columns, "count"))
        shared.unpersist()
        out = summed if out is None else out.union(summed)
    return out


# --- scores -----------------------------------------------------------------


def counted_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most_words: int = 5, least: int = 100, bucket_bits: int = BUCKET_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts: ``phrase, count`` (arrays of codes, from 2 words), ``code, lang, word, count`` of frequent words, and ``lang, n``."""
    spark = docs.sparkSession
    for seed in SEEDS:
        blocks, path = written(encoded(docs, seed, text_col=text_col, lang_col=lang_col), "phrases")
        counts = durable(code_counts(blocks))
        named = blocks.select(F.explode(F.arrays_zip("new_codes", "new_langs", "new_words")).alias("new"))
        named = named.select(F.col("new.new_codes").alias("code"), F.struct(F.col("new.new_langs").alias("lang"), F.col("new.new_words").alias("word")).alias("name")).groupBy("code")
        words = durable(named.agg(F.min("name").alias("one"), F.max("name").alias("other")).join(counts, "code"))
        if words.filter(F.col("one") != F.col("other")).isEmpty():
            break
        discarded(spark, path)
    else:
        raise ValueError("two words share a code under every seed")
    words = words.select("code", "one.lang", "one.word", "count")
    totals = words.groupBy("lang").agg(F.sum("count").alias("n"))
    frequent = words.filter(F.col("count") >= least)
    columns = [f"c{d + 1}" for d in range(most_words)]
    for seed in SEEDS:
        shared = [spark.sparkContext.broadcast(_bitmap(_word_hashes(frequent, seed), bucket_bits))]
        kept = None
        for k in range(2, most_words + 1):
            level = durable(_kept(blocks, shared, k, least, seed))
            kept = level if kept is None else kept.union(level)
            shared.append(spark.sparkContext.broadcast(_bitmap(level, bucket_bits)))
        for b in shared:
            b.unpersist()
        candidates = durable(_candidates(blocks, kept, most_words, seed))
        found = _trie_counts(blocks, candidates, candidates.count(), columns)
        if found is None:
            found = candidates.withColumn("count", F.lit(0).cast("long"))
        summed = found.groupBy("hash").agg(F.sum("count").alias("count"))
        if summed.join(kept, "hash", "full").filter(~F.col("count").eqNullSafe(F.col("n"))).isEmpty():
            break
    else:
        raise ValueError("two phrases share a hash under every seed")
    discarded(spark, path)
    phrases = found.filter(F.col("count") >= least).select(F.filter(F.array(*columns), lambda c: c != 0).alias("phrase"), "count")
    return phrases, frequent, totals


def collocations(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", most_words: int = 5, least: int = 100, inside_percent: int = 100, best: int = 2000, bucket_bits: int = BUCKET_BITS,
) -> DataFrame:
    """The ``best`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Letters A-Z go lower; pieces end at ``[.,;:!?]`` and line ends, words are parted by spaces and tabs. Per
    language (null: ``und``) ``n`` is the number of words and ``a`` how often a phrase of 2 to
    ``most_words`` words occurs inside pieces, ``least`` times or more. The cut into two parts that occur ``l``
    and ``r`` times has the score ``floor(1000 * a * n / (l * r))``; the lowest counts, the shortest
    first part of equal ones. A phrase inside a longer counted one with at least
    ``inside_percent`` of its count is left out. Order: score, then ``a``, both descending, then the phrase.

    Null and empty texts have no words; repeated rows count each; an empty table gives an
    empty result. Whole texts are read, however long; other columns, whatever
    their names, aren't looked at. Ids play no part. ``bucket_bits`` sets the size of the bitmaps
    (15 at least); the result doesn't depend on it.
    """
    phrases, words, totals = counted_phrases(docs, text_col=text_col, lang_col=lang_col, most_words=most_words, least=least, bucket_bits=bucket_bits)
    size = F.size("phrase")
    spelled = (
        phrases.select("phrase", F.posexplode("phrase").alias("at", "code")).join(words.select("code", "lang", "word"), "code")
        .groupBy("phrase").agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("text"))
    )
    parts = phrases.unionByName(words.select(F.array("code").alias("phrase"), "count"))
    cuts = phrases.select("phrase", F.col("count").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("phrase", F.lit(1), F.col("k")), "right": F.slice("phrase", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(parts.select(F.col("phrase").alias("left"), F.col("count").alias("l")), "left").join(parts.select(F.col("phrase").alias("right"), F.col("count").alias("r")), "right")
    # the cut with the lowest floor(1000 a n / (l r)) is found after n is known
    listed = cuts.groupBy("phrase").agg(F.first("a").alias("a"), F.array_sort(F.collect_list(F.struct("k", "l", "r"))).alias("cuts"))
    starts = F.sequence(F.lit(1), size - 1)
    inner = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(2), size - i + 1), lambda n: F.slice("phrase", i, n))))
    longer = (
        phrases.filter(size > 2).select(F.col("count").alias("longer"), F.explode(F.filter(inner, lambda p: F.size(p) < size)).alias("phrase"))
        .groupBy("phrase").agg(F.max("longer").alias("longer"))
    )
    kept = listed.join(longer, "phrase", "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * inside_percent))
    whole = lambda c: c.cast("decimal(19,0)")  # noqa: E731  exact: a thousand times two longs has at most 41 digits, and counts are far smaller
    score = lambda c: F.call_function("div", whole(F.lit(1000)) * whole(F.col("a")) * whole(F.col("n")), whole(c["l"]) * whole(c["r"]))
    scored = (
        kept.join(spelled, "phrase").join(totals, "lang")
        .withColumn("cut", F.array_min(F.transform("cuts", lambda c: F.struct(score(c).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))))
        .select("lang", F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(256))).orderBy(*order)
    first = scored.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= best)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
