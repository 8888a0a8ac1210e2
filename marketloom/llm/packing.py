"""Best-fit packing of documents into sequences of one size, planned over a histogram of lengths.

Only the counts of pieces by length pass the driver, at most one row for each
length up to the size of a sequence. The plan packs counts, longest first, each
piece where the least room that fits it is left; pieces of one length that meet
sequences with the same room are placed in one step. A plan is a list of slots: for a
length, from which rank on, which sequences and which offset. Pieces get a rank
within their length and take their slot by joining on it.

Ranks come from chunks: pieces of one length are dealt by a hash over chunks of
about ``CHUNK`` rows, numbered inside, and the chunks' counts are summed up.
"""

from __future__ import annotations

import os
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm._shared import durable, with_columns
from marketloom.llm.mixing import place_in
from marketloom.llm.token_count import PATTERN, byte_letters, default_vocabulary, refuse_other_kinds

#: Tokens of a sequence.
SEQUENCE = 2048
#: Rows that are numbered together, about.
CHUNK = 1000
#: Pre-tokens whose ids a worker remembers at first hand, from one task to the next; beyond that those since the last time it was full.
REMEMBERED = 400_000
#: Characters of texts cut at once: few enough that their pre-tokens stay in a core's cache.
CUT_AT_ONCE = 1 << 16
#: A space before something else than white space begins a pre-token whatever stands before it.
_CUT = re.compile(r" (?=\S)")
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")


@lru_cache(1)
def _latin_pattern() -> re.Pattern:
    """The pre-token pattern for texts of Latin characters: the same with classes written out, which is twice as fast."""
    kinds = {k: "".join(map(re.escape, (chr(c) for c in range(0x250) if unicodedata.category(chr(c))[0] == k))) for k in "LN"}
    letters, numbers, spaces = kinds["L"], kinds["N"], " \t-\r\x85\xa0"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


@lru_cache(1)
def _library(path: str) -> tuple:
    """The vocabulary's library, the bytes of each id and the strings that are tokens of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import json

    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    refuse_other_kinds(held)
    letters = {c: b for b, c in enumerate(byte_letters())}
    size = np.zeros(1 + max([*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"])]), np.int64)
    for token, i in held["model"]["vocab"].items():
        size[i] = sum(c in letters for c in token)
    special = [t["content"] for t in held["added_tokens"]]
    return Tokenizer.from_file(path), size, re.compile("|".join(map(re.escape, special))) if special else None


class TokenIds:
    """Ids of whole texts as the library gives them, as little-endian 32-bit numbers.

    Texts are cut into pre-tokens, and each pre-token that is new goes through the
    library once. Texts with a special string go through the library whole.
    """

    def __init__(self, path: str) -> None:
        self.library, self.size, self.special = _library(path)
        self.pattern, self.latin = regex.compile(PATTERN), _latin_pattern()
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # what was known until the memory was last full

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Ids of new pre-tokens; those that begin with a space many in one text, where the bytes of the ids tell the ends."""
        self.known.update((t, self.before[t]) for t in new if t in self.before)
        joined = [t for t in new if t not in self.known and _CUT.match(t)]
        for at in range(0, len(joined), 2000):
            some = joined[at : at + 2000]
            ids = np.array(self.library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum([len(t.encode("utf-8")) for t in some])
            upto = np.cumsum(self.size[ids])
            cuts = np.searchsorted(upto, ends)
            if (upto[cuts] != ends).any():
                raise ValueError("the vocabulary's tokens don't end where its pre-tokens do")
            raw, begin = ids.tobytes(), 0
            for token, end in zip(some, (4 * (cuts + 1)).tolist(), strict=True):
                self.known[token] = raw[begin:end]
                begin = end
        self.known.update((t, self.whole(t)) for t in new if t not in self.known)

    def pieces(self, text: str) -> list[str]:
        return (self.pattern if _BEYOND_LATIN.search(text) else self.latin).findall(text)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.before = {}, self.known
        known = self.known
        whole = [self.special is not None and self.special.search(t) is not None for t in texts]
        split = [[] if special else self.pieces(t) for t, special in zip(texts, whole, strict=True)]
        new = {t for pieces in split for t in pieces if t not in known}
        if new:
            self.learn(list(new))
        return [self.whole(t) if special else b"".join(map(known.__getitem__, pieces)) for t, special, pieces in zip(texts, whole, split, strict=True)]


@lru_cache(1)
def _encoder(path: str) -> TokenIds:
    """The worker's own, so that a task needn't learn again what those before it on the same worker have met."""
    return TokenIds(path)


def cut_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = 0, path: str | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids`` (little-endian 32-bit numbers).

    A document is its text's ids and then ``end_id``; only one longer than ``sequence`` is cut,
    into pieces of that size of which the first may be shorter. A null text is an
    empty one: a single id.
    """
    file = path or default_vocabulary()
    _library(file)  # an unfit file fails here, not in a task
    end = np.array([end_id], "<u4").tobytes()

    def cut(ids: bytes) -> list[dict]:
        ids += end
        n = len(ids) // 4
        edges = [0, *range((n - 1) % sequence + 1, n + 1, sequence)]
        return [{"start": a, "ids": ids[4 * a : 4 * b]} for a, b in zip(edges, edges[1:], strict=False)]

    @F.pandas_udf("array<struct<start: long, ids: binary>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(file)
        for batch in batches:
            out: list[list[dict]] = []
            held, size = [], 0
            for text in batch:
                held.append(text or "")
                size += len(held[-1])
                if size > CUT_AT_ONCE:
                    out += map(cut, encoder(held))
                    held, size = [], 0
            out += map(cut, encoder(held))
            yield pd.Series(out, dtype=object)

    return (
        docs.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces(F.col(text_col))).alias("piece", "held"))
        .select("doc_id", F.col("piece").cast("int").alias("piece"), F.col("held.start").alias("start"), F.octet_length("held.ids").cast("long").alias("bytes"), F.col("held.ids").alias("ids"))
        .select("doc_id", "piece", "start", F.shiftright("bytes", 2).alias("length"), "ids")
    )


def best_fit_plan(counts: dict[int, int], sequence: int) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Slots by length, and how many sequences there are.

    A slot ``(rank, first, each, offset)`` holds from that rank on until the next
    slot's: sequence ``first`` and those after it take ``each`` pieces one after another from
    ``offset`` on. Pieces go longest first to the sequence with the least room
    that fits, a new one if none has; the steps work on all sequences with the same room.
    """
    rooms: list[int] = []  # rooms left, in order
    groups: dict[int, list[tuple[int, int]]] = {}  # by room: first sequence and how many
    plan: dict[int, list[tuple[int, int, int, int]]] = {}
    made = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, slots = counts[length], 0, plan.setdefault(length, [])
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, first, n = sequence, made, -(-left // (sequence // length))
                made += n
            each = room // length
            full = min(n, left // each)
            some = left - full * each if full < n else 0  # of one more sequence, not filled up
            if full:
                slots.append((rank, first, each, sequence - room))
                put(room - each * length, first, full)
            if some:
                slots.append((rank + full * each, first + full, some, sequence - room))
                put(room - some * length, first + full, 1)
            put(room, first + full + (some > 0), n - full - (some > 0))
            taken = full * each + some
            left, rank = left - taken, rank + taken
    return plan, made


def pack(pieces: DataFrame, *, sequence: int = SEQUENCE, length_col: str = "length") -> DataFrame:
    """All columns of ``pieces`` plus ``sequence_id`` (from 0) and ``offset``.

    ``pieces`` should be narrow; it is written once. Lengths go from 1 to ``sequence``; others, and nulls, raise
    ``ValueError``. Pieces of a sequence stand one after another from offset 0 on. Equal rows take
    slots of their own, in any order. An empty table stays empty. Input columns named like an added one give way.
    """
    spark = pieces.sparkSession
    pieces = durable(pieces)
    by_length = pieces.groupBy(F.col(length_col).alias("length")).count().limit(sequence + 2).collect()  # a row for each length
    counts = {r["length"]: r["count"] for r in by_length}
    if any(n is None or not 1 <= n <= sequence for n in counts):
        raise ValueError(f"lengths must be from 1 to {sequence}")
    slots, _ = best_fit_plan(counts, sequence)
    table = spark.createDataFrame(
        [(n, -(-counts[n] // CHUNK), [list(x) for x in zip(*found, strict=True)]) for n, found in slots.items()], "_n long, _chunks long, _slots array<array<long>>",
    )
    placed = pieces.join(F.broadcast(table.select("_n", "_chunks")), F.col(length_col) == F.col("_n"))
    everything = [F.col(f"`{c}`") for c in pieces.columns]
    placed = placed.withColumn("_hash", F.xxhash64(*everything)).withColumn("_chunk", F.pmod("_hash", F.col("_chunks")))
    before = Window.partitionBy("_n").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = placed.groupBy("_n", "_chunk").agg(F.count("*").alias("_rows")).select("_n", "_chunk", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_n", "_chunk").orderBy("_hash", *everything)
    ranked = (
        placed.withColumn("_number", F.row_number().over(inside)).join(chunks, ["_n", "_chunk"])
        .withColumn("_rank", F.col("_before") + F.col("_number") - 1).join(F.broadcast(table.select("_n", "_slots")), "_n")
        .withColumn("_slot", place_in(F.col("_slots")[0], F.col("_rank")) - 1)
    )
    of = lambda i: F.get(F.col("_slots")[i], F.col("_slot"))
    step = F.col("_rank") - of(0)
    sequence_id = of(1) + F.floor(step / of(2))
    offset = of(3) + F.pmod(step, of(2)) * F.col("_n")
    out = with_columns(ranked, sequence_id=sequence_id, offset=offset)
    return out.select(*[F.col(f"`{c}`") for c in pieces.columns if c.lower() not in ("sequence_id", "offset")], "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end_id: int = 0, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """One row per piece of a document: ``doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset``.

    Texts are cut by ``cut_documents`` and packed by ``pack``. ``keep_ids=False``
    leaves out ``ids``, so that only their checksum is shuffled. Null and empty
    texts are one piece of one id; repeated rows are packed each; rows without
    an id too. Whole texts are read, however long. Other columns aren't carried: join them on the id.
    """
    pieces = cut_documents(docs, id_col=id_col, text_col=text_col, sequence=sequence, end_id=end_id, path=path).withColumn("ids_crc32", F.crc32("ids"))
    return pack(pieces if keep_ids else pieces.drop("ids"), sequence=sequence)
