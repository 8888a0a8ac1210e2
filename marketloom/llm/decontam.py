"""Benchmark decontamination by CGK embeddings and bit-sampling LSH.

The CGK embedding walks over a text: at each step it writes the character it
stands on and moves on or stays, as a shared random table says for that step and
character. Two texts a small edit distance apart are walked alike again soon
after each edit, so that their embeddings have a small Hamming distance. A
repetition of the LSH samples some positions of the embedding; windows that agree
with an item's window there become candidates.

Items are taken by length class, and windows have the size of the class: every
word of an item begins one, and so does every word of a document (and every
character of scripts without spaces). A long item has more windows, not longer
ones, as the walks over a window with many edits soon part for good. Repetitions
are added until, in each class, copies with as many edits as the limit allows are
found with the target recall. Candidates are screened by the edit distance around
the window and verified by exact edit distance against the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm._shared import discarded, durable, written

#: Length classes: bytes from which an item belongs to it, steps of its walks and positions that a key samples.
CLASSES = ((16, 16, 9), (32, 24, 12), (64, 32, 10))
#: Recall that repetitions must reach in each class on probes with as many edits as the limit allows, at random places.
TARGET_RECALL = 0.99
#: And, as a share of that, on probes with edits of one kind at even distances: they leave no clean run for a lucky window.
EVEN_SHARE = 0.92
#: Probes of a class at least; every item is probed.
LEAST_PROBES = 400
#: Repetitions, each with its own walk and positions: at least so many; so many without the target are an error.
LEAST_REPETITIONS, MOST_REPETITIONS = 3, 128
#: Draws of a walk with its positions, of which the first is taken that tells nearly as many windows apart as the best.
DRAWS, NEARLY = 3, 0.99
#: An item is found where the edit distance is at most this share of its length.
MOST_EDITS = 0.2
#: Bytes around a window whose edit distance screens a candidate, the share of them that may differ and how far they may lie aside.
CHUNK, CHUNK_EDITS, CHUNK_SLACK = 64, 0.38, 20
#: Bytes of item texts that are sent to the executors at once; more items go in further passes.
MOST_ITEM_BYTES = 16 << 20
_BASE = np.uint64(0x100000001B3)
_ONE = np.uint64(1)


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def edit_distance_within(pattern: str, text: str) -> tuple[int, int]:
    """The smallest edit distance between ``pattern`` and any substring of ``text``, and where that substring ends.

    Bit-parallel dynamic programming over the rows of the edit table.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m >> 1
    up, down, here = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        same = masks.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        if right & top:
            here += 1
        elif left & top:
            here -= 1
        right, left = right << 1 & full, left << 1 & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
        if here < best:
            best, end = here, j
    return best, end


@dataclass(frozen=True)
class Repetition:
    moves: np.ndarray  # (steps, 256): whether a walk moves on
    samples: np.ndarray  # sampled steps
    prefixes: tuple[tuple[int, np.ndarray], ...]  # after so many samples: packed bitmap of the windows' hashes
    keys: np.ndarray  # sorted hashes of all samples
    owner: np.ndarray  # of each key: position in the table of windows


@dataclass(frozen=True)
class LengthClass:
    """The windows of items of one length class with their keys."""

    window_item: np.ndarray
    window_offset: np.ndarray
    repetitions: tuple[Repetition, ...]
    recall: tuple[float, ...]  # on the probes: edits at random places; deletions, substitutions, doublings at even distances


@dataclass(frozen=True)
class Index:
    """A block of items with their LSH keys; its size goes with the items' bytes."""

    ids: list
    texts: list[str]
    buffer: np.ndarray
    begins: np.ndarray
    classes: tuple[LengthClass, ...]
    short: dict[str, list]

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.short:
            return None
        out = ahocorasick.Automaton()
        for text, ids in self.short.items():
            out.add_word(text, (text, ids))
        out.make_automaton()
        return out


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(192, 256)]] = True
_GAP = np.zeros(256, bool)
_GAP[[0, 32]] = True


def word_starts(buffer: np.ndarray) -> np.ndarray:
    """Positions of a normalised byte buffer at which a window begins.

    That is after a space, at a letter or digit after a sign, and at every
    character of three or four bytes, as in scripts that don't part words.
    """
    gap = _GAP[buffer]
    after_gap = np.concatenate(([True], gap[:-1]))
    after_sign = np.concatenate(([False], ~_ALNUM[buffer[:-1]] & (buffer[:-1] < 128)))
    return np.flatnonzero(~gap & (after_gap | (after_sign & _ALNUM[buffer]) | (buffer >= 0xE0)))


def _in_bitmap(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    mixed = (h ^ (h >> np.uint64(29))) & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(mixed >> np.uint64(3)).astype(np.int64)] >> (mixed & np.uint64(7)).astype(np.uint8)) & 1


def _bitmap(h: np.ndarray) -> np.ndarray:
    """Packed bits of hashes, some 32 bits to each."""
    bits = 1 << max(10, int(len(h)).bit_length() + 5)
    out = np.zeros(bits, bool)
    out[((h ^ (h >> np.uint64(29))) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def _walk(buffer: np.ndarray, at: np.ndarray, repetition: Repetition, screen: bool) -> tuple[np.ndarray, np.ndarray]:
    """``(which, hash)``: the windows still in question and the hash of their samples."""
    which, place, h = np.arange(len(at)), at.astype(np.int64), np.zeros(len(at), np.uint64)
    taken, checks, wanted = 0, dict(repetition.prefixes) if screen else {}, set(repetition.samples.tolist())
    for step in range(int(repetition.samples[-1]) + 1):
        c = buffer[place]
        if step in wanted:
            h = (h ^ c) * _BASE
            taken += 1
            if taken in checks:
                stay = np.flatnonzero(_in_bitmap(checks[taken], h))
                which, place, h, c = which[stay], place[stay], h[stay], c[stay]
                if not len(which):
                    break
        place += repetition.moves[step][c]
    return which, h


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts as one byte buffer, each ended by a zero byte, and where they begin; zeros enough for a walk follow."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    longest = max(steps for _, steps, _ in CLASSES)
    return np.frombuffer(b"".join(r + b"\0" for r in raw) + b"\0" * (longest + 1), np.uint8), np.cumsum([0, *[len(r) + 1 for r in raw]])


def _edited(text: str, edits: int, rng: np.random.Generator, evenly: int | None = None) -> str:
    """So many characters deleted (0), replaced by another of the text (1) or doubled (2): any of these at random places, or one ``evenly`` spread."""
    out, edits = list(text), min(edits, len(text))
    places = rng.choice(len(text), edits, replace=False) if evenly is None else ((np.arange(edits) + rng.random()) * len(text) / max(edits, 1)).astype(int)
    for k in places.tolist():
        out[k] = ("", text[int(rng.integers(len(text)))], out[k] * 2)[int(rng.integers(3)) if evenly is None else evenly]
    return " ".join("".join(out).split())


def build_index(items: list[tuple[object, str]], *, classes: tuple = CLASSES, target_recall: float = TARGET_RECALL, most_edits: float = MOST_EDITS, seed: int = 23) -> Index:
    """LSH keys of a block of ``(item_id, text)``.

    In each length class repetitions are added until edited copies of its items
    are found with the target recall, those with evenly spread edits with
    ``EVEN_SHARE`` of it; if that can't be reached, this raises.
    """
    ids, texts, short = [], [], {}
    for item, text in items:
        text = normalise(text)
        if len(text.encode("utf-8", "replace")) >= classes[0][0]:
            ids.append(item)
            texts.append(text)
        elif text:
            short.setdefault(text, []).append(item)
    buffer, begins = _joined(texts)
    starts = word_starts(buffer)
    item = np.searchsorted(begins, starts, "right") - 1
    offset = starts - begins[item] if len(starts) else starts
    size = np.diff(begins) - 1
    edges = [least for least, _, _ in classes[1:]] + [1 << 62]
    found = []
    for (least, steps, samples), below in zip(classes, edges, strict=True):
        members = np.flatnonzero((size >= least) & (size < below))
        if len(members):
            # a window has half its size to run at least: walks move on at every second step
            fits = (size[item] >= least) & (size[item] < below) & (size[item] - offset >= steps // 2)
            index = Index(ids, texts, buffer, begins, (), {})
            found.append(_class_keys(index, members, item[fits], offset[fits], steps, samples, target_recall, most_edits, seed))
    return Index(ids, texts, buffer, begins, tuple(found), short)


def _class_keys(index: Index, members: np.ndarray, item: np.ndarray, offset: np.ndarray, steps: int, samples: int, target_recall: float, most_edits: float, seed: int) -> LengthClass:
    rng, out = np.random.default_rng(seed), []
    truth = np.tile(members, -(-LEAST_PROBES // len(members)))
    kinds = (None, 0, 1, 2)
    probes, probe_begins = _joined([_edited(index.texts[k], int(most_edits * len(index.texts[k])), rng, kind) for kind in kinds for k in truth.tolist()])
    truth = np.tile(truth, len(kinds))
    wanted = target_recall * np.array([1.0, EVEN_SHARE, EVEN_SHARE, EVEN_SHARE])
    found, starts = np.zeros(len(truth), bool), index.begins[item] + offset
    none = np.zeros(0, np.uint64)
    while True:
        draws = []
        for _ in range(DRAWS):
            moves = rng.integers(0, 2, (steps, 256)).astype(np.uint8)
            moves[:, 0] = 0  # walks stay where a text ends
            chosen = np.sort(rng.choice(steps, samples, replace=False))
            _, h = _walk(index.buffer, starts, Repetition(moves, chosen, (), none, none), False)
            draws.append((len(np.unique(h)), moves, chosen))
        # a walk that stays on few bytes gives many texts the same key
        _, moves, chosen = next(x for x in draws if x[0] >= NEARLY * max(n for n, _, _ in draws))
        maps = []
        for n in (4, 4 + (samples - 4) // 2):
            _, h = _walk(index.buffer, starts, Repetition(moves, chosen[:n], (), none, none), False)
            maps.append((n, _bitmap(h)))
        _, h = _walk(index.buffer, starts, Repetition(moves, chosen, (), none, none), False)
        order = np.argsort(h, kind="stable")
        out.append(Repetition(moves, chosen, tuple(maps), h[order], order))
        own = LengthClass(item, offset, (out[-1],), ())
        hits = candidates(probes, probe_begins, Index(index.ids, index.texts, index.buffer, index.begins, (own,), {}))
        found[hits[truth[hits[:, 0]] == hits[:, 1], 0]] = True
        recall = found.reshape(len(kinds), -1).mean(axis=1)
        if len(out) >= LEAST_REPETITIONS and (recall >= wanted).all():
            return LengthClass(item, offset, tuple(out), tuple(recall.tolist()))
        if len(out) == MOST_REPETITIONS:
            raise ValueError(f"items of {int(np.diff(index.begins)[members].min()) - 1} bytes and more are found with a recall of {recall.min():.3f} only: allow fewer edits")


def _near(buffer: np.ndarray, at: np.ndarray, index: Index, item: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Whether the text around each window is within reach of the item around it.

    Bit-parallel edit distance of up to 64 bytes of the item against the text
    there, for all candidates at once. Bytes count as equal if their last five
    bits are, which lets some more through and holds nothing back.
    """
    size = index.begins[item + 1] - 1 - index.begins[item]
    length = np.minimum(size, CHUNK)
    first = np.clip(offset - CHUNK // 4, 0, size - length)
    source, rows = index.begins[item] + first, np.arange(len(item))
    masks = np.zeros((len(item), 32), np.uint64)
    for k in range(int(length.max(initial=0))):
        c = index.buffer[np.minimum(source + k, len(index.buffer) - 1)] & 31
        masks[rows, c] |= np.where(k < length, _ONE << np.uint64(k), np.uint64(0))
    up, down = np.full(len(item), ~np.uint64(0)), np.zeros(len(item), np.uint64)
    here, top = length.astype(np.int64), (length - 1).astype(np.uint64)
    best, begin = here.copy(), at - offset + first - CHUNK_SLACK
    for k in range(int(length.max(initial=0)) + 2 * CHUNK_SLACK):
        place = begin + k
        c = buffer[np.clip(place, 0, len(buffer) - 1)] & 31
        same = masks[rows, c]
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(diagonal | up), up & diagonal
        here += ((right >> top) & _ONE).astype(np.int64) - ((left >> top) & _ONE).astype(np.int64)
        right, left = right << _ONE, left << _ONE
        up, down = left | ~(diagonal | right), right & diagonal
        np.minimum(best, here, out=best)
    return best <= CHUNK_EDITS * length + 1


def _distinct(rows: np.ndarray) -> np.ndarray:
    """Rows that differ in their first four columns, told apart by a 64-bit hash."""
    h = np.zeros(len(rows), np.uint64)
    for c in rows[:, :4].T:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return rows[np.unique(h, return_index=True)[1]]


#: Candidates that are expanded and screened together.
_PAIRS = 1 << 16


def candidates(buffer: np.ndarray, begins: np.ndarray, index: Index) -> np.ndarray:
    """Rows ``(text number, item, place in the text where the item would begin)`` of windows that share a key with an item's window and pass the screen, each once."""
    starts = word_starts(buffer)
    texts = np.searchsorted(begins, starts, "right") - 1
    found = []
    for own in index.classes:
        met = []
        for r in own.repetitions:
            which, h = _walk(buffer, starts, r, True)
            low, high = np.searchsorted(r.keys, h, "left"), np.searchsorted(r.keys, h, "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            which, low, n = which[hit], low[hit], (high - low)[hit]
            # some windows at a time: a text of one repeated word meets every window of such an item
            edges = np.searchsorted(np.cumsum(n), np.arange(0, n.sum(), _PAIRS), "right")
            for begin, end in zip(edges, [*edges[1:], len(n)], strict=True):
                k = n[begin:end]
                rows = np.repeat(np.arange(begin, end), k)
                at = np.repeat(low[begin:end], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                windows, place = r.owner[at], starts[which[rows]]
                item, offset, text = own.window_item[windows], own.window_offset[windows], texts[which[rows]]
                # windows of an item near each other that say the same are looked at once
                met.append(_distinct(np.stack([text, item, place - begins[text] - offset, offset // (CHUNK // 2), place, offset], axis=1)))
        if not met:
            continue
        rows = _distinct(np.concatenate(met))
        for begin in range(0, len(rows), _PAIRS):
            part = rows[begin : begin + _PAIRS]
            found.append(part[_near(buffer, part[:, 4], index, part[:, 1], part[:, 5])][:, :3])
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _regions(places: list[int], size: int, slack: int, end: int) -> Iterator[tuple[int, int]]:
    """The parts of a text that hold an item if it begins at one of the places, overlapping ones as one."""
    begin = stop = None
    for place in places:
        a, b = max(0, place - slack), min(end, place + size + slack)
        if stop is not None and a <= stop:
            stop = max(stop, b)
            continue
        if stop is not None:
            yield begin, stop
        begin, stop = a, b
    if stop is not None:
        yield begin, stop


def find_items(texts: list[str | None], index: Index, most_edits: float = MOST_EDITS, automaton=None) -> list[tuple[int, object, int, int]]:
    """``(text number, item id, edit distance, item length)`` of the items in each text, each item once per text."""
    clean = [normalise(t) for t in texts]
    buffer, begins = _joined(clean)
    out: dict[tuple[int, object], tuple[int, int]] = {}
    rows = candidates(buffer, begins, index)  # in order of text, item and place
    cuts = np.flatnonzero((np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)) + 1 if len(rows) else []
    for group in np.split(rows, cuts) if len(rows) else []:
        number, item = int(group[0, 0]), int(group[0, 1])
        pattern, size = index.texts[item], int(index.begins[item + 1] - index.begins[item]) - 1
        here, best = int(begins[number]), out.get((number, index.ids[item]), (len(pattern) + 1, 0))[0]
        for a, b in _regions(group[:, 2].tolist(), size, int(most_edits * size) + 8, int(begins[number + 1]) - 1 - here):
            if not best:
                break
            region = buffer[here + a : here + b].tobytes().decode("utf-8", "ignore")
            best = min(best, edit_distance_within(pattern, region)[0])
        if best <= most_edits * len(pattern):
            out[number, index.ids[item]] = (best, len(pattern))
    if automaton is not None:
        for number, text in enumerate(clean):
            for end, (word, ids) in automaton.iter(text):
                begin = end - len(word)
                if (begin < 0 or not text[begin].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                    for item in ids:
                        out[number, item] = (0, len(word))
    return [(number, item, distance, length) for (number, item), (distance, length) in out.items()]


#: Characters of documents that are walked together.
_TOGETHER = 1 << 20


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    begin, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(t)
        size += len(t or "")
        if size >= _TOGETHER:
            yield begin, held
            begin, held, size = i + 1, [], 0
    if held:
        yield begin, held


def item_blocks(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", most_bytes: int = MOST_ITEM_BYTES, most_edits: float = MOST_EDITS) -> Iterator[tuple[bool, Index]]:
    """Indexes over the items in blocks of bounded size, and whether there are several; null and empty items are left aside."""
    items = benchmark.filter(F.length(F.trim(F.col(text_col))) > 0).select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-2 * total // most_bytes) if total > most_bytes else 1
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        rows = [(r["id"], r["text"]) for r in part.collect()]
        if rows:
            yield blocks > 1, build_index(rows, most_edits=most_edits)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", most_edits: float = MOST_EDITS, most_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """One row ``doc_id, item_id, edits, item_chars, similarity`` for each benchmark item in a document.

    An item is in a document if some passage is at most ``most_edits`` of the
    item's length away, over lower-cased texts with single spaces. Items of less
    than 16 bytes, of which a few edits make other words, are found only as they
    are, between word boundaries. Documents aren't shuffled; items go to the
    executors in blocks of at most ``most_bytes``, one pass over the documents
    per block. If there are several, each one's result is stored before the next
    block is built, so that one block is held at a time.

    Nulls: a null or empty text holds no item, a null or empty item is in no
    text; a null document id or item id is passed on. Repeated documents and
    repeated items each get their rows, but one item id is listed once per
    document row. Empty tables give empty ones; other columns are left aside.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {kind.simpleString()}, `{item_col}` {item_kind.simpleString()}, edits int, item_chars int, similarity double"
    out = spark.createDataFrame([], schema)
    for several, index in item_blocks(benchmark, item_col=item_col, most_bytes=most_bytes, most_edits=most_edits):
        shared = spark.sparkContext.broadcast(index)

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            held = shared.value
            automaton = held.automaton()
            for batch in batches:
                ids, texts = batch.iloc[:, 0], batch.iloc[:, 1].tolist()
                rows = [(ids.iat[begin + number], item, distance, length, 1 - distance / length) for begin, part in _chunks(texts) for number, item, distance, length in find_items(part, held, most_edits, automaton)]
                frame = pd.DataFrame(rows, columns=[id_col, item_col, "edits", "item_chars", "similarity"])
                yield frame.astype({"edits": "int32", "item_chars": "int32", "similarity": "float64"})

        found = docs.select(id_col, text_col).mapInPandas(find, schema)
        out = out.unionByName(durable(found) if several else found)
        if several:
            shared.destroy()
    return out


def _holds(shared, text_col: str, most_edits: float) -> Column:
    """Whether a text holds any item of the shared index."""

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        automaton = index.automaton()
        for batch in batches:
            hit = np.zeros(len(batch), bool)
            for begin, part in _chunks(batch.tolist()):
                hit[[begin + row[0] for row in find_items(part, index, most_edits, automaton)]] = True
            yield pd.Series(hit)

    return holds(F.col(text_col))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", most_edits: float = MOST_EDITS, most_bytes: int = MOST_ITEM_BYTES) -> DataFrame:
    """``docs`` without those that hold a benchmark item; all columns stay and nothing is shuffled.

    What counts as held, and what becomes of nulls and repeated rows, is said at
    ``contaminated``. With several blocks of items the documents that are left
    are written after each.
    """
    spark, path = docs.sparkSession, None
    for several, index in item_blocks(benchmark, item_col=item_col, most_bytes=most_bytes, most_edits=most_edits):
        shared = spark.sparkContext.broadcast(index)
        docs = docs.filter(~_holds(shared, text_col, most_edits))
        if several:
            before = path
            docs, path = written(docs, "uncontaminated")
            shared.destroy()
            if before:
                discarded(spark, before)
    return docs
