"""Token counts under a byte-level BPE vocabulary, by merging arrays rank by rank.

Texts are cut into pre-tokens as the vocabulary's library does. Pre-tokens that a
task hasn't met yet are held together as one ragged numpy array of symbols. In
each step every pre-token applies its lowest-rank pair at all places at once; when
no pair is left, the surviving symbols are counted. A merge makes a symbol that
only later merges use, so applying all places of one rank together gives what
applying them one by one gives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm._shared import with_columns

#: The vocabulary's pre-token pattern (a fixed value of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose counts a task remembers; the memory is emptied beyond that.
REMEMBERED = 400_000
#: Characters of new pre-tokens merged at once.
BLOCK_SYMBOLS = 1 << 20
_NONE = np.int64(1) << 40


def default_vocabulary() -> str:
    """Path of the installed vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


def refuse_other_kinds(held: dict) -> None:
    """Raise for a vocabulary file whose library cuts or merges texts in a way that isn't counted here."""
    cut, model = held.get("pre_tokenizer") or {}, held["model"]
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    if held.get("normalizer") or not plain:
        raise ValueError("only vocabularies without normalizer, cut by the byte-level pattern alone, can be counted")
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if model.get("type") != "BPE" or odd:
        raise ValueError(f"not a plain byte-pair model: {model.get('type')} {odd}")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in held["added_tokens"]):
        raise ValueError("added tokens that take in or ask for what is beside them can't be counted")


class Vocabulary:
    """Merge ranks by pair and the strings that are tokens of their own."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        refuse_other_kinds(held)
        ids = held["model"]["vocab"]
        self.bytes = np.array([ids[c] for c in byte_letters()], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"]]
        left, right = (np.array([ids[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.width = np.int64(max(ids.values()) + 1)
        pairs = left * self.width + right
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.rank, self.made = pairs[order], order.astype(np.int64), made
        special = [t["content"] for t in held["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True))) if special else None
        self.pattern = regex.compile(PATTERN)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, ``_NONE`` where no merge applies."""
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        return np.where(self.pairs[at] == pair, self.rank[at], _NONE)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), lengths)
        done = np.zeros(len(raw), np.int64)
        rank = np.full(len(symbols), _NONE)  # of a symbol and the next one
        inner = owner[:-1] == owner[1:]
        rank[:-1][inner] = self.ranks(symbols[:-1][inner], symbols[1:][inner])
        while len(symbols):
            begins = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            sizes = np.diff(np.append(begins, len(owner)))
            lowest = np.minimum.reduceat(rank, begins)
            over = lowest == _NONE  # nothing left to merge: count and leave
            if over.any():
                done[owner[begins[over]]] = sizes[over]
                stay = np.repeat(~over, sizes)
                symbols, owner, rank, lowest, sizes = symbols[stay], owner[stay], rank[stay], lowest[~over], sizes[~over]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, sizes)
            # where places overlap (a pair of equal symbols in a run) every other one counts, from the left
            number = np.arange(len(hit))
            runs = number - np.maximum.accumulate(np.where(hit, -1, number))
            hit &= (runs % 2 == 1) | (runs == 0)
            places = np.flatnonzero(hit)
            symbols[places] = self.made[rank[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            changed = np.zeros(len(symbols), bool)
            changed[places] = True
            before = places[places > 0] - 1
            before = np.where(keep[before], before, before - 1)  # the symbol before may have just been merged away
            changed[before[before >= 0]] = True
            symbols, owner, rank, changed = symbols[keep], owner[keep], rank[keep], np.flatnonzero(changed[keep])
            rank[changed] = _NONE
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        return done


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Counter:
    """Counts the tokens of texts, remembering pre-tokens met before."""

    def __init__(self, path: str) -> None:
        self.words, self.known = vocabulary(path), {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text, and how many special strings it holds."""
        v = self.words
        if v.special is None or not v.special.search(text):
            return v.pattern.findall(text), 0
        parts, out = v.special.split(text), []
        for part in parts:
            out += v.pattern.findall(part)
        return out, len(parts) - 1

    def learn(self, new: list[str]) -> None:
        at = 0
        while at < len(new):
            end, held = at, 0
            while end < len(new) and held < BLOCK_SYMBOLS:
                held += len(new[end])
                end += 1
            self.known.update(zip(new[at:end], self.words.count(new[at:end]).tolist(), strict=True))
            at = end

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        split = [self.pieces(t) for t in texts]
        new = {p for pieces, _ in split for p in pieces} - self.known.keys()
        if new:
            self.learn(list(new))
        known = self.known
        return [sum([known[p] for p in pieces]) + special for pieces, special in split]


def token_count_column(text_col: str, path: str | None = None) -> Column:
    """Tokens of each text; texts are taken a few megabytes at a time."""
    file = path or default_vocabulary()
    vocabulary(file)  # an unfit file fails here, not in a task

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(file)
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch:
                held.append(text or "")
                size += len(held[-1])
                if size > 1 << 21:
                    out += counter(held)
                    held, size = [], 0
            yield pd.Series(out + counter(held), dtype="int64")

    return count(F.col(text_col))


def count_tokens(docs: DataFrame, *, text_col: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``n_bytes, n_tokens, over_limit``.

    Counts are those of the vocabulary's library for the whole text: no begin or
    end tokens, no truncation; a special string inside a text is one token. A
    null text is an empty one (no tokens). A vocabulary that needs other cutting
    or merging raises ``ValueError``. Input columns named like an added one
    give way; empty tables stay empty. Nothing is shuffled.
    """
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    counted = with_columns(docs, n_bytes=size, n_tokens=token_count_column(text_col, path))
    return with_columns(counted, over_limit=F.col("n_tokens") > limit)
