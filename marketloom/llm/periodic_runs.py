"""Runs of words that repeat with a period, by seeding and extending diagonals.

A run of period ``q`` and enough length matches itself ``q`` words further on, over
an overlap that has a least size whatever ``q`` is. So the k-grams of that size are
indexed, pairs of their occurrences in one document are enumerated, and each pair
is extended along its diagonal (its lag) in both directions; for each lag, a table
of the furthest word covered so far leaves out pairs that an earlier extension has
passed already.

Which pairs: a gram at least as long as the period recurs exactly one period later
and no sooner (Fine and Wilf), so neighbouring occurrences are enough, one pair for
each place instead of all. Periods are taken in classes for that: the first up to
``k``, the size of the least overlap, then each up to twice the one before, with
grams of twice the size, named by pairs of the names of their halves. Only grams
that recur go on to the next class, so texts without repeats cost one pass.

Everything is inside a row: nothing is shuffled, and no document meets another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm._shared import with_columns

#: Bytes of text whose grams are indexed at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_OF_DOCUMENT = np.uint64(0xC2B2AE3D27D4EB4F)

RUNS = "array<struct<start: long, length: long, period: long>>"


def least_overlap(least_length: int, least_times: int) -> int:
    """Words over which any run matches itself one period later: the least over all periods."""
    return min(max(least_length - q, (least_times - 1) * q) for q in range(1, least_length + 1))


def recurring(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places whose k-gram recurs in the same document, in order, and a number for each such gram.

    Grams are sorted by a hash; equal neighbours are compared word for word, and
    if any differ all are numbered by their words instead.
    """
    none = np.zeros(0, np.int64)
    n = len(words) - k + 1
    if n < 2:
        return none, none
    key = np.zeros(n, np.uint64)
    for t in range(k):
        key *= _BASE
        key += words[t : t + n].view(np.uint64)
    key += doc[:n].view(np.uint64) * _OF_DOCUMENT
    inside = np.flatnonzero(doc[:n] == doc[k - 1 :])
    order = inside[np.argsort(key[inside], kind="stable")]
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return none, none
    twin = np.zeros(len(order), bool)
    twin[1:] |= same
    twin[:-1] |= same
    number = np.cumsum(np.concatenate(([True], ~same)))[twin]
    left, right = order[:-1][same], order[1:][same]
    equal = doc[left] == doc[right]
    for t in range(k):
        equal &= words[left + t] == words[right + t]
    place = order[twin]
    if not equal.all():
        grams = np.stack([doc[place], *(words[place + t] for t in range(k))], axis=1)
        number = np.unique(grams, axis=0, return_inverse=True)[1].reshape(-1)
    order = np.argsort(place, kind="stable")
    return place[order], number[order].astype(np.int64)


def doubled(place: np.ndarray, number: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for grams of twice the size, from those of size ``k`` that recur."""
    at = np.minimum(np.searchsorted(place, place + k), len(place) - 1)
    whole = place[at] == place + k
    whole[whole] = doc[place[whole]] == doc[place[at[whole]]]
    pairs = number[whole] * (number.max(initial=0) + 1) + number[at[whole]]
    _, named, times = np.unique(pairs, return_inverse=True, return_counts=True)
    again = times[named] > 1
    return place[whole][again], named[again]


def seeds(place: np.ndarray, number: np.ndarray, above: int, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """Lags and places of neighbouring occurrences with a lag in ``(above, upto]``; of adjacent places the first."""
    order = np.lexsort((place, number))
    p, same = place[order], number[order][1:] == number[order][:-1]
    first, lag = p[:-1][same], np.diff(p)[same]
    fits = (lag > above) & (lag <= upto)
    first, lag = first[fits], lag[fits]
    order = np.lexsort((first, lag))
    first, lag = first[order], lag[order]
    fresh = np.ones(len(first), bool)
    fresh[1:] = (np.diff(first) != 1) | (np.diff(lag) != 0)
    return lag[fresh], first[fresh]


def matching(words: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The longest stretch ``[a, b)`` around ``at`` whose words equal those ``lag`` further on, within ``[low, high)``."""
    a, b, step = at, at, 32
    while b < high - lag:
        end = min(b + step, high - lag)
        differ = np.flatnonzero(words[b:end] != words[b + lag : end + lag])
        if len(differ):
            b += int(differ[0])
            break
        b, step = end, 2 * step
    step = 32
    while a > low:
        begin = max(a - step, low)
        differ = np.flatnonzero(words[begin:a] != words[begin + lag : a + lag])
        if len(differ):
            a = begin + int(differ[-1]) + 1
            break
        a, step = begin, 2 * step
    return a, b


def runs_of(words: np.ndarray, bounds: np.ndarray, *, least_length: int = 24, least_times: int = 3) -> list[tuple[int, int, int, int]]:
    """Runs ``(document, start, length, period)`` of documents laid end to end, ``bounds[d]:bounds[d + 1]`` each."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    k, above, out = least_overlap(least_length, least_times), 0, []
    place, number = recurring(words, doc, k)
    while len(place):
        covered: dict[int, int] = {}  # by lag, how far extensions have come
        for lag, at in zip(*(x.tolist() for x in seeds(place, number, above, k)), strict=True):
            if at < covered.get(lag, 0):
                continue
            d = int(doc[at])
            low, high = int(bounds[d]), int(bounds[d + 1])
            a, b = matching(words, at, lag, low, high)
            covered[lag] = b
            if b + lag - a >= max(least_length, least_times * lag):
                out.append((d, a - low, b + lag - a, lag))
        place, number = doubled(place, number, doc, k)
        above, k = k, 2 * k
    return sorted(out)


def _described(texts: list[bytes], least_length: int, least_times: int) -> list[tuple[int, list[dict], str]]:
    words = [t.split() for t in texts]  # bytes are split at the six ASCII white spaces
    bounds = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
    flat = np.empty(int(bounds[-1]), object)
    flat[:] = [w for ws in words for w in ws]
    found = runs_of(pd.factorize(flat)[0].astype(np.int64), bounds, least_length=least_length, least_times=least_times)
    runs: list[list[dict]] = [[] for _ in texts]
    for d, start, length, period in found:
        runs[d].append({"start": start, "length": length, "period": period})
    out = []
    for ws, rs in zip(words, runs, strict=True):
        kept = ws
        if rs:
            edges = np.zeros(len(ws) + 1, np.int64)
            for r in rs:
                edges[r["start"] + r["period"]] += 1
                edges[r["start"] + r["length"]] -= 1
            kept = [ws[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
        out.append((len(ws), rs, b" ".join(kept).decode("utf-8", "replace")))
    return out


def find_runs(docs: DataFrame, *, text_col: str = "text", least_length: int = 24, least_times: int = 3) -> DataFrame:
    """All columns of ``docs`` plus ``n_words, runs, collapsed_text``.

    Words are what stands between ASCII white space. A run is a stretch of words
    with smallest period ``q`` (words ``q`` apart are equal) of at least
    ``least_length`` words and ``least_times`` periods that no neighbouring word
    extends; ``runs`` holds them by start, then period. ``collapsed_text`` joins
    by one space the words that stay when each run keeps its first period only.

    A null or empty text has no words, no runs and an empty collapsed text. Each
    row is judged alone, so repeated rows get equal results and an empty table
    stays empty. Whole texts of any length are read; one that is longer than
    ``BLOCK_BYTES`` is indexed by itself. Input columns named like an added one
    give way, whatever their case.
    """
    if least_times < 3 or least_length < least_times:
        raise ValueError("least_times must be 3 or more, and least_length no less than that")

    @F.pandas_udf(f"n_words long, runs {RUNS}, collapsed_text string")
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, held, size = [], [], 0
            for text in batch:
                raw = (text or "").encode("utf-8", "replace")
                if held and size + len(raw) > BLOCK_BYTES:
                    out += _described(held, least_length, least_times)
                    held, size = [], 0
                held.append(raw)
                size += len(raw)
            if held:
                out += _described(held, least_length, least_times)
            yield pd.DataFrame(out, columns=["n_words", "runs", "collapsed_text"])

    taken = {c.lower() for c in docs.columns}
    held = next(name for i in range(len(taken) + 1) if (name := f"described_{i}") not in taken)
    described = docs.withColumn(held, describe(F.col(text_col)))
    return with_columns(described, n_words=F.col(held)["n_words"], runs=F.col(held)["runs"], collapsed_text=F.col(held)["collapsed_text"]).drop(held)


def strongest(runs) -> F.Column:
    """Of an array of runs by start and period, the first with the greatest exact length / period; null without runs."""
    return F.aggregate(
        F.slice(runs, 2, F.greatest(F.size(runs) - 1, F.lit(0))), F.get(runs, F.lit(0)),
        lambda best, run: F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best),
    )


def with_planted_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every tenth text, by the CRC of its id, made periodic from some word on.

    With ``h`` the CRC-32 of the decimal id and ``g = floor(h / 10)``, a text of
    ``n > 0`` words with ``h % 10 = 0`` has each word ``i >= a`` replaced by word
    ``a + (i - a) % p``, where ``a = g % n`` and ``p = 1 + floor((n - a) / (3 + g % 8))``.
    Rows without an id and all other texts stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    periodic = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return with_columns(docs, **{text_col: F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), periodic).otherwise(F.col(text_col))})
