"""Periodic runs against brute force, and best-fit packing against the vocabulary's library."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import packing, periodic_runs
from marketloom.llm.queries import QUERIES
from marketloom.llm.token_count import default_vocabulary

SPACE = r"[\x20\x09-\x0D]+"


def plain_runs(words, least=24, times=3):
    """All runs, straight from their definition."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i - a + q
            stretch = words[a : a + length]
            if length >= max(least, times * q) and not any(all(stretch[x] == stretch[x + p] for x in range(length - p)) for p in range(1, q)):
                out.append((a, length, q))
    return sorted(out)


@pytest.mark.parametrize("least, times", [(24, 3), (10, 3), (30, 4), (3, 3)])
def test_runs_equal_their_definition(least, times):
    rng = random.Random(least)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(letters) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 4)):
            a = rng.randrange(len(words) + 1)
            p, size = rng.randint(1, max(1, (len(words) - a) // 3)), rng.randint(0, len(words) - a)
            for i in range(a, a + size):
                words[i] = words[a + (i - a) % p]
            if size and rng.random() < 0.5:
                words[a + rng.randrange(size)] = rng.randrange(letters)
        k = rng.randint(0, len(words))  # two documents laid end to end
        got = periodic_runs.runs_of(np.array(words, np.int64), np.array([0, k, len(words)]), least_length=least, least_times=times)
        assert got == [(0, *r) for r in plain_runs(words[:k], least, times)] + [(1, *r) for r in plain_runs(words[k:], least, times)]


def test_equal_hashes_lose_no_run(monkeypatch):
    monkeypatch.setattr(periodic_runs, "_BASE", np.uint64(0))  # a gram's hash is then that of its last word
    words = [1, 2, 3, 4, 5, 6, 7, 8] * 6 + [9, 2, 8] * 12 + [8] * 30
    assert periodic_runs.runs_of(np.array(words), np.array([0, len(words)])) == [(0, *r) for r in plain_runs(words)]


def test_least_overlap():
    assert periodic_runs.least_overlap(24, 3) == 16 and periodic_runs.least_overlap(3, 3) == 2


def plain_planted(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_plain_form(spark, sf_dir, documents):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    rows = documents.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    seen = 0
    for row in rows:
        words = plain_planted(row.doc_id, [w for w in re.split(SPACE, row.text or "") if w])
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=(None,) * 3)
        dropped = {i for a, size, q in runs for i in range(a + q, a + size)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        r = got[row.doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        seen += len(runs)
    assert seen > 10


def test_runs_of_odd_documents(odd_documents, no_documents, clashing):
    found = {(r.doc_id, r.n_words, len(r.runs)) for r in periodic_runs.find_runs(odd_documents).collect()}
    assert {(4, 0, 0), (5, 0, 0), (6, 0, 0), (7, 60_000, 1), (8, 1, 0), (10, 5, 0), (None, 1, 0)} <= found
    assert periodic_runs.find_runs(no_documents).count() == 0
    again = periodic_runs.find_runs(clashing.withColumn("RUNS", F.lit("x")))
    assert again.columns[-3:] == ["n_words", "runs", "collapsed_text"] and "RUNS" not in again.columns and again.count() == clashing.count()
    planted = {(r.doc_id, r.text) for r in periodic_runs.with_planted_runs(odd_documents).collect()}
    assert {(None, "lost"), (4, None), (5, "")} <= planted
    with pytest.raises(ValueError):
        periodic_runs.find_runs(odd_documents, least_times=2)


# --- packing ----------------------------------------------------------------


def filled(plan, counts):
    """Pieces by sequence, as the slots say."""
    out = defaultdict(list)
    for n, slots in plan.items():
        for (rank, first, each, offset), end in zip(slots, [*(s[0] for s in slots[1:]), counts[n]], strict=True):
            for k in range(end - rank):
                out[first + k // each].append((offset + k % each * n, n))
    return out


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        size = rng.choice([10, 50, 2048])
        counts = {rng.randint(1, size): rng.randint(1, rng.choice([3, 60])) for _ in range(rng.choice([1, 5, 40]))}
        plan, made = packing.best_fit_plan(counts, size)
        rooms = []
        for n in sorted(counts, reverse=True):
            for _ in range(counts[n]):
                fits = [r for r in rooms if r[0] >= n]
                if fits:
                    min(fits)[0] -= n
                else:
                    rooms.append([size - n])
        assert made == len(rooms)
        taken = filled(plan, counts)
        assert sorted(taken) == list(range(made))
        for pieces in taken.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= size


def test_plan_of_a_large_corpus_is_small():
    counts = {n: 10**11 // n**2 for n in range(1, 2049)}
    plan, made = packing.best_fit_plan(counts, 2048)
    assert sum(map(len, plan.values())) < 20_000 and made <= 1.001 * sum(n * c for n, c in counts.items()) / 2048


def test_ids_equal_the_library():
    ids, rng = packing.TokenIds(default_vocabulary()), random.Random(2)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "'s", "'ll", "é", "ǅ", "日本", "😀", ".", "!!", "12", "²", "<|endoftext|>", "\r\n", " \n", "​", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    assert ids(texts) == [ids.whole(t) for t in texts]


def test_a_worker_learns_a_pre_token_once(monkeypatch):
    """Also from one task to the next, and when its memory is full in between."""
    library, learnt = packing.TokenIds(default_vocabulary()), []
    learn = packing.TokenIds.learn

    def counted(self, new):
        learnt.append([t for t in new if t not in self.before])
        learn(self, new)

    packing._encoder.cache_clear()
    monkeypatch.setattr(packing.TokenIds, "learn", counted)
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    texts = [" ".join(f"word{'abcdefghij'[(i + j) % 10] * 3} it's" for j in range(9)) + ".\n" + "x" * (i % 4) for i in range(60)]
    for _task in range(3):
        ids = packing._encoder(default_vocabulary())
        assert [ids([t])[0] for t in texts] == [library.whole(t) for t in texts]
    flat = [t for some in learnt for t in some]
    assert flat and len(flat) == len(set(flat))
    packing._encoder.cache_clear()


def check_packed(rows, texts, sequence):
    library = Tokenizer.from_file(default_vocabulary())
    by_doc, places = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(-(-len(ids) // sequence)))
        assert [r.start for r in pieces] == [sum(x.length for x in pieces[:i]) for i in range(len(pieces))]
        assert all(r.length == sequence for r in pieces[1:]) and sum(r.length for r in pieces) == len(ids)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for pieces in places.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= sequence
    return len(places)


def test_packed_documents_hold_the_librarys_ids(spark, sf_dir, documents):
    rows = QUERIES["op13_pack_sequences"](spark, sf_dir).collect()
    made = check_packed(rows, {r.doc_id: r.text for r in documents.collect()}, 2048)
    assert made <= 1.02 * sum(r.length for r in rows) / 2048 + 1
    small = packing.pack_documents(documents, sequence=100)
    assert "ids" in small.columns
    check_packed(small.collect(), {r.doc_id: r.text for r in documents.collect()}, 100)


def test_packing_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 7)
    pieces = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 49 + 1).cast("long").alias("length"), F.lit("x").alias("OFFSET"))
    rows = packing.pack(pieces.repartition(9), sequence=100).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    assert len(rows) == 5000 and sum(n for v in places.values() for _, n in v) == sum(r.length for r in rows)
    for v in places.values():
        assert [o for o, _ in sorted(v)] == [sum(n for _, n in sorted(v)[:i]) for i in range(len(v))] and sum(n for _, n in v) <= 100


def test_packing_odd_documents(spark, odd_documents, no_documents, clashing):
    for table in (odd_documents, clashing):
        rows = packing.pack_documents(table, keep_ids=False).collect()
        count = defaultdict(int)
        for r in rows:
            count[r.doc_id] += r.length
        assert count[4] == count[5] == 1 and count.keys() == {r.doc_id for r in table.collect()}
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        assert sum(r.doc_id == 10 for r in rows) == 2
    assert packing.pack_documents(no_documents).count() == 0
    for bad in (0, 101, None):
        with pytest.raises(ValueError):
            packing.pack(spark.createDataFrame([(bad,)], "length long"), sequence=100)
