"""Phrase mining against plain counts and whole-number scores."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import phrases
from marketloom.llm.queries import QUERIES

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, least=100, most=5, percent=100, best=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_TO_Z)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longer[p[i : i + size]] = max(longer[p[i : i + size]], a)
        scored = []
        for p, a in found.items():
            if longer[p] and 100 * longer[p] >= percent * a:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(tuple(r) for r in phrases.collocations(df, **options).collect())


def test_query_equals_plain_counts(spark, sf_dir, documents):
    got = sorted(tuple(r) for r in QUERIES["op11_collocations"](spark, sf_dir).collect())
    assert got and got == plain_collocations([(r.lang, r.text) for r in documents.collect()])


@pytest.mark.parametrize("in_trie", [50, 1 << 18])
def test_many_tries_and_bounds(documents, monkeypatch, in_trie):
    monkeypatch.setattr(phrases, "MOST_IN_TRIE", in_trie)
    some = documents.limit(60) if in_trie == 50 else documents
    rows = [(r.lang, r.text) for r in some.collect()]
    least = 40 if in_trie == 50 else 12
    assert mined(some, least=least, inside_percent=80, best=50) == plain_collocations(rows, least=least, percent=80, best=50)


def test_full_buckets_lose_nothing(documents):
    """With few buckets nearly all are kept; the tries count exactly nevertheless."""
    some = documents.limit(40)
    assert mined(some, least=10, bucket_bits=15) == plain_collocations([(r.lang, r.text) for r in some.collect()], least=10)


def test_hashes_are_spelled_out():
    text = np.array([1, 2, 3, 1, 2, 4, 0, 4, 2, 1, 2, 3, 0], np.uint64)
    three = phrases.hashed(text, 3, np.array([0]))
    two = phrases.hashed(text, 2, np.array([3, 7]))
    rows, hashes = phrases.phrases_of_hashes(text, 4, np.concatenate((three, two, [np.uint64(99)])))
    assert {tuple(r) for r in rows.tolist()} == {(1, 2, 3, 0), (1, 2, 0, 0), (4, 2, 0, 0)} and sorted(hashes) == sorted(np.concatenate((three, two)))
    assert len(phrases.phrases_of_hashes(text, 4, np.zeros(0, np.uint64))[0]) == 0


def test_phrases_sharing_a_hash_take_another_seed(documents, monkeypatch):
    kept, tried = phrases._kept, []

    def clumsy(blocks, shared, k, least, seed):
        """Under the first seed counts are not those of single phrases."""
        tried.append(seed)
        out = kept(blocks, shared, k, least, seed)
        return out if seed else out.withColumn("n", F.col("n") + 1)

    monkeypatch.setattr(phrases, "_kept", clumsy)
    assert mined(documents.limit(40), least=10) == plain_collocations([(r.lang, r.text) for r in documents.limit(40).collect()], least=10)
    assert {0, 1} == set(tried)


def test_words_sharing_a_code_take_another_seed(documents, monkeypatch):
    coded, tried = phrases.encoded, []

    def clumsy(docs, seed, **options):
        tried.append(seed)
        if seed:
            return coded(docs, seed, **options)
        one = F.udf(lambda raw: (np.frombuffer(raw, "<u8") & np.uint64(1023) | np.uint64(1)).tobytes()[8:].rjust(len(raw), b"\0"), "binary")
        short = lambda c: c.bitwiseAND(F.lit(1023)).bitwiseOR(F.lit(1))
        return coded(docs, seed, **options).withColumns({"codes": one("codes"), "new_codes": F.transform("new_codes", short)})

    monkeypatch.setattr(phrases, "encoded", clumsy)
    assert mined(documents.limit(40), least=10) == plain_collocations([(r.lang, r.text) for r in documents.limit(40).collect()], least=10)
    assert tried == [0, 1]


def test_trie_counts_states():
    rng = np.random.default_rng(1)
    vocabulary = np.unique(rng.integers(-(2**63), 2**63, 200))
    found = set()
    for _ in range(2000):
        p = tuple(vocabulary[np.minimum(rng.geometric(0.05, int(rng.integers(2, 6))) - 1, 199)].tolist())
        found |= {p[:k] for k in range(2, len(p) + 1)}
    rows = np.array([[*p, *[0] * (5 - len(p))] for p in found])
    trie = phrases.Trie(rows)
    assert len(set(trie.accepting.tolist())) == len(rows)
    codes = np.concatenate(([0], vocabulary, [5, 6]))
    ids = np.append(np.minimum(rng.geometric(0.05, 5000), 202) * (rng.random(5000) < 0.9), 0)
    counts, text = trie.count(ids, codes.view(np.uint64), 5), codes[ids].tolist()
    want = Counter(p for i in range(len(text)) for k in range(2, 6) if (p := tuple(text[i : i + k])) in found)
    assert {p: n for p, n in zip(map(tuple, (r[r != 0].tolist() for r in rows)), counts[trie.accepting].tolist(), strict=True) if n} == want


def test_a_task_gives_a_state_once(spark, documents):
    """However many blocks it reads; the sums are those of all blocks."""
    cores = spark.sparkContext.defaultParallelism
    blocks = phrases.encoded(documents.limit(100).repartition(2 * cores), 0).localCheckpoint()
    assert blocks.count() == 2 * cores
    texts = [np.frombuffer(r.codes, "<u8")[np.frombuffer(r.ids, phrases._number_kind(len(r.codes) // 8))] for r in blocks.collect()]
    pairs = Counter(p for t in texts for p in zip(t.tolist(), t[1:].tolist(), strict=False) if all(p))
    common = np.array([p for p, _ in pairs.most_common(50)], np.uint64).view(np.int64)
    trie = phrases.Trie(common)
    rows = phrases._state_counts(blocks, spark.sparkContext.broadcast(trie), 2).select(F.spark_partition_id().alias("task"), "state", "n").collect()
    assert {r.task for r in rows} == {*range(cores)} and len({(r.task, r.state) for r in rows}) == len(rows)
    sums = Counter()
    for r in rows:
        sums[r.state] += r.n
    assert [sums[s] for s in trie.accepting.tolist()] == [n for _, n in pairs.most_common(50)]


def test_large_counts_stay_exact(spark):
    """1000 * a * n beyond 64 bits: the quotient of whole decimals."""
    a, n, left, right = 987_654_321_987, 12_345_678_901_234, 987_654_999_999, 999_999_999_999
    row = spark.range(1).select(F.call_function("div", F.lit(1000).cast("decimal(19,0)") * F.lit(a).cast("decimal(19,0)") * F.lit(n).cast("decimal(19,0)"), F.lit(left).cast("decimal(19,0)") * F.lit(right).cast("decimal(19,0)")).alias("q")).first()
    assert row.q == 1000 * a * n // (left * right)


def test_odd_documents(spark, odd_documents, no_documents, clashing):
    rows = [(r.lang, r.text) for r in odd_documents.collect()]
    for table in (odd_documents, clashing.withColumn("phrase", F.lit(1)).withColumn("RANK", F.lit(1))):
        assert mined(table, least=2) == plain_collocations(rows, least=2)
    assert mined(no_documents) == [] and mined(odd_documents, least=10**9) == []
    dashes = spark.createDataFrame([(None, "a b. a b"), ("und", "A b,a b\tc d"), ("xx", None), ("xx", "é É é É")], "lang string, text string")
    assert mined(dashes, least=1) == plain_collocations([(r.lang, r.text) for r in dashes.collect()], least=1)
