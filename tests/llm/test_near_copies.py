"""Near-dedup of the pipeline: all pairs by the Jaccard similarity of five-word shingles."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from marketloom.llm import near_copies, pipeline, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    sets = {}
    for k, r in enumerate(rows):
        sets.setdefault(plain_set(r.text), []).append(k)
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    values, by_id = list(sets), defaultdict(list)
    for k, r in enumerate(rows):
        by_id[r.doc_id].append(k)
    groups = [*sets.values(), *(g for i, g in by_id.items() if i is not None)]
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            both = len(a & b)
            if both and Fraction(both, len(a) + len(b) - both) >= Fraction(4, 5):
                groups.append([sets[a][0], sets[b][0]])
    for g in groups:
        for k in g:
            label[root(k)] = root(g[0])
    ids = defaultdict(list)
    for k, r in enumerate(rows):
        ids[root(k)] += [r.doc_id] if r.doc_id is not None else []
    return Counter((r.doc_id, min(ids[root(k)], default=None)) for k, r in enumerate(rows))


@pytest.fixture(scope="module")
def edited(spark):
    """Copies with edits that leave a similarity about 0.8, a chain of them, and many texts with one common passage."""
    rng, rows = random.Random(4), []
    passage = [f"same{i}" for i in range(30)]
    for group in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]
        for _ in range(6):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(max(1, len(words) // rng.choice((40, 55, 80)))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join([*passage, *words[: rng.randrange(1, 30)]])))
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_components_equal_all_pairs(documents, odd_documents, no_documents, edited):
    for table in (documents, odd_documents, edited):
        got = Counter((r.doc_id, r.component_id) for r in near_copies.similar_documents(table).collect())
        assert got == plain_components(table.collect())
    assert near_copies.similar_documents(no_documents).count() == 0


def test_any_order_of_shingles_finds_all_links(edited, monkeypatch):
    monkeypatch.setattr(near_copies, "SAMPLED", 1)
    monkeypatch.setattr(near_copies, "FREQUENT", 2)
    got = Counter((r.doc_id, r.component_id) for r in near_copies.similar_documents(edited.repartition(7)).collect())
    assert got == plain_components(edited.collect())


def test_stage_drops_copies_far_apart_in_bits(spark, sf_dir, edited):
    """Pairs of similarity 0.8 that differ in more than three bits: both stayed before."""
    docs = edited.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.char_length("text").cast("long").alias("n_chars"))
    least = {c for _, c in plain_components(edited.collect())}
    got = [r.doc_id for r in pipeline.keep_one_of_near_copies(spark, docs, sf_dir).collect()]
    assert sorted(got) == sorted(least)
    assert simhash.drop_near_duplicates(docs).count() > len(least)


def test_bitmaps_never_rule_out_a_similar_pair():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randrange(1, 700)
        a = {rng.randrange(2**64) for _ in range(n)}
        b = set(list(a)[rng.randrange(n) :]) | {rng.randrange(2**64) for _ in range(rng.randrange(n + 1))} or {1}
        x, y = (near_copies.parity_bitmap(near_copies.np.array(sorted(s), near_copies.np.uint64)) for s in (a, b))
        assert near_copies.least_difference(x, y) <= len(a ^ b)
