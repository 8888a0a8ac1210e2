"""Operators over a whole corpus: mixing, sharding, exact and near duplicates, the pipeline."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from marketloom.llm import exact_dedup, mixing, pipeline, quality, sharding, simhash
from test_near_copies import plain_components as plain_near_copies


# --- mixing -----------------------------------------------------------------


def poisson_count(doc_id, rate, seed=17):
    u = int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        k += 1
        p *= rate / k
        total += p
    return k


@pytest.mark.parametrize("most", [4096, 0])
def test_mixing_equals_plain_inversion(documents, most):
    rows = documents.collect()
    size = Counter()
    for r in rows:
        size[r.source] += len(r.text.encode())
    all_weights, total = sum(map(math.sqrt, size.values())), sum(size.values())
    rate = {s: math.sqrt(n) / all_weights * total / n for s, n in size.items()}
    want = Counter({r.doc_id: poisson_count(r.doc_id, rate[r.source]) for r in rows})
    mixed = mixing.mix_sources(documents, most_broadcast=most).collect()
    got = Counter(r.doc_id for r in mixed)
    assert +want == got and len({(r.doc_id, r.copy_no) for r in mixed}) == len(mixed)


def test_poisson_tables(spark):
    rates = [0.0, 0.3, 4.0, 900.0, 20_000.0, 1e6]
    df = spark.createDataFrame([(str(r), r) for r in rates], "source string, mix_rate double")
    for row in mixing.poisson_tables(df).collect():
        rate, k = row.mix_rate, row.first_count + np.arange(len(row.cdf))
        want = np.cumsum(np.exp(-rate + k * np.log(rate) - np.array([math.lgamma(x + 1) for x in k]))) if rate else np.ones(len(k))
        assert np.abs(np.array(row.cdf) - want).max() < 1e-7 and (np.diff(row.cdf) >= 0).all() and row.cdf[-1] == 1.0
        assert len(k) < 25 * math.sqrt(rate) + 70 and abs(want[-1] - 1) < 1e-7


def test_places_in_a_table(spark):
    table = [0.1, 0.1, 0.25, 0.7, 1.0]
    for u, n in ((0.0, 0), (0.1, 2), (0.2, 2), (0.25, 3), (0.69, 3), (0.999, 4)):
        row = spark.range(1).select(mixing.place_in(F.array(*map(F.lit, table)), F.lit(u)).alias("n"), mixing.place_in(F.array(F.lit(1.0)), F.lit(u)).alias("one")).first()
        assert (row.n, row.one) == (n, 0)


def test_large_rates_are_drawn_in_seconds(spark):
    docs = spark.createDataFrame([(1, "tiny", "small")], "doc_id long, text string, source string")
    assert abs(mixing.mix_sources(docs, {"small": 1.0}, budget=4_000_000).count() - 1_000_000) < 6_000


def test_weights_are_reached(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"), F.lit("0123456789").alias("text"))
    n = {r.source: r["count"] for r in mixing.mix_sources(docs, {"a": 6, "b": 3}).groupBy("source").count().collect()}
    assert n.keys() == {"a", "b"} and n["a"] == pytest.approx(40_000, rel=0.02) and n["b"] == pytest.approx(20_000, rel=0.02)


def test_mixing_odd_documents(odd_documents, no_documents, clashing):
    for table in (odd_documents, clashing):
        out = mixing.mix_sources(table)
        assert len(set(map(str.lower, out.columns))) == len(out.columns)
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(r.doc_id, r.text) for r in table.collect()}
    assert mixing.mix_sources(no_documents).count() == 0
    # what has no bytes keeps rate 1, here source 's2'
    assert mixing.mix_sources(odd_documents, {}).count() == poisson_count(4, 1.0) + poisson_count(5, 1.0)


# --- sharding ---------------------------------------------------------------


def plain_shards(rows, k):
    """Greedy filling under the smallest capacity, over all groups in one list."""
    size = Counter()
    for r in rows:
        size[hashlib.md5((r.text or "").encode()).hexdigest()] += len((r.text or "").encode()) + 8
    rest, left, alone = sum(size.values()), k, []
    for key, n in sorted(size.items(), key=lambda kv: (-kv[1], kv[0])):
        if left <= 1 or n * left < rest:
            break
        alone.append(key)
        rest, left = rest - n, left - 1
    line = sorted((key, n) for key, n in size.items() if key not in alone)

    def fill(capacity):
        out, shard, held = {}, 0, 0
        for key, n in line:
            if held + n > capacity:
                shard, held = shard + 1, 0
            held += n
            out[key] = len(alone) + shard
        return out, shard + 1

    capacity = max([n for _, n in line], default=0)
    while line and fill(capacity)[1] > left:
        capacity += 1
    return {key: i for i, key in enumerate(alone)} | (fill(capacity)[0] if line else {}), size


@pytest.mark.parametrize("k", [1, 3, 24])
def test_shards_equal_the_plain_search(documents, odd_documents, k):
    for table in (documents.limit(60), odd_documents):
        rows = table.collect()
        want, _ = plain_shards(rows, k)
        got = sharding.shard_documents(table, k).collect()
        assert len(got) == len(rows)
        slots = defaultdict(list)
        for r in got:
            assert r.shard == want[hashlib.md5((r.text or "").encode()).hexdigest()]
            assert r.text_crc32 == zlib.crc32((r.text or "").encode()) and r.size == len((r.text or "").encode()) + 8
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_search_refines_ranges_until_exact(spark, monkeypatch):
    rng = np.random.default_rng(2)
    groups = [(hashlib.md5(str(i).encode()).hexdigest(), int(n)) for i, n in enumerate(rng.pareto(1.5, 9000) * 100 + 8)]
    monkeypatch.setattr(sharding, "MOST_SUMS", 4096)
    table = spark.createDataFrame(groups, "key string, size long")
    begins = sharding.minimax_cuts(table, 7)
    line = sorted(groups)

    def needed(capacity):
        n, held = 1, 0
        for _, s in line:
            n, held = (n + 1, s) if held + s > capacity else (n, held + s)
        return n

    low, high = max(s for _, s in line), sum(s for _, s in line)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if needed(middle) <= 7 else (middle + 1, high)
    sizes = Counter()
    for key, s in line:
        sizes[sum(key >= b for b in begins)] += s
    assert max(sizes.values()) <= low and len(sizes) <= 7


def test_sharding_odd_tables(no_documents, clashing):
    out = sharding.shard_documents(clashing)
    assert out.count() == 14 and len(set(map(str.lower, out.columns))) == len(out.columns)
    assert sharding.shard_documents(no_documents).count() == 0


# --- exact duplicates -------------------------------------------------------


def test_fuse_filter():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 50_000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        built = exact_dedup.build_fuse_filter(keys)
        assert exact_dedup.in_fuse_filter(keys, built).all()
        if n:
            others = rng.integers(0, 2**63, 100_000).astype(np.uint64)
            assert exact_dedup.in_fuse_filter(others, built).mean() < 1e-3


def plain_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        text = r.text or ""
        groups[hashlib.sha256("".join(c for c in text if c not in " \t\n\x0b\x0c\r").encode()).hexdigest()].append((-len(text), math.inf if r.doc_id is None else r.doc_id))
    return groups


def test_exact_duplicates_equal_plain_grouping(documents, odd_documents, clashing, no_documents):
    for table in (documents, odd_documents, clashing):
        rows, groups = table.collect(), plain_groups(table.collect())
        got = exact_dedup.exact_duplicates(table).collect()
        assert Counter((r.doc_id, r.text_sha256) for r in got) == Counter((None if i == math.inf else i, sha) for sha, g in groups.items() for _, i in g)
        for r in got:
            best = min(groups[r.text_sha256])[1]
            assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == (None if best == math.inf else best) and r.kept == (r.doc_id == r.keep_id)
        assert len(rows) == len(got)
    assert exact_dedup.exact_duplicates(no_documents).count() == 0
    assert {r.doc_id for r in exact_dedup.drop_duplicates(odd_documents).collect()} == {2, 6, 7, 8, 9, 11, None, 12}


def test_arriving_batch_against_a_snapshot(spark):
    def texts(rows):
        return exact_dedup.distinct_texts(exact_dedup.digests(spark.createDataFrame(rows, "doc_id long, text string")))

    old, new = texts([(1, "a"), (2, "a"), (3, "b")]), texts([(4, "a "), (5, "c"), (6, "c"), (7, "d")])
    for parts in (1, 3):
        got = {(r.n, r.best.id) for r in exact_dedup.dedup_arriving(new, old, parts=parts).collect()}
        assert got == {(3, 4), (1, 3), (2, 5), (1, 7)}


def test_stored_snapshots(spark, tmp_path):
    """Batches one after the other: each is screened against all snapshots stored before it."""

    def texts(rows):
        return exact_dedup.distinct_texts(exact_dedup.digests(spark.createDataFrame(rows, "doc_id string, text string")))

    batches = [[("a1", "a"), ("b1", "b b"), ("a0", "a")], [], [("b0", "bb"), ("c1", "c"), (None, None)], [("c0", "c "), ("a9", "a"), ("d", "d"), ("e", "")]]
    stored = []
    for k, batch in enumerate(batches[:-1]):
        exact_dedup.save_snapshot(exact_dedup.new_texts(texts(batch), stored), f"{tmp_path}/{k}", parts=2 if k else None)
        stored = [exact_dedup.load_snapshot(spark, f"{tmp_path}/{i}") for i in range(k + 1)]
    assert [s.texts.count() for s in stored] == [2, 0, 2] and [s.parts for s in stored] == [1, 1, 2]
    last = texts(batches[-1])
    assert [r.best.id for r in exact_dedup.new_texts(last, stored).collect()] == ["d"]
    got = {(r.n, r.best.id) for r in exact_dedup.dedup_against(last, stored).collect()}
    assert got == {(3, "a0"), (1, "b1"), (2, "c0"), (2, "e"), (1, "d")}
    with pytest.raises(Exception, match="(?i)exist"):
        exact_dedup.save_snapshot(last, f"{tmp_path}/0")


def test_ids_that_are_strings(spark):
    docs = spark.createDataFrame([("z", "x y"), ("b", "x  y"), ("a", "x  y"), (None, "xy   "), ("q", "other")], "doc_id string, text string")
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(docs.filter("doc_id IS NOT NULL")).collect()}
    assert got == {"z": ("a", 3, False), "b": ("a", 3, False), "a": ("a", 3, True), "q": ("q", 1, True)}
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup.exact_duplicates(docs).collect()} == {("z", None, False), ("b", None, False), ("a", None, False), (None, None, True), ("q", "q", True)}
    assert {r.doc_id for r in exact_dedup.drop_duplicates(docs.filter("doc_id IS NOT NULL")).collect()} == {"a", "q"}


# --- near duplicates --------------------------------------------------------


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Smallest id by distance at most three, over all pairs."""
    prints = {r.text: plain_fingerprint(r.text) for r in rows}
    own = [(r.doc_id, prints[r.text]) for r in rows]
    label = {p: p for _, p in own}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    values = list(label)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                label[root(a)] = root(b)
    ids = defaultdict(list)
    for i, p in own:
        ids[root(p)] += [i] if i is not None else []
    return Counter((i, f"{p:016x}", min(ids[root(p)], default=None)) for i, p in own)


def test_near_duplicates_equal_all_pairs(documents, odd_documents, clashing, no_documents):
    for table in (documents, odd_documents, clashing):
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(table).collect())
        assert got == plain_components(table.collect())
    assert simhash.near_duplicates(no_documents).count() == 0


def test_golay_code_is_perfect_and_keys_meet():
    _, leaders = simhash.golay_tables()
    assert (leaders >= 0).all() and max(int(x).bit_count() for x in leaders) == 3
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    others = prints.copy()
    for n in range(3):  # up to three flips, of any bits
        flip = rng.integers(0, 64, len(prints)).astype(np.uint64)
        others ^= np.where(rng.random(len(prints)) < 0.9, np.uint64(1) << flip, np.uint64(0))
    a, b = simhash.fuzzy_keys(prints), simhash.fuzzy_keys(others)
    left = set(zip(a[0].tolist(), a[1].tolist(), strict=True))
    met = {r for r, k in zip(b[0].tolist(), b[1].tolist(), strict=True) if (r, k) in left}
    assert len(met) == len(prints)


@pytest.mark.parametrize("most", [20_000, 3])
def test_crowded_buckets_keep_all_links(spark, most):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**64, 4, dtype=np.uint64)
    prints = {int(x) for b in base for x in [b ^ (np.uint64(1) << np.uint64(i)) for i in rng.integers(0, 64, 12)]} | set(map(int, base))
    chain = int(rng.integers(0, 2**60))
    for i in range(0, 60, 3):
        prints.add(chain)
        chain ^= 0b111 << i
    values = sorted(prints)
    table = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for r in simhash.links(table, most).collect():
        a, b = r.a % (1 << 64), r.b % (1 << 64)
        assert (a ^ b).bit_count() <= 3
        label[root(a)] = root(b)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                assert root(a) == root(b)


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, n)] + [(1000, 1002), (1002, 1001)], "a long, b long")
    got = {r.node: r.component for r in simhash.connected_components(edges).collect()}
    assert got == {i: 1 for i in range(1, n + 1)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_one_of_each_group_stays(documents, odd_documents):
    for table in (documents, odd_documents):
        components = {c for i, _, c in plain_components(table.collect()) if i is not None}
        kept = [r.doc_id for r in simhash.drop_near_duplicates(table).collect()]
        assert sorted(i for i in kept if i is not None) == sorted(components)


# --- the pipeline -----------------------------------------------------------


def test_pipeline_equals_its_stages(spark, sf_dir):
    got = pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = quality.classify(docs, quality.train(docs, labels)).filter("predicted = 1").select(*docs.columns)
    rows = good.collect()
    first = {c for _, c in plain_near_copies(rows)}  # by the similarity of all pairs
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = [r for r in rows if r.doc_id in first and not any(b in " ".join(r.text.lower().split()) for b in items)]
    assert {r.doc_id for r in got} <= {r.doc_id for r in kept}
    size = Counter()
    for r in kept:
        size[r.source] += len(r.text.encode())
    weights, total = sum(map(math.sqrt, size.values())), sum(size.values())
    want = Counter({r.doc_id: poisson_count(r.doc_id, math.sqrt(size[r.source]) / weights * total / size[r.source]) for r in kept})
    assert Counter(r.doc_id for r in got) == +want
    shards, _ = plain_shards(got, 24)
    assert all(r.shard == shards[hashlib.md5(r.text.encode()).hexdigest()] for r in got)


@pytest.mark.parametrize("share", [1.0, 20.0])
def test_copies_are_no_neighbours_in_a_shard(spark, documents, sf_dir, tmp_path, share):
    sources = sorted({r.source for r in documents.select("source").distinct().collect()})
    weights = dict.fromkeys(sources, 1.0) | {sources[0]: share}
    mixed = mixing.mix_sources(documents, weights).select(*documents.columns)
    mixed.write.parquet(str(tmp_path / "mix"))
    stored = spark.read.parquet(str(tmp_path / "mix"))
    out = pipeline.shard(spark, stored, sf_dir)
    assert out.columns == [*documents.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = out.select("shard", "slot", "doc_id").collect()
    shards = defaultdict(dict)
    for r in rows:
        assert shards[r.shard].setdefault(r.slot, r.doc_id) == r.doc_id
    assert len(rows) == stored.count() == sum(map(len, shards.values()))
    beside, chance, repeats = 0, 0.0, 0
    for own in shards.values():
        ids = [own[i] for i in range(len(own))]
        beside += sum(a == b for a, b in zip(ids, ids[1:]))
        chance += sum(c * (c - 1) for c in Counter(ids).values()) / len(ids)
        repeats += len(ids) - len(set(ids))
    assert repeats > 20 and beside <= chance + 4 * math.sqrt(chance) + 1
    again = pipeline.shard(spark, stored, sf_dir).select("shard", "slot", "doc_id").collect()
    assert sorted(rows) == sorted(again)


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_on_odd_documents(spark, sf_dir, odd_documents, clashing, no_documents, name, stage):
    for table in (odd_documents, clashing):
        out = stage(spark, table, sf_dir)
        added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"] if name == "shard" else []
        assert out.columns == [c for c in table.columns if c.lower() not in added] + added
        assert {(r.doc_id, r.text) for r in out.collect()} <= {(r.doc_id, r.text) for r in odd_documents.collect()}
    assert stage(spark, no_documents, sf_dir).count() == 0


def test_repeated_rows_in_stages(spark, sf_dir, odd_documents):
    """What becomes of nulls and repeats, as the stages' docstrings say."""
    stages = dict(pipeline.STAGES)
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    assert ids(stages["near_dedup"](spark, odd_documents, sf_dir))[10] <= 1 and ids(stages["near_dedup"](spark, odd_documents, sf_dir))[None] == 1
    assert ids(stages["decontaminate"](spark, odd_documents, sf_dir)) == ids(odd_documents)
    assert ids(stages["shard"](spark, odd_documents, sf_dir)) == ids(odd_documents)
    assert ids(stages["mix"](spark, odd_documents, sf_dir))[10] % 2 == 0
    kept = ids(stages["quality"](spark, odd_documents, sf_dir))
    assert kept[10] in (0, 2)


def test_stage_tables_are_cleared(spark, sf_dir, tmp_path, monkeypatch):
    from marketloom.llm import _shared

    monkeypatch.setattr(_shared, "shared_dir", lambda _: str(tmp_path))
    assert pipeline.run(spark, sf_dir).count() > 0
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["mix"]
