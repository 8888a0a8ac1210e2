"""Hand-made tables: ties, first elements, constant and one-event series, unknown categories, empty book sides."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import clean, features
from marketloom.operators import aggregate, book, evaluate, join, models, pricing, rank, scale, window
from marketloom.plans import datasets
from marketloom.sources import tables
from marketloom.sources.views import VIEWS, view, with_views


@pytest.fixture(scope="module")
def series(spark):
    """Series of 1, 2, 3, 4 and 12 events and a constant one, with nulls."""
    rows = []
    for sid, prices in {1: [5.0], 2: [1.0, 2.0], 3: [1.0, None, 4.0], 4: [1.0, 2.0, 4.0, 8.0], 5: [3.0] * 6, 6: [float(i * i % 7) for i in range(12)]}.items():
        rows += [(sid, i, p, 0.0 if i % 2 else 2.0, 1.0 + i, 10.0 * (i - 1)) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "obs_id long, event_idx long, price double, bid_size double, ask_size double, flux double")


def by(df, *cols):
    return {tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]: r for r in df.collect()}


def test_first_differences_are_zero(series):
    got = by(window.series_diff(series, "price", 1, "d"), "obs_id", "event_idx")
    assert got[1, 0].d == 0 and got[2, 1].d == 1 and got[3, 1].d == 0 and got[4, 3].d == 4
    got = by(window.series_pct_change(series, "bid_size", 1, "r"), "obs_id", "event_idx")
    assert got[2, 1].r == -1 and got[4, 2].r == 0  # from 0: no ratio


def test_rolling_windows_wait_for_enough_values(series):
    got = by(window.rolling_std(series, "price", 3, None, "s"), "obs_id", "event_idx")
    assert got[4, 1].s is None and got[4, 2].s == pytest.approx(math.sqrt(7 / 3)) and got[3, 2].s is None and got[5, 5].s == 0
    assert by(window.rolling_std(series, "price", 3, 1, "s"), "obs_id", "event_idx")[4, 0].s is None  # one value has no deviation


def test_plain_and_conditional_flow(series):
    quotes = series.withColumns({"bid": F.col("price"), "ask": F.lit(1.0)})
    plain, careful = by(window.ofi(quotes), "obs_id", "event_idx"), by(window.ofi_conditional(quotes), "obs_id", "event_idx")
    assert plain[1, 0].ofi == 2.0 - 1.0 and careful[1, 0].ofi_conditional == 0
    assert plain[2, 1].ofi == -2.0 - 1.0 and careful[2, 1].ofi_conditional == -2.0 - 1.0


def test_moments_of_short_and_constant_series(series):
    got = by(aggregate.series_moments(series, ["price"]), "obs_id")
    assert got[1].price_skew == got[2].price_skew == got[5].price_skew == 0 and got[5].price_kurt == got[3].price_kurt == 0
    x = [1.0, 2.0, 4.0, 8.0]
    m = sum(x) / 4
    m2, m3 = (sum((a - m) ** k for a in x) / 4 for k in (2, 3))
    assert got[4].price_skew == pytest.approx(m3 / m2**1.5 * math.sqrt(12) / 2)
    assert by(aggregate.autocorr1(series, "price"), "obs_id")[5].price_autocorr1 == 0


def test_pruning_follows_column_order(spark):
    rows = [(float(i), 2.0 * i, -3.0 * i, 7.0, float(i * i % 5)) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double, z double")
    assert aggregate.correlation_prune(df, ["a", "b", "c", "k", "z"], 0.9) == ["b", "c"]
    assert aggregate.correlation_prune(df, ["k", "c", "b", "a"], 0.9) == ["b", "a"]
    assert aggregate.correlation_prune(df, ["a", "b", "c", "k", "z"], 0.9, wide_from=2) == ["b", "c"]


def test_encoding_of_unknown_categories(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "x string")
    test = spark.createDataFrame([("a",), ("z",), ("b",)], "x string")
    codes = clean.fit_ordinal(train, ["x"])
    assert sorted(r.x for r in clean.apply_ordinal(test, codes, ["x"]).collect()) == [-1, 0, 1]
    with pytest.raises(ValueError):
        clean.apply_ordinal(test, codes, ["x"], "error")


def test_halves_go_to_the_even_tick(spark):
    row = spark.createDataFrame([(100.25, 100.75, 0.3)], "a double, b double, c double").select(*[clean.round_to_tick(F.col(c), 0.5) for c in "abc"]).first()
    assert tuple(row) == (100.0, 101.0, 0.5)


def test_outlier_takes_its_whole_series(spark):
    rows = [(s, i, 0, 10.0 + i % 3) for s in range(20) for i in range(10)]
    rows[25] = (2, 5, 0, 500.0)
    df = spark.createDataFrame(rows, "obs_id long, event_idx long, eqt_code_cat int, price double")
    kept = join.remove_outlier_series(df, "eqt_code_cat", ["price"], 6.0)
    assert {r.obs_id for r in kept.select("obs_id").distinct().collect()} == set(range(20)) - {2}
    assert join.remove_outlier_series(df, "eqt_code_cat", ["price"], 6.0, enabled=False).count() == 200


def test_winner_and_ties(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0, 2.0), (2, 2.0, 2.0, 1.0), (3, None, 1.0, 0.0)], "id long, a double, b double, c double")
    got = by(rank.rank_one_hot(df, ["a", "b", "c"]), "id")
    assert [tuple(got[i])[1:] for i in (1, 2, 3)] == [(1, 0, 0), (0, 0, 0), (0, 1, 0)]
    assert [r.outcome for r in rank.idxmax_label(df, ["a", "b", "c"], {"a": 7, "b": 8, "c": 9}).orderBy("id").collect()] == [7, 7, 8]


def test_best_hours_take_the_earlier_on_ties(spark):
    df = spark.createDataFrame([(f"2024-01-01 {h:02d}:00:00", p) for h, p in enumerate([5.0, 9.0, 9.0, 9.0, 1.0])], "ts string, price double").withColumn("ts", F.to_timestamp("ts"))
    run = {r.ts.hour: r.production for r in rank.top_hours(df, 2, 4.0).collect()}
    assert run == {0: 0, 1: 4.0, 2: 4.0, 3: 0, 4: 0}


def test_threshold_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(x,) for x in (-2.0, -1.0, 0.0, 1.0, 2.0)], "s double")
    assert [(r.home_wins, r.draw, r.away_wins) for r in evaluate.threshold_outcome(df, "s", 1.0).orderBy("s").collect()] == [(0, 0, 1), (0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 0, 0)]
    assert evaluate.calibrate_threshold(df, "s", 0.6).first().alpha == 1.0


def plain_sweep(taker, resting):
    side, limit, left = taker["side"], taker["price"], taker["qty"]
    order = sorted((r for r in resting if r["side"] != side), key=lambda r: (r["price"] if side == "buy" else -r["price"], r["ts"], r["id"]))
    fills = {}
    for r in order:
        if left and (limit is None or (r["price"] <= limit if side == "buy" else r["price"] >= limit)):
            fills[r["id"]] = min(left, r["qty"])
            left -= fills[r["id"]]
    return fills


def test_sweep_equals_taking_orders_one_by_one(spark):
    rng = random.Random(1)
    resting, takers = [], []
    for instrument in range(40):
        for i in range(rng.choice([0, 1, 8])):
            side = rng.choice(["buy", "sell"]) if instrument % 5 else "buy"
            resting.append({"id": 1000 * instrument + i, "instrument": instrument, "side": side, "price": float(rng.randint(90, 99) if side == "buy" else rng.randint(100, 105)), "qty": rng.randint(1, 9), "ts": rng.randint(1, 3)})
        takers.append({"id": 90_000 + instrument, "instrument": instrument, "side": rng.choice(["buy", "sell"]), "price": rng.choice([None, 95.0, 102.0, 99.0]), "qty": rng.randint(1, 30), "tif": rng.choice(["GTC", "IOC", "FOK"]), "post_only": rng.random() < 0.3})
    r = spark.createDataFrame([tuple(x.values()) for x in resting], "id long, instrument long, side string, price double, qty long, ts long")
    t = spark.createDataFrame([tuple(x.values()) for x in takers], "id long, instrument long, side string, price double, qty long, tif string, post_only boolean")
    got, outcome = {}, by(book.sweep(t, r), "id")
    for f in book.sweep_fills(t, r).collect():
        got.setdefault(f.taker_id, {})[f.resting_id] = f.fill
    for taker in takers:
        own = [x for x in resting if x["instrument"] == taker["instrument"]]
        fills = plain_sweep(taker, own)
        total = sum(fills.values())
        blocked = (taker["post_only"] and total > 0) or (taker["tif"] == "FOK" and total < taker["qty"])
        assert got.get(taker["id"], {}) == ({} if blocked else fills)
        o = outcome[taker["id"]]
        assert o.filled_qty == (0 if blocked else total) and o.filled_qty + o.remainder == taker["qty"]
        assert (o.status in ("rejected", "killed")) == blocked
    crowd = t.unionByName(t.filter("instrument = 3").withColumn("id", F.lit(1).cast("long")))
    for taken in (book.sweep, book.sweep_fills):
        with pytest.raises(ValueError, match="2 takers of instrument 3"):
            taken(crowd, r)


def test_uncross_fills_until_prices_no_longer_meet(spark):
    rng = random.Random(4)
    rows = [(i, i % 9, rng.choice(["buy", "sell"]) if i % 9 else "buy", float(rng.randint(95, 105)), rng.randint(1, 9), rng.randint(1, 3)) for i in range(200)]
    trades = book.uncross(spark.createDataFrame(rows, "id long, instrument long, side string, price double, qty long, ts long")).collect()
    for instrument in range(9):
        own = [r for r in rows if r[1] == instrument]
        bids, asks = sorted(([*r] for r in own if r[2] == "buy"), key=lambda r: (-r[3], r[5], r[0])), sorted(([*r] for r in own if r[2] == "sell"), key=lambda r: (r[3], r[5], r[0]))
        want = []
        while bids and asks and bids[0][3] >= asks[0][3]:
            v = min(bids[0][4], asks[0][4])
            want.append((bids[0][0], asks[0][0], v, (bids[0][3] + asks[0][3]) / 2, "buy" if bids[0][4] >= asks[0][4] else "sell"))
            for side in (bids, asks):
                side[0][4] -= v
                if not side[0][4]:
                    side.pop(0)
        assert sorted((t.buy_id, t.sell_id, t.volume, t.price, t.initiator) for t in trades if t.instrument == instrument) == sorted(want)


def test_first_at_least():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 100):
        x = rng.integers(0, 50, n).astype(float)
        begin, level = rng.integers(0, n, 200), rng.integers(0, 55, 200).astype(float)
        want = [next((i for i in range(b, n) if x[i] >= v), -1) for b, v in zip(begin, level, strict=True)]
        assert book._first_at_least(book._extremes(x), begin, level).tolist() == want


def test_normal_distribution_function(spark):
    xs = [x / 10 for x in range(-400, 401, 7)] + [0.0, 7.07, 7.08, -7.08]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", pricing.norm_cdf(F.col("x")).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.x / math.sqrt(2)), abs=1e-12)


def test_parity_and_greeks_by_differences(spark):
    cases = [(s, 100.0, t, 0.03, v, kind) for s, t, v, kind in itertools.product([60.0, 100.0, 170.0], [0.25, 2.0], [0.1, 0.5], ["call", "put"])]
    schema = "s double, k double, t double, r double, sigma double, option_type string"

    def price(rows):
        return [r.price for r in pricing.black_scholes(spark.createDataFrame(rows, schema).coalesce(1)).collect()]

    base = price(cases)
    for (s, k, t, r, _, kind), a, b in zip(cases, base, base[1:] + base[:1], strict=True):
        if kind == "call":
            assert a - b == pytest.approx(s - k * math.exp(-r * t), abs=1e-9)
    greeks = pricing.greeks(spark.createDataFrame(cases, schema).coalesce(1)).collect()
    for name, at, h in (("delta", 0, 1e-4), ("vega", 4, 1e-5), ("rho", 3, 1e-5)):
        up, down = (price([(*c[:at], c[at] + d, *c[at + 1 :]) for c in cases]) for d in (h, -h))
        for g, a, b in zip(greeks, up, down, strict=True):
            assert g[name] == pytest.approx((a - b) / (2 * h), abs=2e-4)


def test_barrier_is_strict(spark):
    paths = spark.createDataFrame([(1, 1, 100.0), (1, 2, 120.0), (1, 3, 110.0), (2, 1, 120.1), (2, 2, 110.0)], "sim_id long, step int, price double")
    assert {r.sim_id: r.payoff for r in pricing.barrier_payoff(paths, 100, 120).collect()} == {1: 10.0, 2: 0.0}


def test_paths_have_the_right_mean_and_repeat(spark):
    c = spark.createDataFrame([(1, 100.0, 1.0, 0.05, 0.2)], "contract_id long, s double, t double, r double, sigma double")
    a = pricing.gbm_paths(c, 20_000, 20)
    mean = a.agg(F.avg("last")).first()[0]
    assert mean == pytest.approx(100 * math.exp(0.05), rel=0.01) and pricing.gbm_paths(c.repartition(3), 20_000, 20).agg(F.avg("last")).first()[0] == pytest.approx(mean)
    signs = pricing.gbm_paths(c.unionByName(c.withColumn("contract_id", -F.col("contract_id"))), 50, 20)
    assert signs.select("last").distinct().count() == 100


def test_global_order_without_one_task(spark):
    rows = [(s, i, float(s * 100 + i * i)) for s in range(30) for i in range(1 + s % 4)]
    df = spark.createDataFrame(rows, "obs_id long, event_idx long, price double").repartition(5)
    for k in (1, 3):
        got = by(window.global_diff(df, "price", k), "obs_id", "event_idx")
        line = sorted(rows)
        for i, (s, e, p) in enumerate(line):
            # a look-up reaches back into the previous series only
            before = next((line[i - k][2] for _ in [0] if i >= k and line[i - k][0] >= s - 1 - k), None)
            assert got[s, e][f"price_global_diff_{k}"] == (p - before if before is not None else 0)
    assert [r.n for r in tables.number_rows(df, ["obs_id", "event_idx"], "n", 4).orderBy("obs_id", "event_idx").collect()] == list(range(len(rows)))


def test_scaling_uses_train_statistics_only(spark):
    train, test = (spark.createDataFrame([(x, 4.0) for x in xs], "a double, b double") for xs in ([0.0, 2.0, 4.0], [100.0]))
    z = scale.zscore_train(train, test, ["a", "b"]).first()
    assert z.a == 10.0 and z.b == 0.0
    assert scale.standard_scale(train, test, ["a", "b"])[1].first().a == pytest.approx(98 / math.sqrt(8 / 3))
    assert scale.minmax_zscore(train, test, ["a", "b"])[1].first().a == pytest.approx(49.0)
    assert scale.group_minmax(train, test, [["a", "b"]])[1].first().b == 1.0


def test_splits_keep_whole_keys_and_even_folds(spark):
    df = spark.range(103).select(F.col("id").alias("key"), (F.col("id") % 3).alias("label"))
    folds = scale.kfold(df, "key", "label", 5).groupBy("label", "fold").count().collect()
    for label in range(3):
        sizes = [r["count"] for r in folds if r.label == label]
        assert max(sizes) - min(sizes) <= 1
    split = scale.hash_split(df.union(df), "key", {"a": 0.5, "b": 0.5})
    assert split.groupBy("key").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_sequences_are_padded(series):
    got = by(scale.to_sequences(series, ["price", "flux"], 5), "obs_id")
    assert got[1].sequence == [[5.0, -10.0]] + [[0.0, 0.0]] * 4 and len(got[6].sequence) == 5 and got[4].sequence[3] == [8.0, 20.0]


def test_filling_and_hours(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", None), ("a", "2024-01-01 01:00:00", 2.0), ("a", "2024-01-01 06:00:00", 4.0), ("b", "2024-01-01 03:00:00", 1.0)], "zone string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    got = [(r.zone, r.ts.hour, r.value) for r in window.resample_hourly_ffill(df, "zone", "ts", "value").orderBy("zone", "ts").collect()]
    assert got == [("a", 0, None), *[("a", h, 2.0) for h in range(1, 6)], ("a", 6, 4.0), ("b", 3, 1.0)]
    assert by(window.ffill_bfill(df, "zone", "ts", ["value"]), "zone", "value")


def test_interpolation_holds_the_ends(spark):
    curve = spark.createDataFrame([("k", 1.0, 10.0), ("k", 3.0, 30.0)], "k string, x double, y double")
    points = spark.createDataFrame([("k", i, x) for i, x in enumerate([0.0, 1.0, 2.5, 3.0, 9.0])], "k string, point_id long, x double")
    assert [r.y for r in join.interpolate(curve, points, "k", "x", "y").orderBy("point_id").collect()] == [10.0, 10.0, 25.0, 30.0, 30.0]


def test_early_stop(spark):
    rows = [(1, e, x) for e, x in enumerate([5.0, 4.0, 4.5, 4.2, 3.0, 1.0])] + [(2, 0, 1.0)]
    got = by(evaluate.early_stop(spark.createDataFrame(rows, "run long, epoch long, loss double"), 2), "run")
    assert tuple(got[1]) == (1, 1, 4.0, 3) and tuple(got[2]) == (2, 0, 1.0, None)


def test_forest_beats_the_constant(spark, sf_dir):
    df = view(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("embedding")[0] > F.col("embedding")[1]).cast("int").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)])
    cols = [f"e{i}" for i in range(4)]
    model = models.fit_forest(df.filter("id % 4 > 0"), cols, "y", trees=20)
    scored = model.transform(df.filter("id % 4 = 0")).withColumn("p", F.col("prediction").cast("int"))
    assert evaluate.accuracy(scored).first().accuracy > 0.7
    assert models.importances(model, spark, cols).agg(F.sum("importance")).first()[0] == pytest.approx(1.0)


def test_results_do_not_depend_on_partitioning(spark, sf_dir):
    flow = view(spark, sf_dir, "order_flow")
    a, _ = datasets.build_features(flow)
    b, _ = datasets.build_features(flow.repartition(13, "event_id"))
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_presets_and_switches(spark, sf_dir):
    flow = view(spark, sf_dir, "order_flow")
    _, full = datasets.build_features(flow)
    _, least = datasets.build_features(flow, "super_reduced", momentum=True)
    assert set(least) < set(full) and "momentum_5" in least and "ofi_conditional" not in least
    _, pruned = datasets.build_features(flow, corr_threshold=0.5)
    assert len(pruned) < len(full)


def test_views_read_the_same_on_both_engines():
    assert all(with_views(f"SELECT * FROM {n}").count("SELECT") > 1 for n in VIEWS)


def test_calendar(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-06 20:00:00' AS ts UNION ALL SELECT TIMESTAMP '2024-07-01 08:00:00'")
    got = [(r.dayofweek, r.is_weekend, r.winter, r.summer, r.off_peak) for r in features.season_flags(features.time_features(df, "ts"), "ts").orderBy("ts").collect()]
    assert got == [(5, 1, 1, 0, 1), (0, 0, 0, 1, 0)]


def test_all_features_share_one_exchange(spark, sf_dir):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = view(spark, sf_dir, "order_flow")
        plan, screened = (datasets.build_features(rows, log_skewed=on)[0]._jdf.queryExecution().executedPlan().toString() for on in (False, True))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count(" Exchange ") == 1
    # the skew screen has had the windows written: nothing is computed again
    assert screened.count(" Exchange ") == 0 and "Window" not in screened
    # columns that no feature needs stay in the file
    assert "props" not in plan
