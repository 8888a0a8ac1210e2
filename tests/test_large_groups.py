"""Operators whose groups may be larger than a task: the same rows however the tables are cut."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import aggregate, book, evaluate, join, scale, window
from marketloom.sources.tables import number_rows, rank_within, read_table, running


@pytest.fixture
def few_rows_a_partition(spark):
    """Range partitions of some rows each, as on a cluster."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_running_values_across_partitions(spark, few_rows_a_partition):
    r = random.Random(4)
    data = [(r.choice(["x", "x", "x", "y", None]), i, r.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(5)
    got = {row["i"]: row for row in running(df, ["k"], ["i"], sums={"s": "v"}, lasts={"l": "v"}, lags={"b": "v"}).collect()}
    state = {}
    for k, i, v in data:
        total, last, before = state.get(k, (None, None, None))
        total = total if v is None else (total or 0) + v
        last = last if v is None else v
        assert (got[i]["s"], got[i]["l"], got[i]["b"]) == (total, last, before), (k, i)
        state[k] = (total, last, v)


def test_ranks_inside_groups(spark, few_rows_a_partition):
    df = spark.createDataFrame([("x" if i % 4 else None, i) for i in range(100)], "k string, i int").repartition(7)
    got = {r["i"]: (r["n"], r["__group_rows"]) for r in rank_within(df, ["k"], ["i"], "n").collect()}
    assert all(got[i] == ((i // 4, 25) if i % 4 == 0 else (i - i // 4 - 1, 75)) for i in range(100))
    assert [r["n"] for r in number_rows(df, ["i"], "n").orderBy("i").collect()] == list(range(100))


def test_global_difference_over_short_partitions(spark, few_rows_a_partition):
    df = spark.createDataFrame([(i // 3, i % 3, float(i * i)) for i in range(30)], "obs_id long, event_idx long, x double").repartition(4)
    got = {(r["obs_id"] * 3 + r["event_idx"]): r["x_global_diff_5"] for r in window.global_diff(df, "x", 5).collect()}
    assert got == {i: float(i * i - (i - 5) ** 2) if i >= 5 else 0.0 for i in range(30)}


def test_box_table_with_nulls_and_ties(spark, few_rows_a_partition):
    data = [("a", float(x)) for x in [3, 1, 1, 8, 5, 5]] + [("a", None), ("b", 2.0), ("c", None), (None, 4.0)]
    rows = aggregate.box_stats(spark.createDataFrame(data, "g string, x double"), "g", "x").collect()
    got = {r["g"]: tuple(r)[1:] for r in rows}
    assert got == {"a": (1.0, 1.5, 4.0, 5.0, 8.0), "b": (2.0,) * 5, "c": (None,) * 5, None: (4.0,) * 5}


def test_splits_of_one_large_class(spark, few_rows_a_partition):
    df = spark.range(101).withColumn("y", F.lit(1))
    assert scale.stratified_split(df, "id", "y", 0.3).filter("in_test").count() == 30
    folds = scale.kfold(df, "id", "y", 4).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [25, 25, 25, 26]


def test_signed_ranks_with_ties(spark, few_rows_a_partition):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in [(1, 2), (3, 1), (2, 2), (5, 4), (1, 4), (9, 2)]], "a double, b double")
    # sizes 1, 2, 1, 3, 7: ranks 1.5 down, 3 up, 1.5 up, 4 down, 5 up
    assert tuple(evaluate.wilcoxon(df, "a", "b").select("statistic", "n").first()) == (5.5, 5)


def test_correlations_leave_out_missing_pairs(spark):
    r = random.Random(1)
    data = [(float(i) if r.random() > 0.3 else None, i + r.random() if r.random() > 0.3 else float("nan"), 7.0, 1e9 + i) for i in range(300)]
    df = spark.createDataFrame(data, "x double, y double, flat double, high double").repartition(3)
    cols = ["x", "y", "flat", "high"]
    plain, gram = ({(p["i"], p["j"]): p["corr"] for p in f(df, cols).collect()} for f in (aggregate.correlation_pairs, aggregate.gram_pairs))
    assert plain.keys() == gram.keys()
    assert plain[0, 2] is None and gram[0, 2] is None and plain[0, 1] > 0.99
    assert all(plain[k] is None and gram[k] is None or abs(plain[k] - gram[k]) < 1e-9 for k in plain)
    few, many = (aggregate.correlation_prune(df, cols, 0.9, wide_from=n) for n in (60, 1))
    assert few == many == ["y", "high"]


def test_outer_join_keeps_rows_without_key_apart(spark):
    a = spark.createDataFrame([(1, 10), (None, 11)], "id int, x int")
    b = spark.createDataFrame([(1, 20), (None, 21), (None, 22), (2, 23)], "id int, x int")
    got = sorted(map(tuple, join.outer_join_all([a, b], "id").collect()), key=repr)
    assert got == sorted([(1, 10, 20), (None, 11, None), (None, None, 21), (None, None, 22), (2, None, 23)], key=repr)


def brute_triggers(stops, trades):
    last = {}
    for _, i, t, p in sorted(trades, key=lambda x: (x[2], x[1])):
        last[t] = p
    out = {}
    for _, i, side, level, t in stops:
        reached = lambda p: p >= level if side == "buy" else p <= level  # noqa: B023, E731
        before = [last[u] for u in sorted(last) if u <= t]
        later = [u for u in sorted(last) if u > t and reached(last[u])]
        out[i] = t if before and reached(before[-1]) else (later[0] if later else None)
    return out


@pytest.mark.parametrize("block_trades, block_stops", [(4096, 200_000), (5, 3), (1, 1)])
def test_stops_in_blocks_equal_a_plain_search(spark, few_rows_a_partition, block_trades, block_stops):
    r = random.Random(9)
    trades = [(1, 1000 + i, r.randrange(400), 50 + r.randrange(-20, 20) * 0.5) for i in range(120)]
    stops = [(1, i, r.choice(["buy", "sell"]), 50 + r.randrange(-30, 30) * 0.5, r.randrange(-20, 420)) for i in range(80)]
    at = lambda c: F.timestamp_seconds(F.col(c)).cast("timestamp_ntz")
    tape = spark.createDataFrame(trades, "instrument long, id long, t int, price double").withColumn("ts", at("t")).withColumn("side", F.lit("buy"))
    asked = spark.createDataFrame(stops, "instrument long, id long, side string, stop_price double, t int").withColumn("ts", at("t")).withColumn("type", F.lit("stop"))
    found = book.stop_triggers(asked, tape, block_trades=block_trades, block_stops=block_stops)
    got = {r["id"]: r["trigger_ts"] for r in found.collect()}
    want = brute_triggers(stops, trades)
    seconds = lambda ts: None if ts is None else int((ts - __import__("datetime").datetime(1970, 1, 1)).total_seconds())
    assert {i: seconds(ts) for i, ts in got.items()} == want


def test_stops_without_trades(spark):
    asked = spark.createDataFrame([(1, 1, "buy", 5.0, "stop")], "instrument long, id long, side string, stop_price double, type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    tape = spark.createDataFrame([], "instrument long, id long, price double, ts timestamp_ntz")
    row = book.stop_triggers(asked, tape).first()
    assert row["trigger_ts"] is None and row["becomes"] is None


def test_reading_drops_a_leading_index(spark, tmp_path):
    (tmp_path / "x.csv").write_text(",a\n0,5\n1,6\n")
    assert [tuple(r) for r in read_table(spark, str(tmp_path / "x.csv"), "csv", "i int, a int", drop_index=True).collect()] == [(5,), (6,)]


def test_log_copies_of_skewed_columns(spark):
    df = spark.createDataFrame([(x, -x) for x in [0.0, 1.0, 1.0, 1.0, 500.0]], "a double, b double")
    assert aggregate.skew_screen(df, ["a", "b"], 1.0) == ["a", "b"] and aggregate.skew_screen(df, ["a"], 3.0) == []
    assert round(aggregate.log_skewed(df, ["b"]).collect()[-1]["log_b"], 6) == -6.216606


def test_next_known_values_across_partitions(spark, few_rows_a_partition):
    r = random.Random(7)
    data = [(r.choice(["x", "x", "x", "y", None]), i, r.choice([None, None, 1, 2])) for i in range(200)]
    df = spark.createDataFrame(data, "k string, i int, v int").repartition(5)
    got = {row["i"]: (row["n"], row["l"], row["b"]) for row in running(df, ["k"], ["i"], nexts={"n": "v"}, lasts={"l": "v"}, lags={"b": "i"}).collect()}
    coming, want = {}, {}
    for k, i, v in reversed(data):
        coming[k] = coming.get(k) if v is None else v
        want[i] = coming[k]
    assert {i: n for i, (n, _, _) in got.items()} == want
    filled = {row["i"]: row["v"] for row in window.ffill_bfill(df, "k", "i", ["v"]).collect()}
    assert filled == {i: last if last is not None else n for i, (n, last, _) in got.items()}


def test_hours_of_one_zone_across_partitions(spark, few_rows_a_partition):
    r = random.Random(9)
    kept = sorted(r.sample(range(150), 60))
    df = spark.createDataFrame([("z", h, float(h)) for h in kept] + [("w", 3, 1.0)], "zone string, h int, v double").selectExpr("zone", "timestamp'2024-01-01' + make_interval(0, 0, 0, 0, h) AS ts", "h", "v")
    got = {int((row["ts"] - row["ts"].replace(month=1, day=1, hour=0)).total_seconds() // 3600): row["v"] for row in window.resample_hourly_ffill(df, "zone", "ts", "v").filter("zone = 'z'").collect()}
    assert got == {h: float(max(x for x in kept if x <= h)) for h in range(kept[0], kept[-1] + 1)}
    years = window.complete_years(df.withColumn("y", F.lit(1900) + F.col("h")), "zone", "y", "v").filter("zone = 'z'").collect()
    assert {row["y"] - 1900: row["v"] for row in years} == got


def test_curve_of_many_points_across_partitions(spark, few_rows_a_partition):
    import numpy as np

    r = np.random.default_rng(5)
    x = np.sort(r.choice(1000, 80, replace=False)).astype(float)
    y = r.normal(size=80)
    ask = np.concatenate((r.uniform(-50, 1050, 100), x[::9]))
    curve = spark.createDataFrame([("c", float(a), float(b)) for a, b in zip(x, y, strict=True)], "k string, x double, y double").repartition(4)
    points = spark.createDataFrame([("c", float(a), i) for i, a in enumerate(ask)] + [("none", 1.0, 999)], "k string, x double, point_id long")
    got = {row["point_id"]: row["y"] for row in join.interpolate(curve, points, "k", "x", "y").collect()}
    assert got.pop(999) is None
    assert [got[i] for i in range(len(ask))] == pytest.approx(np.interp(ask, x, y).tolist())
