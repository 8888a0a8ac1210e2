"""Queries over aggregates, joins, scaling, splits and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F


from marketloom.operators import aggregate, join, rank, scale, wide_pca, window
from marketloom.plans.registry import Views, query

K = ("obs_id", "event_idx")


# --- aggregates -------------------------------------------------------------


@query("e1_summarize_series", "SELECT obs_id, avg(price) AS price_mean, stddev_samp(price) AS price_std, min(price) AS price_min, max(price) AS price_max, avg(flux) AS flux_mean, sum(flux) AS flux_sum FROM order_flow GROUP BY obs_id", "price_mean price_std price_min price_max flux_mean flux_sum")
def e1(v: Views):
    return aggregate.summarize_series(v("order_flow"), {"price": ["mean", "std", "min", "max"], "flux": ["mean", "sum"]})


@query("e2_series_moments", "SELECT obs_id, coalesce(skewness(price), 0) AS price_skew, coalesce(kurtosis(price), 0) AS price_kurt, coalesce(skewness(flux), 0) AS flux_skew, coalesce(kurtosis(flux), 0) AS flux_kurt FROM order_flow GROUP BY obs_id", "price_skew price_kurt flux_skew flux_kurt", )
def e2(v: Views):
    return aggregate.series_moments(v("order_flow"), ["price", "flux"])


_ACTIONS = ("click", "purchase", "view")


@query("e3_category_shares", "SELECT obs_id, " + ", ".join(f"avg((venue = {i})::INT) AS venue_{i}" for i in range(6)) + ", avg((side = 'A')::INT) AS side_A, avg((side = 'B')::INT) AS side_B FROM order_flow GROUP BY obs_id", " ".join(f"venue_{i}" for i in range(6)) + " side_A side_B")
def e3(v: Views):
    return aggregate.category_shares(v("order_flow"), {"venue": list(range(6)), "side": ["A", "B"]})


@query("e4_sequence_aggregates", "SELECT obs_id, arg_max(price, event_idx) AS price_last, quantile_cont(price, 0.5) AS price_median, quantile_cont(price, 0.25) AS price_q25, quantile_cont(price, 0.75) AS price_q75, stddev_pop(price) AS price_std_pop FROM order_flow GROUP BY obs_id", "price_last price_median price_q25 price_q75 price_std_pop")
def e4(v: Views):
    return aggregate.sequence_aggregates(v("order_flow"), ["price"])


@query("e5_autocorr1", "SELECT obs_id, coalesce(corr(price, y), 0) AS price_autocorr1 FROM (SELECT *, lag(price) OVER (PARTITION BY obs_id ORDER BY event_idx) AS y FROM order_flow) GROUP BY obs_id", "price_autocorr1")
def e5(v: Views):
    return aggregate.autocorr1(v("order_flow"), "price")


def _labelled(v: Views):
    return join.with_labels(v("order_flow"), v("series_label"))


_LABELLED = "(SELECT * FROM order_flow JOIN series_label USING (obs_id))"


@query("e6_class_stats", f"SELECT eqt_code_cat, avg(price) AS price_mean, stddev_samp(price) AS price_std, avg(bid_size) AS bid_size_mean, stddev_samp(bid_size) AS bid_size_std FROM {_LABELLED} GROUP BY eqt_code_cat", "price_mean price_std bid_size_mean bid_size_std")
def e6(v: Views):
    return aggregate.class_stats(_labelled(v), "eqt_code_cat", ["price", "bid_size"])


@query("e7_class_balance", "SELECT eqt_code_cat, count(*) AS n, count(*) / (SELECT count(*) FROM series_label) AS share FROM series_label GROUP BY eqt_code_cat", "share")
def e7(v: Views):
    return aggregate.class_balance(v("series_label"), "eqt_code_cat")


@query("e8_mean_by_time", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, zone, avg(value) AS value FROM zone_series GROUP BY ALL", "value")
def e8(v: Views):
    return aggregate.mean_by_time(v("zone_series"), "ts", "zone", "value").select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "zone", "value")


@query("e9_pivot_wide", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, " + ", ".join(f"avg(value) FILTER (zone = '{z}') AS spot_{z}" for z in _ACTIONS) + " FROM zone_series GROUP BY 1", " ".join(f"spot_{z}" for z in _ACTIONS))
def e9(v: Views):
    means = aggregate.mean_by_time(v("zone_series"), "ts", "zone", "value")
    wide = aggregate.pivot_wide(means, "ts", "zone", "value", "spot_", list(_ACTIONS))
    return wide.select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), *[f"spot_{z}" for z in _ACTIONS])


@query("e10_drift_volatility", """WITH r AS (SELECT instrument, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY day)) AS x FROM daily_close)
SELECT instrument, avg(x) * 252 AS mu, stddev_samp(x) * sqrt(252) AS sigma, avg(x) * 252 - power(stddev_samp(x) * sqrt(252), 2) / 2 AS adjusted_drift FROM r WHERE x IS NOT NULL GROUP BY instrument""", "mu sigma adjusted_drift")
def e10(v: Views):
    return aggregate.drift_volatility(window.log_returns(v("daily_close"), "instrument", "day", "close"), "instrument")


_COLS = ["price", "bid", "ask", "bid_size", "ask_size", "flux"]
_PAIRS = " UNION ALL ".join(f"SELECT {i}::INT AS i, {j}::INT AS j, '{_COLS[i]}' AS left_col, '{_COLS[j]}' AS right_col, abs(corr({_COLS[i]}, {_COLS[j]})) AS corr FROM order_flow" for i in range(6) for j in range(i + 1, 6))


@query("e11_correlation_pairs", _PAIRS, "corr")
def e11(v: Views):
    return aggregate.correlation_pairs(v("order_flow"), _COLS)


@query("e11_gram_pairs", _PAIRS, "corr")
def e11_gram(v: Views):
    return aggregate.gram_pairs(v("order_flow"), _COLS)


_GAPPY = "(SELECT CASE WHEN event_id % 5 > 0 THEN price END AS price, bid, CASE WHEN event_id % 3 > 0 THEN ask END AS ask, CASE WHEN event_id % 7 > 1 THEN bid_size END AS bid_size, ask_size, CASE WHEN event_id % 11 > 0 THEN flux END AS flux FROM order_flow)"


def _gappy(v: Views):
    holes = {"price": "event_id % 5 > 0", "ask": "event_id % 3 > 0", "bid_size": "event_id % 7 > 1", "flux": "event_id % 11 > 0"}
    return v("order_flow").withColumns({c: F.when(F.expr(x), F.col(c)) for c, x in holes.items()})


@query("e11_pairs_with_nulls", _PAIRS.replace("order_flow", f"{_GAPPY} g"), "corr")
def e11_nulls(v: Views):
    return aggregate.correlation_pairs(_gappy(v), _COLS)


@query("e11_gram_with_nulls", _PAIRS.replace("order_flow", f"{_GAPPY} g"), "corr")
def e11_gram_nulls(v: Views):
    return aggregate.gram_pairs(_gappy(v), _COLS)


@query("e12_correlation_prune", f"SELECT DISTINCT right_col AS dropped FROM ({_PAIRS}) WHERE corr > 0.9")
def e12(v: Views):
    dropped = aggregate.correlation_prune(v("order_flow"), _COLS, 0.9)
    return v.spark.createDataFrame([(c,) for c in dropped], "dropped string")


@query("e13_skew_screen", "SELECT c AS screened FROM (SELECT 'price' AS c, skewness(price) AS s FROM order_flow UNION ALL SELECT 'flux', skewness(flux) FROM order_flow UNION ALL SELECT 'bid_size', skewness(bid_size) FROM order_flow) WHERE abs(s) > 0.5")
def e13(v: Views):
    return v.spark.createDataFrame([(c,) for c in aggregate.skew_screen(v("order_flow"), ["price", "flux", "bid_size"], 0.5)], "screened string")


@query("e14_histogram", "SELECT least(19, floor((price - lo) / (hi - lo) * 20))::INT AS bin, count(*) AS n FROM order_flow, (SELECT min(price) AS lo, max(price) AS hi FROM order_flow) GROUP BY 1")
def e14(v: Views):
    return aggregate.histogram(v("order_flow"), "price", 20)


@query("e15_box_stats", f"SELECT eqt_code_cat, min(price) AS min, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, quantile_cont(price, 0.75) AS q3, max(price) AS max FROM {_LABELLED} GROUP BY eqt_code_cat", "min q1 median q3 max")
def e15(v: Views):
    return aggregate.box_stats(_labelled(v), "eqt_code_cat", "price")


# --- joins ------------------------------------------------------------------


@query("f1_with_labels", f"SELECT obs_id, event_idx, eqt_code_cat FROM {_LABELLED}")
def f1(v: Views):
    return _labelled(v).select(*K, "eqt_code_cat")


@query("f2_remove_outlier_series", f"""WITH x AS (SELECT * FROM {_LABELLED}), s AS (SELECT eqt_code_cat, avg(price) AS m, stddev_samp(price) AS d, avg(flux) AS m2, stddev_samp(flux) AS d2 FROM x GROUP BY eqt_code_cat),
bad AS (SELECT DISTINCT obs_id FROM x JOIN s USING (eqt_code_cat) WHERE abs(price - m) > 4 * d OR abs(flux - m2) > 4 * d2)
SELECT obs_id, event_idx FROM x WHERE obs_id NOT IN (SELECT obs_id FROM bad)""")
def f2(v: Views):
    return join.remove_outlier_series(_labelled(v), "eqt_code_cat", ["price", "flux"], 4.0).select(*K)


@query("f3_outer_join_all", """SELECT id, h.shots AS h_shots, a.shots AS a_shots, n_lines FROM (SELECT id, shots FROM home_stats) h FULL JOIN (SELECT id, shots FROM away_stats) a USING (id)
FULL JOIN (SELECT l_orderkey AS id, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) n USING (id)""", "h_shots a_shots")
def f3(v: Views):
    lines = v("lineitem").filter("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("n_lines"))
    return join.outer_join_all([v("home_stats").select("id", F.col("shots").alias("h_shots")), v("away_stats").select("id", F.col("shots").alias("a_shots")), lines], "id")


_KEYED = "(SELECT CASE WHEN {c} % 10 > 0 THEN {c} END AS id, {x} AS {n} FROM {t})"
_A, _B = _KEYED.format(c="c_custkey", x="c_acctbal", n="balance", t="customer"), _KEYED.format(c="s_suppkey", x="s_acctbal", n="balance", t="supplier")


@query("f3_null_keys", f"SELECT coalesce(a.id, b.id) AS id, a.balance AS balance, b.balance AS balance_1 FROM {_A} a FULL JOIN {_B} b ON a.id = b.id", "balance balance_1")
def f3_nulls(v: Views):
    keyed = lambda t, c, x: v(t).select(F.when(F.col(c) % 10 > 0, F.col(c)).alias("id"), F.col(x).alias("balance"))
    return join.outer_join_all([keyed("customer", "c_custkey", "c_acctbal"), keyed("supplier", "s_suppkey", "s_acctbal")], "id")


@query("f4_join_sides", "SELECT h.id, h.shots AS HOME_shots, h.poss AS HOME_poss, a.shots AS AWAY_shots, a.poss AS AWAY_poss FROM home_stats h JOIN away_stats a ON h.id = a.id", "HOME_shots HOME_poss AWAY_shots AWAY_poss")
def f4(v: Views):
    return join.join_sides(v("home_stats"), v("away_stats"))


@query("f5_align_labels", "SELECT id, home_wins::INT AS home_wins FROM match_score WHERE id IN (SELECT id FROM home_stats WHERE shots > 40)")
def f5(v: Views):
    return join.align_labels(v("match_score").select("id", F.col("home_wins").cast("int").alias("home_wins")), v("home_stats").filter("shots > 40"))


@query("f6_intersect_prices", "SELECT instrument, round(price, 2) AS price FROM book_orders WHERE side = 'buy' INTERSECT SELECT instrument, round(price, 2) FROM book_orders WHERE side = 'sell'", "price")
def f6(v: Views):
    o = v("book_orders")
    return join.intersect_prices(o.filter("side = 'buy'"), o.filter("side = 'sell'"), ["instrument"])


@query("f7_interpolate", """WITH curve AS (SELECT order_id AS k, bid_size AS x, avg(price) AS y FROM order_flow WHERE event_id % 3 = 0 GROUP BY 1, 2),
q AS (SELECT event_id AS point_id, order_id AS k, ask_size * 1.7 - 3 AS x FROM order_flow WHERE event_id % 3 = 1)
SELECT k, point_id, x, CASE WHEN a IS NULL THEN b.y WHEN b IS NULL THEN a.y ELSE a.y + (b.y - a.y) * coalesce((x - a.x) / nullif(b.x - a.x, 0), 0) END AS y
FROM (SELECT q.*, (SELECT arg_max({x: c.x, y: c.y}, c.x) FROM curve c WHERE c.k = q.k AND c.x <= q.x) AS a, (SELECT arg_min({x: c.x, y: c.y}, c.x) FROM curve c WHERE c.k = q.k AND c.x >= q.x) AS b FROM q)""", "x y")
def f7(v: Views):
    flow = v("order_flow")
    curve = flow.filter("event_id % 3 = 0").groupBy(F.col("order_id").alias("k"), F.col("bid_size").alias("x")).agg(F.avg("price").alias("y"))
    points = flow.filter("event_id % 3 = 1").select(F.col("event_id").alias("point_id"), F.col("order_id").alias("k"), (F.col("ask_size") * F.lit(1.7) - 3).alias("x"))
    return join.interpolate(curve, points, "k", "x", "y")


# --- scaling and splits -----------------------------------------------------

_TRAIN = "event_id % 4 > 0"


def _parts(v: Views):
    df = v("order_flow").select("event_id", "price", "bid_size", "ask_size")
    return df.filter(_TRAIN), df.filter(f"NOT ({_TRAIN})")


def _stat(f: str, c: str) -> str:
    return f"(SELECT {f}({c}) FROM order_flow WHERE {_TRAIN})"


@query("g1_zscore_train", f"SELECT event_id, greatest(-1.5, least(1.5, (price - {_stat('avg', 'price')}) / {_stat('stddev_samp', 'price')})) AS price FROM order_flow", "price")
def g1(v: Views):
    train, test = _parts(v)
    return scale.zscore_train(train, train.unionByName(test), ["price"], 1.5).select("event_id", "price")


@query("g2_minmax_zscore", f"SELECT event_id, (price - {_stat('avg', 'price')}) / {_stat('stddev_samp', 'price')} AS price FROM order_flow WHERE NOT ({_TRAIN})", "price")
def g2(v: Views):
    return scale.minmax_zscore(*_parts(v), ["price"])[1].select("event_id", "price")


_LO, _HI = (f"{f}({_stat(a, 'bid_size')}, {_stat(a, 'ask_size')})" for f, a in (("least", "min"), ("greatest", "max")))


@query("g3_group_minmax", f"SELECT event_id, (bid_size - {_LO}) / ({_HI} - {_LO}) AS bid_size, (ask_size - {_LO}) / ({_HI} - {_LO}) AS ask_size FROM order_flow WHERE NOT ({_TRAIN})", "bid_size ask_size")
def g3(v: Views):
    return scale.group_minmax(*_parts(v), [["bid_size", "ask_size"]])[1].select("event_id", "bid_size", "ask_size")


@query("g4_standard_scale", f"SELECT event_id, (price - {_stat('avg', 'price')}) / {_stat('stddev_pop', 'price')} AS price FROM order_flow WHERE NOT ({_TRAIN})", "price")
def g4(v: Views):
    return scale.standard_scale(*_parts(v), ["price"])[1].select("event_id", "price")


@query("g5_pca_variance")
def g5(v: Views):
    df = v("embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return scale.pca_variance(df, [f"e{i}" for i in range(64)], 0.97)


@query("g5_wide_pca")
def g5_wide(v: Views):
    return wide_pca.wide_pca_variance(v("embeddings"), "embedding", 0.97)


@query("g6_sequences", """WITH x AS (SELECT obs_id, count(*) AS n, list([round(price, 6), bid_size] ORDER BY event_idx) AS s FROM order_flow WHERE event_idx < 60 GROUP BY obs_id)
SELECT obs_id, list_concat(s, list_transform(range(60 - n), lambda i: [0.0::DOUBLE, 0.0::DOUBLE])) AS sequence FROM x""")
def g6(v: Views):
    return scale.to_sequences(v("order_flow").withColumn("price", F.round("price", 6)), ["price", "bid_size"], 60)


@query("g7_time_split", "SELECT event_id, ts <= TIMESTAMP '2024-01-20 00:00:00' AS in_train FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
def g7(v: Views):
    train, test = scale.time_split(scale.date_slice(v("events"), "ts", "2024-01-05 00:00:00", "2024-01-25 00:00:00"), "ts", "2024-01-20 00:00:00")
    return train.select("event_id", F.lit(True).alias("in_train")).unionByName(test.select("event_id", F.lit(False).alias("in_train")))


_U = "('0x' || substr(md5('42:' || obs_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query("g8_hash_split", f"SELECT event_id, CASE WHEN {_U} < 0.64 THEN 'train' WHEN {_U} < 0.8 THEN 'valid' ELSE 'test' END AS split FROM order_flow")
def g8(v: Views):
    return scale.hash_split(v("order_flow"), "obs_id", {"train": 0.64, "valid": 0.16, "test": 0.2}).select("event_id", "split")


_RANK = "row_number() OVER (PARTITION BY eqt_code_cat ORDER BY md5('42:' || obs_id), obs_id)"


@query("g9_stratified_split", f"SELECT obs_id, eqt_code_cat, {_RANK} <= floor(count(*) OVER (PARTITION BY eqt_code_cat) * 0.2::DOUBLE) AS in_test FROM series_label")
def g9(v: Views):
    return scale.stratified_split(v("series_label"), "obs_id", "eqt_code_cat", 0.2)


@query("g10_kfold", f"SELECT obs_id, eqt_code_cat, (({_RANK} - 1) % 5)::INT AS fold FROM series_label")
def g10(v: Views):
    return scale.kfold(v("series_label"), "obs_id", "eqt_code_cat", 5)


_FIRST, _STEPS = scale.poisson_steps(1.0)
_DRAWN = f"list_filter([{', '.join(f'{p!r}::DOUBLE' for p in _STEPS)}], lambda p: p <= ('0x' || substr(md5('42:' || id || '/' || estimator), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("g11_bootstrap", f"SELECT * FROM (SELECT id, y, p, estimator::INT AS estimator, ({_FIRST} + len({_DRAWN}))::INT AS weight FROM pred, range(5) e(estimator)) w WHERE weight > 0")
def g11(v: Views):
    return scale.bootstrap(v("pred"), 5)


# --- ranking ----------------------------------------------------------------

_HOURS = "(SELECT strftime(ts, '%Y-%m-%d') AS day, ts, avg(value) AS price FROM zone_series WHERE zone = 'view' GROUP BY ts)"


def _hours(v: Views):
    return v("zone_series").filter("zone = 'view'").groupBy("ts").agg(F.avg("value").alias("price"))


@query("h1_top_hours", f"SELECT strftime(ts, '%Y-%m-%d %H') AS hour, CASE WHEN row_number() OVER (PARTITION BY day ORDER BY price DESC, ts) <= 2 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS production FROM {_HOURS}")
def h1(v: Views):
    return rank.top_hours(_hours(v), 2, 50.0).select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "production")


@query("h2_dispatch_summary", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY price DESC, ts) AS n FROM {_HOURS}), d AS (SELECT day, avg(price) AS p, count(*) * 50.0 AS e FROM r WHERE n <= 2 GROUP BY day)
SELECT sum(e) AS energy_limited, avg(p) AS price_limited, (SELECT count(*) * 50.0 FROM r) AS energy_unlimited, (SELECT avg(price) FROM r) AS price_unlimited FROM d""", "energy_limited price_limited energy_unlimited price_unlimited")
def h2(v: Views):
    return rank.dispatch_summary(_hours(v), 2, 50.0)


_MATCH = "(SELECT h.id, h.shots AS a, w.shots AS b, (h.shots + w.shots) / 2 AS c FROM home_stats h JOIN away_stats w ON h.id = w.id)"


def _match(v: Views):
    joined = join.join_sides(v("home_stats"), v("away_stats"))
    return joined.select("id", F.col("HOME_shots").alias("a"), F.col("AWAY_shots").alias("b"), ((F.col("HOME_shots") + F.col("AWAY_shots")) / 2).alias("c"))


@query("h3_rank_one_hot", f"WITH x AS (SELECT *, greatest(a, b, c) AS m, (a = greatest(a, b, c))::INT + (b = greatest(a, b, c))::INT + (c = greatest(a, b, c))::INT AS n FROM {_MATCH}) SELECT id, (n = 1 AND a = m)::INT AS a, (n = 1 AND b = m)::INT AS b, (n = 1 AND c = m)::INT AS c FROM x")
def h3(v: Views):
    return rank.rank_one_hot(_match(v), ["a", "b", "c"])


@query("h3_two_class", f"SELECT id, (a > b)::INT AS a, (b > a)::INT AS b, 0 AS c FROM {_MATCH}")
def h3_two(v: Views):
    return rank.rank_one_hot(_match(v), ["a", "b", "c"], "c")


@query("h4_idxmax_label", "SELECT id, CASE WHEN home_wins = 1 THEN 0 WHEN draw = 1 THEN 1 ELSE 2 END AS outcome FROM match_score")
def h4(v: Views):
    return rank.idxmax_label(v("match_score"), ["home_wins", "draw", "away_wins"], {"home_wins": 0, "draw": 1, "away_wins": 2}).select("id", "outcome")


_IMPORTANCE = "(SELECT event_type || CASE event_id % 4 WHEN 0 THEN '_mean' WHEN 1 THEN '_std' WHEN 2 THEN '_max' ELSE '_10' END AS feature, sum(value) AS importance FROM events GROUP BY 1)"


@query("h5_rank_importance", f"""WITH g AS (SELECT regexp_replace(feature, '(_mean|_std|_min|_max|_[0-9]+)+$', '') AS root, sum(importance) AS total, max(importance) AS largest FROM {_IMPORTANCE} GROUP BY 1)
SELECT root, total, largest, row_number() OVER (ORDER BY largest DESC, root)::INT AS rank FROM g""", "total largest", 4)
def h5(v: Views):
    suffix = F.when(F.col("event_id") % 4 == 0, "_mean").when(F.col("event_id") % 4 == 1, "_std").when(F.col("event_id") % 4 == 2, "_max").otherwise("_10")
    return rank.rank_importance(v("events").groupBy(F.concat("event_type", suffix).alias("feature")).agg(F.sum("value").alias("importance")))


@query("h6_latest", "SELECT instrument, arg_max(close, day) AS close, strftime(max(day), '%Y-%m-%d') AS day FROM daily_close GROUP BY instrument", "close")
def h6(v: Views):
    return rank.latest(v("daily_close"), "instrument", "day", "close").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("h7_best_by", "WITH s AS (SELECT venue, order_id, avg(price) AS score FROM order_flow GROUP BY ALL) SELECT venue, arg_max(order_id, {s: score, o: -order_id}) AS order_id, max(score) AS score FROM s GROUP BY venue", "score")
def h7(v: Views):
    scores = v("order_flow").groupBy("venue", "order_id").agg(F.avg("price").alias("score"))
    return rank.best_by(scores, "venue", "order_id", "score")


