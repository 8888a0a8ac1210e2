"""Queries over sources, cleaning, row features and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import clean, features
from marketloom.operators import aggregate, window
from marketloom.plans.registry import Views, query
from marketloom.sources import tables
from marketloom.sources.durable import new_path

K = ("obs_id", "event_idx")
_SERIES = "PARTITION BY obs_id ORDER BY event_idx"
E = "0.000001::DOUBLE"


# --- the flagship: read, window, aggregate in one shuffle --------------------


@query(
    "a0_flagship",
    f"""WITH x AS (SELECT *, ask - bid AS spread, price - lag(price) OVER ({_SERIES}) AS d FROM order_flow),
y AS (SELECT *, coalesce(d, 0) AS price_change, CASE WHEN count(price) OVER w >= 2 THEN stddev_samp(price) OVER w END AS vol FROM x
  WINDOW w AS ({_SERIES} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT obs_id, count(*) AS n, avg(spread) AS spread_mean, avg(price_change) AS change_mean, stddev_samp(price_change) AS change_std, max(vol) AS vol_max FROM y GROUP BY obs_id""",
    "spread_mean change_mean change_std vol_max",
)
def a0_flagship(v: Views):
    df = features.spread_features(v("order_flow"))
    df = window.rolling_std(window.series_diff(df, "price", 1, "price_change"), "price", 5, 2, "vol")
    return df.groupBy("obs_id").agg(F.count(F.lit(1)).alias("n"), F.avg("bid_ask_spread").alias("spread_mean"), F.avg("price_change").alias("change_mean"), F.stddev_samp("price_change").alias("change_std"), F.max("vol").alias("vol_max"))


# --- sources ----------------------------------------------------------------


@query("a1_read_table", "SELECT event_id, user_id, event_type, value FROM events")
def a1(v: Views):
    return tables.read_table(v.spark, f"{v.sf_dir}/events.parquet", "parquet", tables.EVENTS).select("event_id", "user_id", "event_type", "value")


@query("a2_event_index", "SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 100)::BIGINT AS obs_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) % 100)::BIGINT AS event_idx FROM events")
def a2(v: Views):
    return tables.with_event_index(v("events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", *K)


@query("a3_head_series", "SELECT obs_id, event_idx, eqt_code_cat FROM (SELECT *, dense_rank() OVER (ORDER BY obs_id) AS r FROM order_flow) o JOIN series_label USING (obs_id) WHERE r <= floor((SELECT count(DISTINCT obs_id) FROM order_flow) * 0.1)")
def a3(v: Views):
    df, labels = tables.head_series(v("order_flow"), v("series_label"), 0.1)
    return df.join(labels, "obs_id").select(*K, "eqt_code_cat")


@query("a4_write_predictions", "SELECT id::BIGINT AS id, p::INT AS p FROM pred")
def a4(v: Views):
    path = new_path(v.spark, "predictions")
    tables.write_predictions(v("pred").select("p", "id"), path, "id", "csv")
    return tables.read_table(v.spark, path, "csv", "id long, p int")


# --- cleaning ---------------------------------------------------------------


@query("b1_fill_zero", "SELECT obs_id, event_idx, coalesce(price, 0) AS price, coalesce(bid_size, 0) AS bid_size FROM gaps", "price bid_size")
def b1(v: Views):
    return clean.fill_zero(v("gaps")).select(*K, "price", "bid_size")


@query("b1_null_counts", """SELECT 'price' AS "column", count(*) FILTER (price IS NULL) AS nulls FROM gaps UNION ALL SELECT 'bid_size', count(*) FILTER (bid_size IS NULL) FROM gaps UNION ALL SELECT 'ask_size', count(*) FILTER (ask_size IS NULL) FROM gaps""")
def b1_counts(v: Views):
    return clean.null_counts(v("gaps"), ["price", "bid_size", "ask_size"])


@query("b2_inf_to_null", "SELECT obs_id, event_idx, CASE WHEN isinf(ask_size) THEN NULL ELSE ask_size END AS ask_size FROM gaps")
def b2(v: Views):
    return clean.inf_to(v("gaps"), ["ask_size"]).select(*K, "ask_size")


@query("b3_zero_to_null", "SELECT obs_id, event_idx, nullif(bid_size, 0) AS bid_size FROM gaps")
def b3(v: Views):
    return clean.zero_to_null(v("gaps"), ["bid_size"]).select(*K, "bid_size")


_CODED = """SELECT event_id, coalesce(a.code, -1)::INT AS action, coalesce(s.code, -1)::INT AS side FROM order_flow o
LEFT JOIN (SELECT action, dense_rank() OVER (ORDER BY action) - 1 AS code FROM (SELECT DISTINCT action FROM order_flow WHERE {train})) a ON a.action = o.action
LEFT JOIN (SELECT side, dense_rank() OVER (ORDER BY side) - 1 AS code FROM (SELECT DISTINCT side FROM order_flow WHERE {train})) s ON s.side = o.side"""


@query("b4_ordinal", _CODED.format(train="action <> 'purchase'"))
def b4(v: Views):
    df = v("order_flow")
    codes = clean.fit_ordinal(df.filter("action <> 'purchase'"), ["action", "side"])
    return clean.apply_ordinal(df.select("event_id", "action", "side"), codes, ["action", "side"])


@query("b5_strict_labels", _CODED.format(train="TRUE"))
def b5(v: Views):
    df = v("order_flow").select("event_id", "action", "side")
    return clean.apply_ordinal(df, clean.fit_ordinal(df, ["action", "side"]), ["action", "side"], "error")


@query("b6_one_hot", "SELECT event_id, " + ", ".join(f"(venue = {i})::INT AS venue_{i}" for i in range(6)) + " FROM order_flow")
def b6(v: Views):
    return clean.one_hot(v("order_flow").select("event_id", "venue"), "venue", 6).drop("venue")


@query("b7_casts", "SELECT event_id, trade::INT AS trade, price::FLOAT::DOUBLE AS price, (venue::TINYINT)::INT AS venue FROM order_flow", "price")
def b7(v: Views):
    cast = clean.cast_columns(v("order_flow").select("event_id", "trade", "price", "venue"), {"trade": "int", "price": "float", "venue": "tinyint"})
    return clean.cast_columns(cast, {"price": "double", "venue": "int"})


@query("b8_distinct_labels", "SELECT obs_id, (arg_min(event_id, event_idx) % 24)::INT AS eqt_code_cat FROM order_flow GROUP BY obs_id")
def b8(v: Views):
    return clean.distinct_labels(v("order_flow").withColumn("eqt_code_cat", (F.col("event_id") % 24).cast("int")))


@query("b9_parse_datetime", "SELECT event_id, strftime(coalesce(try_strptime(StartDatetime, '%Y-%m-%d %H:%M:%S'), try_strptime(StartDatetime, '%d/%m/%Y %H:%M')), '%Y-%m-%d %H:%M:%S') AS date FROM raw_times")
def b9(v: Views):
    return v("raw_times").select("event_id", F.date_format(clean.parse_datetime(F.col("StartDatetime")), "yyyy-MM-dd HH:mm:ss").alias("date"))


@query("b10_semester", "SELECT event_id, CASE WHEN TIME_PERIOD LIKE '%S1' THEN DATE '2024-01-01' ELSE DATE '2024-07-01' END AS date FROM raw_times")
def b10(v: Views):
    return v("raw_times").select("event_id", clean.semester_to_date(F.col("TIME_PERIOD")).alias("date"))


@query("b11_duplicate_times", "SELECT zone, strftime(ts, '%Y-%m-%d %H') AS hour, count(*) AS n FROM zone_series GROUP BY ALL HAVING count(*) > 1")
def b11(v: Views):
    return clean.duplicate_times(v("zone_series"), "zone", "ts").select("zone", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "n")


@query("b12_round_to_tick", "SELECT id, round_even(price / 0.2, 0) * 0.2 AS price FROM book_orders", "price")
def b12(v: Views):
    return v("book_orders").select("id", clean.round_to_tick(F.col("price"), 0.2).alias("price"))


@query("b13_prefix_columns", "SELECT shots AS HOME_shots, poss AS HOME_poss FROM home_stats", "HOME_poss")
def b13(v: Views):
    return clean.prefix_columns(v("home_stats"), "HOME_", skip=1)


@query("b14_signed_log", "SELECT event_id, sign(flux) * ln(1 + abs(flux)) AS log_flux, CASE WHEN isinf(ask_size) THEN 0 ELSE sign(ask_size) * ln(1 + abs(ask_size)) END AS log_ask FROM order_flow JOIN (SELECT event_id, ask_size FROM gaps) g USING (event_id)".replace("ask_size) THEN", "g.ask_size) THEN").replace("sign(ask_size)", "sign(g.ask_size)").replace("abs(ask_size)", "abs(g.ask_size)"), "log_flux log_ask")
def b14(v: Views):
    both = v("order_flow").select("event_id", "flux").join(v("gaps").select("event_id", "ask_size"), "event_id")
    return both.select("event_id", clean.signed_log(F.col("flux")).alias("log_flux"), clean.signed_log(F.col("ask_size")).alias("log_ask"))


@query("b15_log_shift", "SELECT event_id, ln(abs(flux + 1)) AS log_abs, CASE WHEN flux + 1 > 0 THEN ln(flux + 1) END AS log_plain FROM order_flow", "log_abs log_plain")
def b15(v: Views):
    return v("order_flow").select("event_id", clean.log_shift(F.col("flux"), True).alias("log_abs"), clean.log_shift(F.col("flux"), False).alias("log_plain"))


@query("b16_stack_split", "SELECT event_id, (event_id % 4 > 0)::INT AS is_train FROM order_flow")
def b16(v: Views):
    df = v("order_flow").select("event_id")
    stacked = clean.stack_with_flag(df.filter("event_id % 4 > 0"), df.filter("event_id % 4 = 0"))
    train, test = clean.split_by_flag(stacked)
    return train.withColumn("is_train", F.lit(1)).unionByName(test.withColumn("is_train", F.lit(0)))


@query("b17_validate_orders", "SELECT id, price BETWEEN 46 AND 60 AND qty BETWEEN 0 AND 25 AS valid FROM book_orders")
def b17(v: Views):
    return clean.validate_orders(v("book_orders"), (46, 60), (0, 25)).select("id", "valid")


# --- row features -----------------------------------------------------------


def _flow(v: Views):
    return v("order_flow")


def rows(name: str, columns: dict[str, str], build):
    """A query that adds columns to the order flow: SQL expressions by name, and the function that builds the same."""
    sql = "SELECT obs_id, event_idx, " + ", ".join(f"{x} AS {c}" for c, x in columns.items()) + " FROM order_flow"
    query(name, sql, " ".join(columns))(lambda v: build(_flow(v)).select(*K, *columns))


rows("c1_spread", {"bid_ask_spread": "ask - bid", "mid_price": "(bid + ask) / 2", "relative_spread": f"(ask - bid) / (price + {E})", "mid_vs_price": "price - (bid + ask) / 2"}, features.spread_features)
rows("c1_spread_by_mid", {"relative_spread": f"(ask - bid) / ((bid + ask) / 2 + {E})"}, lambda d: features.spread_features(d, "mid_price"))
rows("c2_imbalance", {"imbalance": "bid_size - ask_size", "normalized_imbalance": f"(bid_size - ask_size) / (bid_size + ask_size + {E})", "rel_bid_size": f"bid_size / (bid_size + ask_size + {E})", "bid_ask_ratio": f"bid_size / (ask_size + {E})"}, features.imbalance_features)
rows("c3_liquidity", {"liquidity_depth": "bid_size + ask_size", "log_liquidity_depth": "ln(1 + bid_size + ask_size)", "liquidity_ratio": f"(bid_size + ask_size) / (ask - bid + {E})", "turnover": "price * (bid_size + ask_size)", "flux_turnover": "price * flux"}, features.liquidity_features)
rows("c4_pressure", {"buy_pressure": f"bid_size / (bid_size + ask_size + {E})", "sell_pressure": f"ask_size / (bid_size + ask_size + {E})", "pressure_diff": f"(bid_size - ask_size) / (bid_size + ask_size + {E})", "market_pressure": f"bid_size / (bid_size + ask_size + ask - bid + {E})", "aggressiveness": f"flux / (bid_size + ask_size + {E})"}, features.pressure_features)
rows("c5_price_position", {"price_bid_ratio": f"price / (bid + {E})", "price_ask_ratio": f"price / (ask + {E})"}, features.price_position)
rows("c6_trade", {"trade_impact": "trade::INT * flux", "trade_flux_ratio": f"trade::INT * flux / (abs(flux) + {E})", "trade_volume": "trade::INT * (bid_size + ask_size)"}, features.trade_features)


@query("c7_direction", f"WITH x AS (SELECT *, coalesce(price - lag(price) OVER ({_SERIES}), 0) AS d FROM order_flow) SELECT obs_id, event_idx, (d > 0)::INT AS price_up, (d < 0)::INT AS price_down, sign(d)::DOUBLE AS delta_sign, abs(d) AS abs_price_change, abs(d) / (abs(price) + {E}) AS direction_intensity FROM x", "delta_sign abs_price_change direction_intensity")
def c7(v: Views):
    return features.direction_features(window.series_diff(_flow(v), "price", 1, "price_change")).select(*K, "price_up", "price_down", "delta_sign", "abs_price_change", "direction_intensity")


@query("c8_time", "SELECT event_id, hour(ts)::INT AS hour, (isodow(ts) - 1)::INT AS dayofweek, month(ts)::INT AS month, (isodow(ts) >= 6)::INT AS is_weekend FROM events")
def c8(v: Views):
    return features.time_features(v("events"), "ts").select("event_id", "hour", "dayofweek", "month", "is_weekend")


_CYCLE = ", ".join(f"{f}(2 * pi() * {x} / {n}) AS {name}_{f}" for name, x, n in (("hour", "hour(ts)", 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)) for f in ("sin", "cos"))


@query("c9_cyclic", f"SELECT event_id, {_CYCLE} FROM events", "hour_sin hour_cos dow_sin dow_cos month_sin month_cos")
def c9(v: Views):
    return features.cyclic_features(v("events"), "ts").select("event_id", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos")


@query("c10_seasons", "SELECT event_id, (month(ts) IN (11, 12, 1, 2))::INT AS winter, (month(ts) IN (6, 7, 8))::INT AS summer, (month(ts) IN (1, 2, 3, 11, 12))::INT AS high_demand, (hour(ts) < 8 OR hour(ts) >= 20)::INT AS off_peak FROM events")
def c10(v: Views):
    return features.season_flags(v("events"), "ts").select("event_id", "winter", "summer", "high_demand", "off_peak")


@query("c11_row_mean_std", "SELECT event_id, list_avg(list_filter([price, bid_size, nullif(event_idx, 0)::DOUBLE], lambda x: x IS NOT NULL)) AS m_mean, CASE WHEN (price IS NOT NULL)::INT + (bid_size IS NOT NULL)::INT + (event_idx <> 0)::INT > 1 THEN list_stddev_samp([price, bid_size, nullif(event_idx, 0)::DOUBLE]) END AS m_std FROM gaps", "m_mean m_std")
def c11(v: Views):
    df = v("gaps").withColumn("z", F.nullif(F.col("event_idx"), F.lit(0)).cast("double"))
    return features.row_mean_std(df, ["price", "bid_size", "z"], "m").select("event_id", "m_mean", "m_std")


@query("c12_spark_spreads", "SELECT obs_id, event_idx, bid - price AS spark_spread_bid, ask - price AS spark_spread_ask FROM order_flow", "spark_spread_bid spark_spread_ask")
def c12(v: Views):
    return features.spark_spreads(_flow(v), ["bid", "ask"], "price").select(*K, "spark_spread_bid", "spark_spread_ask")


# --- windows ----------------------------------------------------------------


def windows(name: str, columns: dict[str, str], build, source: str = "order_flow", before: str = ""):
    """A query that adds window columns; ``before`` is SQL that prepares the rows ``x``."""
    sql = f"WITH x AS ({before or f'SELECT * FROM {source}'}) SELECT obs_id, event_idx, " + ", ".join(f"{x} AS {c}" for c, x in columns.items()) + " FROM x"
    query(name, sql, " ".join(columns))(lambda v: build(v(source)).select(*K, *columns))


def lag(c: str, k: int = 1) -> str:
    return f"lag({c}, {k}) OVER ({_SERIES})"


def diff(c: str, k: int = 1) -> str:
    return f"coalesce({c} - {lag(c, k)}, 0)"


def rolled(f: str, n: int) -> str:
    return f"{f} OVER ({_SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _many_diffs(df):
    df = features.spread_features(df)
    for c, k, n in (("price", 1, "d_price"), ("bid", 1, "d_bid"), ("ask_size", 1, "d_ask_size"), ("bid_ask_spread", 1, "d_spread"), ("price", 3, "momentum_3"), ("price", 20, "momentum_20"), ("mid_price", 5, "trend_5"), ("mid_price", 10, "trend_10")):
        df = window.series_diff(df, c, k, n)
    return df


_MID = "SELECT *, ask - bid AS bid_ask_spread, (bid + ask) / 2 AS mid_price FROM order_flow"
windows("d1_series_diff", {"d_price": diff("price"), "d_bid": diff("bid"), "d_ask_size": diff("ask_size"), "d_spread": diff("bid_ask_spread"), "momentum_3": diff("price", 3), "momentum_20": diff("price", 20), "trend_5": diff("mid_price", 5), "trend_10": diff("mid_price", 10)}, _many_diffs, before=_MID)
windows("d2_pct_change", {"r1": f"coalesce(price / nullif({lag('price')}, 0) - 1, 0)", "r5": f"coalesce(bid_size / nullif({lag('bid_size', 5)}, 0) - 1, 0)"}, lambda d: window.series_pct_change(window.series_pct_change(d, "price", 1, "r1"), "bid_size", 5, "r5"))
windows("d3_momentum_ratio", {"momentum_ratio_3": f"{diff('price', 3)} / (abs(price) + {E})", "momentum_ratio_10": f"{diff('price', 10)} / (abs(price) + {E})"}, lambda d: window.momentum_ratio(d, [3, 10]))
windows("d4_cumulative_change", {"cumulative_price_change": f"price - first_value(price) OVER ({_SERIES})"}, lambda d: window.cumulative_change(d, "price"))
windows("d5_rolling_std", {"s1": rolled("stddev_samp(price)", 5), "s2": f"CASE WHEN {rolled('count(price)', 10)} >= 10 THEN {rolled('stddev_samp(price)', 10)} END", "s3": f"CASE WHEN {rolled('count(d)', 5)} >= 2 THEN {rolled('stddev_samp(d)', 5)} END"}, lambda d: window.rolling_std(window.rolling_std(window.rolling_std(window.series_diff(d, "price", 1, "d"), "price", 5, 1, "s1"), "price", 10, None, "s2"), "d", 5, 2, "s3"), before=f"SELECT *, {diff('price')} AS d FROM order_flow")
windows("d6_ofi", {"ofi": f"(bid_size - coalesce({lag('bid_size')}, 0)) - (ask_size - coalesce({lag('ask_size')}, 0))"}, window.ofi)
windows("d7_ofi_conditional", {"ofi_conditional": f"CASE WHEN {diff('bid')} >= 0 THEN {diff('bid_size')} ELSE 0 END - CASE WHEN {diff('ask')} <= 0 THEN {diff('ask_size')} ELSE 0 END"}, window.ofi_conditional)
windows("d8_event_progress", {"progress": f"event_idx / (max(event_idx) OVER (PARTITION BY obs_id) + {E})", "time_proportion": "event_idx / 100.0"}, window.event_progress)
_OWN = "PARTITION BY obs_id, order_id ORDER BY event_idx"
windows("d9_order_dynamics", {"order_event_count": "count(*) OVER (PARTITION BY obs_id, order_id)", "order_age_norm": f"(row_number() OVER ({_OWN}) - 1) / (count(*) OVER (PARTITION BY obs_id, order_id) - 1 + {E})", "order_flux_change": f"coalesce(flux - lag(flux) OVER ({_OWN}), 0)", "is_new_order": f"(row_number() OVER ({_OWN}) = 1)::INT"}, window.order_dynamics)
windows("d10_trend_consistency", {"trend_consistency": rolled("avg((d > 0)::INT)", 10)}, window.trend_consistency, before=f"SELECT *, {diff('price')} AS d FROM order_flow")
windows("d11_series_zscore", {"zscore_price": f"(price - avg(price) OVER (PARTITION BY obs_id)) / (stddev_samp(price) OVER (PARTITION BY obs_id) + {E})"}, lambda d: window.series_zscore(d, "price"))
windows("d12_global_zscore", {"price_z": f"(price - (SELECT avg(price) FROM order_flow)) / ((SELECT stddev_samp(price) FROM order_flow) + {E})"}, lambda d: window.global_zscore(d, "price"))
windows("d13_flux_intensity", {"flux_intensity": f"abs({diff('lf')}) / (abs(lf) + {E})"}, window.flux_intensity, before="SELECT *, sign(flux) * ln(1 + abs(flux)) AS lf FROM order_flow")
windows("d14_rolling_share", {"bid_size_strength": f"coalesce(bid_size / (CASE WHEN {rolled('count(bid_size)', 5)} >= 5 THEN {rolled('sum(bid_size)', 5)} END + {E}), 0)"}, lambda d: window.rolling_share(d, "bid_size", 5))
windows("d15_volume_change", {"volume_change": "c", "log_volume_change": "sign(c) * ln(1 + abs(c))", "volatility_adjusted_spread": f"coalesce((ask - bid) / ({rolled('stddev_samp(price)', 5)} + {E}), 0)"}, window.volume_change, before=f"SELECT *, coalesce(bid_size - {lag('bid_size')} + ask_size - {lag('ask_size')}, 0) AS c FROM order_flow")
windows("d16_group_mean", {"bid_size_mean_by_venue": "avg(bid_size) OVER (PARTITION BY venue)"}, lambda d: window.group_mean(d, "venue", "bid_size"))
windows("d17_global_diff", {"price_global_diff_1": "coalesce(price - lag(price) OVER (ORDER BY obs_id, event_idx), 0)", "price_global_diff_5": "coalesce(price - lag(price, 5) OVER (ORDER BY obs_id, event_idx), 0)"}, lambda d: window.global_diff(window.global_diff(d, "price", 1), "price", 5))
windows("d18_vwap", {"vwap": "sum(price * bid_size) OVER (PARTITION BY obs_id) / sum(bid_size) OVER (PARTITION BY obs_id)"}, window.vwap)


@query("d19_log_returns", "SELECT * FROM (SELECT instrument, strftime(day, '%Y-%m-%d') AS day, ln(close / lag(close) OVER (PARTITION BY instrument ORDER BY day)) AS log_return FROM daily_close) WHERE log_return IS NOT NULL", "log_return")
def d19(v: Views):
    return window.log_returns(v("daily_close"), "instrument", "day", "close").select("instrument", F.date_format("day", "yyyy-MM-dd").alias("day"), "log_return")


_FILL = "coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY obs_id ORDER BY event_idx), first_value({c} IGNORE NULLS) OVER (PARTITION BY obs_id ORDER BY event_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"


@query("d20_ffill_bfill", f"SELECT obs_id, event_idx, {_FILL.format(c='price')} AS price, {_FILL.format(c='bid_size')} AS bid_size FROM gaps", "price bid_size")
def d20(v: Views):
    return window.ffill_bfill(v("gaps"), "obs_id", "event_idx", ["price", "bid_size"]).select(*K, "price", "bid_size")


@query("d21_resample_hourly", """WITH m AS (SELECT zone, ts, avg(value) AS value FROM zone_series WHERE hour(ts) % 3 <> 1 GROUP BY zone, ts),
g AS (SELECT zone, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM m GROUP BY zone)
SELECT zone, strftime(g.ts, '%Y-%m-%d %H') AS hour, last_value(value IGNORE NULLS) OVER (PARTITION BY zone ORDER BY g.ts) AS value FROM g LEFT JOIN m USING (zone, ts)""", "value")
def d21(v: Views):
    means = aggregate.mean_by_time(v("zone_series").filter("hour(ts) % 3 <> 1"), "ts", "zone", "value")
    return window.resample_hourly_ffill(means, "zone", "ts", "value").select("zone", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "value")


@query("d22_complete_years", """WITH y AS (SELECT o_custkey % 20 AS k, year(o_orderdate)::INT AS y, max(o_totalprice) AS rate FROM orders WHERE year(o_orderdate) % 3 <> 0 GROUP BY 1, 2),
g AS (SELECT k, unnest(generate_series(min(y), max(y)))::INT AS y FROM y GROUP BY k)
SELECT k, y, last_value(rate IGNORE NULLS) OVER (PARTITION BY k ORDER BY y) AS rate FROM g LEFT JOIN y USING (k, y)""", "rate")
def d22(v: Views):
    years = v("orders").withColumn("k", F.col("o_custkey") % 20).withColumn("y", F.year("o_orderdate")).filter("y % 3 <> 0").groupBy("k", "y").agg(F.max("o_totalprice").alias("rate"))
    return window.complete_years(years, "k", "y", "rate")


_EDGE = "SELECT obs_id, lag(event_idx) OVER (PARTITION BY obs_id, {k} ORDER BY event_idx) AS source, event_idx AS target, '{n}' AS kind, action, side, trade FROM order_flow"


@query("d23_event_edges", f"SELECT * FROM ({_EDGE.format(k='venue', n='venue')} UNION ALL {_EDGE.format(k='order_id', n='order')}) WHERE source IS NOT NULL")
def d23(v: Views):
    return window.event_edges(_flow(v))
