"""Queries over model outputs, MLlib models, streams and whole datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import aggregate, boosting, evaluate, models
from marketloom.plans import datasets
from marketloom.plans.catalog_market import cdf
from marketloom.plans.registry import Views, query
from marketloom.sources.durable import new_path
from marketloom.streaming import jobs

# --- evaluation -------------------------------------------------------------

_SOFT = "(SELECT id, y, list_transform(r, lambda x: x / list_sum(r)) AS proba, (list_position(e, list_max(e)) - 1)::INT AS predicted FROM (SELECT *, list_transform(e, lambda x: exp(x - list_max(e))) AS r FROM (SELECT id, y, list_transform(embedding[1:24], lambda x: x::DOUBLE) AS e FROM scores)))"


def _soft(v: Views) -> DataFrame:
    return evaluate.softmax_argmax(v("scores").withColumn("s", F.slice("embedding", 1, 24)), "s")


@query("k1_softmax_argmax", f"SELECT id, predicted, proba[1] AS p0, proba[24] AS p23, list_max(proba) AS top FROM {_SOFT} s", "p0 p23 top")
def k1(v: Views):
    return _soft(v).select("id", "predicted", F.col("proba")[0].alias("p0"), F.col("proba")[23].alias("p23"), F.array_max("proba").alias("top"))


_DETAILS = f"(SELECT *, list_max(proba) AS max_prob, list_sort(proba)[23] AS second_prob, list_max(proba) - list_sort(proba)[23] AS margin, -list_sum(list_transform(proba, lambda x: x * ln(x))) AS entropy FROM {_SOFT} s)"


@query("k2_proba_details", f"SELECT id, max_prob, second_prob, margin, entropy, proba[1] AS class_0_prob FROM {_DETAILS} d", "max_prob second_prob margin entropy class_0_prob")
def k2(v: Views):
    return evaluate.proba_details(_soft(v), "proba", 1).select("id", "max_prob", "second_prob", "margin", "entropy", "class_0_prob")


@query("k3_pseudo_labels", f"SELECT d.id, predicted AS label, max_prob, y FROM {_DETAILS} d WHERE max_prob >= 0.055", "max_prob")
def k3(v: Views):
    return evaluate.pseudo_labels(evaluate.proba_details(_soft(v), "proba"), v("scores").select("id", "y"), 0.055)


@query("k4_override", f"SELECT id, CASE WHEN max_prob < 0.055 THEN 7 ELSE predicted END AS predicted FROM {_DETAILS} d")
def k4(v: Views):
    return evaluate.override_low_confidence(evaluate.proba_details(_soft(v), "proba"), 0.055, 7).select("id", "predicted")


@query("k5_accuracy", "SELECT avg((y = p)::INT) AS accuracy, 1 - avg((y = p)::INT) AS error_rate, count(*) AS n FROM pred", "accuracy error_rate")
def k5(v: Views):
    return evaluate.accuracy(v("pred"))


@query("k5_constant_baseline", "SELECT avg((y = 3)::INT) AS accuracy FROM pred", "accuracy")
def k5_constant(v: Views):
    return evaluate.constant_baseline(v("pred"), 3)


_CELLS = "(SELECT a.c AS y, b.c AS p, count(pred.id) AS n FROM (SELECT y AS c FROM pred UNION SELECT p FROM pred) a CROSS JOIN (SELECT y AS c FROM pred UNION SELECT p FROM pred) b LEFT JOIN pred ON pred.y = a.c AND pred.p = b.c GROUP BY ALL)"


@query("k6_confusion_matrix", f"SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY y), 0), 0) AS share FROM {_CELLS} c", "share")
def k6(v: Views):
    return evaluate.confusion_matrix(v("pred"), normalize=True)


@query("k7_classification_report", f"""WITH r AS (SELECT y AS c, sum(n) FILTER (y = p) AS tp, sum(n)::BIGINT AS support FROM {_CELLS} x GROUP BY y), q AS (SELECT p AS c, sum(n) AS said FROM {_CELLS} x GROUP BY p),
m AS (SELECT c::VARCHAR AS class, coalesce(tp / nullif(said, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, support FROM r JOIN q USING (c)),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM m)
SELECT class, precision, recall, f1, support FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support)::BIGINT FROM f""", "precision recall f1")
def k7(v: Views):
    return evaluate.classification_report(v("pred"))


@query("k8_log_loss", f"SELECT -avg(ln(greatest(1e-15::DOUBLE, least(1 - 1e-15::DOUBLE, proba[y + 1])))) AS log_loss FROM {_SOFT} s", "log_loss")
def k8(v: Views):
    return evaluate.log_loss(_soft(v))


@query("k9_regression_metrics", "SELECT avg(abs(price - bid)) AS mae, sqrt(avg((price - bid) * (price - bid))) AS rmse, sum((price - bid) * (price - bid)) AS sse, 1 - sum((price - bid) * (price - bid)) / (var_pop(price) * count(*)) AS r2 FROM order_flow", "mae rmse sse r2")
def k9(v: Views):
    return evaluate.regression_metrics(v("order_flow"), "price", "bid")


@query("k10_calibrate_threshold", "SELECT quantile_disc(abs(diff), 0.26) AS alpha FROM match_score", "alpha")
def k10(v: Views):
    return evaluate.calibrate_threshold(v("match_score"), "diff", 0.26)


@query("k11_threshold_outcome", "SELECT id, (diff >= 10)::INT AS home_wins, (diff < 10 AND diff > -10)::INT AS draw, (diff <= -10)::INT AS away_wins FROM match_score")
def k11(v: Views):
    return evaluate.threshold_outcome(v("match_score").select("id", "diff"), "diff", 10).drop("diff")


@query("k12_run_summary", "SELECT venue AS model, avg(price) AS mean, stddev_pop(price) AS std, count(*) AS n FROM order_flow GROUP BY venue", "mean std")
def k12(v: Views):
    return evaluate.run_summary(v("order_flow").select(F.col("venue").alias("model"), F.col("price").alias("score")))


_Z = "(-abs(statistic - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24))"


@query("k12_wilcoxon", f"""WITH d AS (SELECT venue, bid_size - ask_size AS d FROM order_flow WHERE bid_size <> ask_size),
r AS (SELECT *, rank() OVER (PARTITION BY venue ORDER BY abs(d)) + (count(*) OVER (PARTITION BY venue, abs(d)) - 1) / 2 AS r, count(*) OVER (PARTITION BY venue, abs(d))::DOUBLE AS same FROM d),
s AS (SELECT venue, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS statistic, count(*) AS n, sum(same * same - 1) AS ties FROM r GROUP BY venue)
SELECT venue, statistic, n, least(1, 2 * {cdf(_Z)}) AS p_value FROM s""", "statistic p_value", 3)
def k12_wilcoxon(v: Views):
    return evaluate.wilcoxon(v("order_flow"), "bid_size", "ask_size", ["venue"])


_TARGETS = """(SELECT p.picture, l::INT AS label, CASE WHEN a.label IS NOT NULL THEN (x.label IS NOT NULL)::INT END AS target FROM (SELECT DISTINCT picture FROM pixels) p CROSS JOIN range(1, 8) r(l)
LEFT JOIN pixels x ON x.picture = p.picture AND x.label = l LEFT JOIN annotated a ON a.picture = p.picture AND a.label = l)"""


@query("k13_multilabel_targets", f"SELECT t.*, picture IN (SELECT picture FROM annotated) AS annotated FROM {_TARGETS} t")
def k13(v: Views):
    known, unknown = evaluate.split_annotated(evaluate.multilabel_targets(v("pixels"), v("annotated"), 7))
    return known.withColumn("annotated", F.lit(True)).unionByName(unknown.withColumn("annotated", F.lit(False)))


@query("k14_masked_mean", f"SELECT avg(target) AS mean, count(target) AS n FROM {_TARGETS} t", "mean")
def k14(v: Views):
    return evaluate.masked_mean(evaluate.multilabel_targets(v("pixels"), v("annotated"), 7), "target")


@query("k15_early_stop", """WITH RECURSIVE h AS (SELECT obs_id AS run, event_idx AS epoch, price AS loss FROM order_flow),
w AS (SELECT run, epoch, loss AS best, epoch AS best_epoch, FALSE AS stop FROM h WHERE epoch = 0
  UNION ALL SELECT h.run, h.epoch, least(best, loss), CASE WHEN loss < best THEN h.epoch ELSE best_epoch END, loss >= best AND h.epoch - best_epoch >= 5 FROM w JOIN h ON h.run = w.run AND h.epoch = w.epoch + 1 WHERE NOT stop)
SELECT run, max(best_epoch) AS best_epoch, min(best) AS best_loss, max(epoch) FILTER (stop) AS stop_epoch FROM w GROUP BY run""", "best_loss")
def k15(v: Views):
    return evaluate.early_stop(v("order_flow").select(F.col("obs_id").alias("run"), F.col("event_idx").alias("epoch"), F.col("price").alias("loss")), 5)


# --- models -----------------------------------------------------------------

_E = [f"e{i}" for i in range(64)]


def _vectors(v: Views) -> DataFrame:
    own = [F.col("embedding")[i].cast("double").alias(e) for i, e in enumerate(_E)]
    return v("embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), *own)


def _halves(v: Views) -> tuple[DataFrame, DataFrame]:
    df = _vectors(v)
    return df.filter("id % 5 > 0"), df.filter("id % 5 = 0")


@query("l1_forest")
def l1(v: Views):
    train, test = _halves(v)
    return models.fit_forest(train, _E, "label", trees=10, depth=5).transform(test).select("id", "prediction")


@query("l1_tree")
def l1_tree(v: Views):
    train, test = _halves(v)
    return models.fit_tree(train, _E, "label", criterion="entropy").transform(test).select("id", "prediction")


@query("l2_boosted")
def l2(v: Views):
    train, test = _halves(v)
    stop = train.withColumn("validation", F.col("id") % 7 == 0)
    return models.fit_boosted(stop, _E[1:], "e0", rounds=8, depth=3, validation="validation").transform(test).select("id", "prediction")


@query("l2_boosted_classes")
def l2_classes(v: Views):
    train, test = _halves(v)
    stop = train.withColumns({"validation": F.col("id") % 7 == 0, "kind": F.col("label") % 3})
    return models.fit_boosted(stop, _E, "kind", rounds=4, depth=3, classes=3, validation="validation").transform(test).select("id", "prediction")


_SUMMARY = [f"{c}_{k}" for c in ("price", "bid_size", "ask_size", "flux") for k in ("mean", "std", "min", "max")]


@query("l2_softmax_boosted")
def l2_softmax(v: Views):
    """Series summaries to 24 classes; a summary of exactly 0 counts as missing."""
    kinds = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    series = aggregate.series_aggregate(v("order_flow"), ["price", "bid_size", "ask_size", "flux"], kinds).join(v("series_label"), "obs_id")
    series = series.withColumns({c: F.when(F.col(c) != 0, F.col(c)) for c in _SUMMARY})
    train, test = series.filter("obs_id % 5 > 0").withColumn("stop", F.col("obs_id") % 7 == 0), series.filter("obs_id % 5 = 0")
    model = boosting.fit_softmax_boosted(train, _SUMMARY, "eqt_code_cat", 24, rounds=5, depth=2, validation="stop")
    return model.transform(test).select("obs_id", "prediction")


@query("l3_svm")
def l3_svm(v: Views):
    train, test = (d.withColumn("kind", F.col("label") % 2) for d in _halves(v))
    return models.fit_linear(train, _E, "kind", kind="svm", iterations=10).transform(test).select("id", "prediction")


@query("l3_linear")
def l3(v: Views):
    train, test = _halves(v)
    return models.fit_linear(train, _E, "label", iterations=10).transform(test).select("id", "prediction")


@query("l4_bagging")
def l4(v: Views):
    train, test = _halves(v)
    return models.bagging_errors(train, test, _E[1:], "e0", [1, 2, 3, 5, 8], share=0.25, depth=4)


@query("l5_grid_search")
def l5(v: Views):
    return models.grid_search(_halves(v)[0], _E, "label", depths=[2, 4], trees=[5], folds=2)[1]


@query("l5_random_search")
def l5_random(v: Views):
    drawn = {"maxDepth": (2, 5), "numTrees": [3, 5, 8], "subsamplingRate": (0.5, 1.0)}
    return models.random_search(_halves(v)[0], _E, "label", drawn, key="id", draws=3, folds=2)[1]


@query("l6_impute_forest")
def l6(v: Views):
    gaps = _vectors(v).withColumn("e0", F.when(F.col("id") % 4 > 0, F.col("e0")))
    return models.impute_forest(gaps, ["e0"], _E, trees=5, depth=4).select("id", "e0")


@query("l7_importances")
def l7(v: Views):
    model = models.fit_forest(_halves(v)[0], _E, "label", trees=5, depth=4)
    return models.importances(model, v.spark, _E)


@query("l7_permutation_importance")
def l7_permutation(v: Views):
    train, test = _halves(v)
    return models.permutation_importance(models.fit_forest(train, _E, "label", trees=5, depth=4), test, _E, "label", "id")


_NEAR = """(SELECT t.id, t.label AS y, r.label, row_number() OVER (PARTITION BY t.id ORDER BY list_sum(list_transform(list_zip(t.embedding, r.embedding), lambda x: power(x[1]::DOUBLE - x[2]::DOUBLE, 2))), r.id) AS n
FROM (SELECT vec_id AS id, * FROM embeddings WHERE vec_id % 5 = 0) t CROSS JOIN (SELECT vec_id AS id, * FROM embeddings WHERE vec_id % 5 > 0) r)"""


def _knn(v: Views) -> tuple[DataFrame, DataFrame]:
    df = v("embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("int").alias("label"))
    return df.filter("id % 5 > 0"), df.filter("id % 5 = 0")


@query("l8_knn", f"SELECT id, arg_max(label, {{n: n, l: -label}}) AS predicted FROM (SELECT id, label, count(*) AS n FROM {_NEAR} q WHERE n <= 5 GROUP BY ALL) GROUP BY id")
def l8(v: Views):
    return models.knn_classify(*_knn(v), 5)


@query("l8_knn_sweep", f"""WITH c AS (SELECT k::INT AS k, id, y, label, count(*) AS n FROM {_NEAR} q JOIN (SELECT unnest([1, 5, 9]) AS k) ON n <= k GROUP BY ALL),
s AS (SELECT k, id, y, arg_max(label, {{n: n, l: -label}}) AS p FROM c GROUP BY ALL) SELECT k, avg((p = y)::INT) AS accuracy FROM s GROUP BY k""", "accuracy")
def l8_sweep(v: Views):
    return models.knn_sweep(*_knn(v), [1, 5, 9])


# --- streams ----------------------------------------------------------------


def run_stream(v: Views, source: DataFrame, job, keys: list[str] | None = None) -> DataFrame:
    """Write a table as files, run a streaming job over them until all are read, and read its result.

    With ``keys`` the job's result is a table by these keys, changed in each batch.
    """
    spark = v.spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    files, out, state = (new_path(spark, f"stream-{n}") for n in ("in", "out", "state"))
    source.write.parquet(files)
    stream = job(spark.readStream.schema(source.schema).parquet(files))
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state)
    if not keys:
        writer.outputMode("append").format("parquet").start(out).awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)
    writer.outputMode("update").foreachBatch(jobs.upsert_by_batch(out, keys)).start().awaitTermination()
    return jobs.latest(spark, out, keys, stream.schema)


def _zones(v: Views) -> DataFrame:
    return v("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("zone"), "value")


@query("m1_stream_hourly_mean", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type AS zone, avg(value) AS mean_value, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL", "mean_value")
def m1(v: Views):
    return run_stream(v, _zones(v), jobs.stream_hourly_mean).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH"))


@query("m2_stream_dedupe", "SELECT DISTINCT event_type AS zone, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour FROM events")
def m2(v: Views):
    hourly = _zones(v).withColumn("ts", F.date_trunc("hour", "ts"))
    return run_stream(v, hourly, jobs.stream_dedupe).select("zone", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"))


@query("m3_stream_trade_state", "SELECT instrument, arg_max(price, {t: ts, i: id}) AS last_price, count(*) AS n_trades, sum(qty)::BIGINT AS volume FROM trades GROUP BY instrument")
def m3(v: Views):
    return run_stream(v, v("trades"), jobs.stream_trade_state, ["instrument"])


@query("m4_stream_stop_triggers", """WITH last AS (SELECT instrument, ts, arg_max(price, id) AS price FROM trades GROUP BY ALL),
judged AS (SELECT s.*, (SELECT arg_max(price, ts) FROM last l WHERE l.instrument = s.instrument AND l.ts <= s.ts) AS before,
    (SELECT min(ts) FROM last l WHERE l.instrument = s.instrument AND l.ts > s.ts AND CASE WHEN s.side = 'buy' THEN l.price >= s.stop_price ELSE l.price <= s.stop_price END) AS later FROM stops s),
found AS (SELECT *, CASE WHEN coalesce(CASE WHEN side = 'buy' THEN before >= stop_price ELSE before <= stop_price END, FALSE) THEN ts ELSE later END AS t FROM judged)
SELECT f.instrument, f.id, f.side, f.stop_price, strftime(t, '%Y-%m-%d %H:%M:%S') AS trigger_ts, CASE WHEN later IS NULL OR t < later THEN before ELSE l.price END AS trade_price
FROM found f LEFT JOIN last l ON l.instrument = f.instrument AND l.ts = f.t WHERE t IS NOT NULL""")
def m4(v: Views):
    stops = v("stops").select("instrument", F.lit("stop").alias("kind"), "id", F.col("ts").cast("timestamp").alias("ts"), "side", F.col("stop_price").alias("price"))
    trades = v("trades").select("instrument", F.lit("trade").alias("kind"), "id", F.col("ts").cast("timestamp").alias("ts"), "side", "price")
    found = run_stream(v, stops.unionByName(trades), jobs.stream_stop_triggers)
    return found.withColumn("trigger_ts", F.date_format("trigger_ts", "yyyy-MM-dd HH:mm:ss"))


# --- datasets ---------------------------------------------------------------

_W = "PARTITION BY obs_id ORDER BY event_idx"
_E6 = "0.000001::DOUBLE"


def _signed(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


#: The full feature set as SQL; rows ``x`` are an order flow.
_FEATURES = {
    "bid_ask_spread": "ask - bid", "relative_spread": f"(ask - bid) / ((bid + ask) / 2 + {_E6})", "spread_change": f"coalesce((ask - bid) - lag(ask - bid) OVER ({_W}), 0)",
    "ofi_conditional": f"CASE WHEN coalesce(bid - lag(bid) OVER ({_W}), 0) >= 0 THEN coalesce(bid_size - lag(bid_size) OVER ({_W}), 0) ELSE 0 END - CASE WHEN coalesce(ask - lag(ask) OVER ({_W}), 0) <= 0 THEN coalesce(ask_size - lag(ask_size) OVER ({_W}), 0) ELSE 0 END",
    "price_change": "d", "rolling_volatility": f"coalesce(stddev_samp(d) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0)",
    "momentum_5": f"coalesce(price - lag(price, 5) OVER ({_W}), 0)", "momentum_20": f"coalesce(price - lag(price, 20) OVER ({_W}), 0)", "flux_change": f"coalesce(flux - lag(flux) OVER ({_W}), 0)",
    "order_event_count": "count(*) OVER (PARTITION BY obs_id, order_id)", "order_age_norm": f"(row_number() OVER (PARTITION BY obs_id, order_id ORDER BY event_idx) - 1) / (count(*) OVER (PARTITION BY obs_id, order_id) - 1 + {_E6})",
    "order_flux_change": "coalesce(flux - lag(flux) OVER (PARTITION BY obs_id, order_id ORDER BY event_idx), 0)", "is_new_order": "(row_number() OVER (PARTITION BY obs_id, order_id ORDER BY event_idx) = 1)::INT",
    "imbalance": "bid_size - ask_size", "rel_bid_size": f"bid_size / (bid_size + ask_size + {_E6})", "log_bid_size": _signed("bid_size"), "log_ask_size": _signed("ask_size"), "log_flux": _signed("flux"),
}
_FULL = "SELECT obs_id, event_idx, " + ", ".join(f"{x} AS {c}" for c, x in _FEATURES.items()) + f" FROM (SELECT *, coalesce(price - lag(price) OVER ({_W}), 0) AS d FROM {{rows}}) x"


@query("n1_series_aggregate", "SELECT obs_id, avg(price) AS price_mean, max(price) - min(price) AS price_range, avg(flux) AS flux_mean, max(flux) - min(flux) AS flux_range FROM order_flow GROUP BY obs_id", "price_mean price_range flux_mean flux_range")
def n1(v: Views):
    return aggregate.series_aggregate(v("order_flow"), ["price", "flux"], {"mean": F.avg, "range": lambda c: F.max(c) - F.min(c)})


@query("n2_build_features", _FULL.format(rows="order_flow"), " ".join(_FEATURES))
def n2(v: Views):
    return datasets.build_features(v("order_flow"), log_skewed=False)[0].select("obs_id", "event_idx", *_FEATURES)


@query("n2_conditional_logs", f"SELECT *, {', '.join(f'{_signed(c)} AS log_{c}' for c in datasets.SCREENED)} FROM ({_FULL.format(rows='order_flow')}) f", " ".join([*_FEATURES, *[f"log_{c}" for c in datasets.SCREENED]]))
def n2_logs(v: Views):
    # any skewness at all: the columns don't depend on the tables
    logs = [f"log_{c}" for c in datasets.SCREENED]
    return datasets.build_features(v("order_flow"), skew_limit=0.0)[0].select("obs_id", "event_idx", *_FEATURES, *logs)


_REDUCED = [c for g in datasets.PRESETS["reduced"] for c in datasets.GROUPS[g] if g != "flux"]


@query("n2_reduced", f"SELECT obs_id, event_idx, {', '.join(_REDUCED)} FROM ({_FULL.format(rows='order_flow')}) f", " ".join(_REDUCED))
def n2_reduced(v: Views):
    return datasets.build_features(v("order_flow"), "reduced", log_skewed=False, flux=False)[0].select("obs_id", "event_idx", *_REDUCED)


_SCALED = [c for c in _FEATURES if c != "order_event_count"]


@query("n3_prepare_dataset", f"""WITH t AS (SELECT * FROM order_flow JOIN series_label USING (obs_id) WHERE obs_id % 4 > 0),
s AS (SELECT eqt_code_cat, avg(price) AS m, stddev_samp(price) AS sd, avg(bid) AS mb, stddev_samp(bid) AS sb, avg(ask) AS ma, stddev_samp(ask) AS sa FROM t GROUP BY eqt_code_cat),
kept AS (SELECT t.* FROM t WHERE obs_id NOT IN (SELECT obs_id FROM t JOIN s USING (eqt_code_cat) WHERE abs(price - m) > 4 * sd OR abs(bid - mb) > 4 * sb OR abs(ask - ma) > 4 * sa)),
f AS ({_FULL.format(rows='kept')}),
z AS (SELECT obs_id, event_idx, order_event_count, {', '.join(f'greatest(-10, least(10, ({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_samp({c}) OVER (), 0), {_E6}))) AS {c}' for c in _SCALED)} FROM f),
l AS (SELECT z.*, eqt_code_cat FROM z JOIN series_label USING (obs_id)),
s2 AS (SELECT eqt_code_cat, avg(log_bid_size) AS m1, stddev_samp(log_bid_size) AS d1, avg(log_ask_size) AS m2, stddev_samp(log_ask_size) AS d2, avg(log_flux) AS m3, stddev_samp(log_flux) AS d3 FROM l GROUP BY eqt_code_cat)
SELECT * EXCLUDE (order_event_count), order_event_count::DOUBLE AS order_event_count FROM l WHERE obs_id NOT IN (SELECT obs_id FROM l JOIN s2 USING (eqt_code_cat) WHERE abs(log_bid_size - m1) > 4 * d1 OR abs(log_ask_size - m2) > 4 * d2 OR abs(log_flux - m3) > 4 * d3)""", " ".join(_FEATURES), 5)
def n3(v: Views):
    df = v("order_flow")
    train, _ = datasets.prepare_dataset(df.filter("obs_id % 4 > 0"), v("series_label"), df.filter("obs_id % 4 = 0"), limits=(4.0, 4.0))
    return train.select("obs_id", "event_idx", "eqt_code_cat", *_FEATURES)


_STATS = ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_samp({c}), 0), {_E6}) AS s_{c}" for c in _SCALED)


@query("n3_test_table", f"""WITH t AS (SELECT * FROM order_flow JOIN series_label USING (obs_id) WHERE obs_id % 4 > 0 AND action <> 'purchase'),
codes AS (SELECT list_sort(list(DISTINCT action)) AS actions, list_sort(list(DISTINCT venue::VARCHAR)) AS venues FROM order_flow WHERE obs_id % 4 > 0 AND action <> 'purchase'),
f AS ({_FULL.format(rows='t')}), s AS (SELECT {_STATS} FROM f),
u AS (SELECT * FROM order_flow WHERE obs_id % 4 = 0), g AS ({_FULL.format(rows='u')}),
e AS (SELECT obs_id, event_idx, coalesce(list_position(actions, action), 0) - 1 AS action, coalesce(list_position(venues, venue::VARCHAR), 0) - 1 AS venue FROM u, codes)
SELECT obs_id, event_idx, action::INT AS action, venue::INT AS venue, order_event_count::DOUBLE AS order_event_count, {', '.join(f'greatest(-10, least(10, ({c} - m_{c}) / s_{c})) AS {c}' for c in _SCALED)}
FROM g JOIN e USING (obs_id, event_idx), s""", " ".join(_FEATURES), 5)
def n3_test(v: Views):
    df = v("order_flow")
    train = df.filter("obs_id % 4 > 0 AND action <> 'purchase'")  # an action that only the test rows have
    _, test = datasets.prepare_dataset(train, v("series_label"), df.filter("obs_id % 4 = 0"), remove_outliers=False)
    return test.select("obs_id", "event_idx", F.col("action").cast("int").alias("action"), F.col("venue").cast("int").alias("venue"), *_FEATURES)


_ZONES = ("click", "error", "purchase", "signup", "view")


def _energy_sql() -> str:
    zones = ", ".join(f"'{z}'" for z in _ZONES)
    means = f"SELECT 'spot_' || zone AS zone, ts, avg(value) AS v FROM zone_series WHERE zone IN ({zones}) GROUP BY ALL UNION ALL SELECT 'gas_view', ts, avg(value) / 2 FROM zone_series WHERE zone = 'view' AND hour(ts) % 2 = 0 GROUP BY ALL"
    cols = [*[f"spot_{z}" for z in _ZONES], "gas_view"]
    near = ", ".join(c for c in cols[1:-1])
    fill = "coalesce(last_value({c} IGNORE NULLS) OVER (ORDER BY ts), first_value({c} IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
    wide = "SELECT ts, " + ", ".join(f"max(v) FILTER (zone = '{c}') AS {c}" for c in cols) + f" FROM ({means}) m GROUP BY ts"
    filled = f"SELECT ts, {cols[0]}, " + ", ".join(fill.format(c=c) for c in cols[1:]) + f" FROM ({wide}) w"
    return f"""SELECT strftime(ts, '%Y-%m-%d %H') AS hour_key, {', '.join(cols)}, hour(ts)::INT AS hour, sin(2 * pi() * hour(ts) / 24) AS hour_sin, (month(ts) IN (11, 12, 1, 2))::INT AS winter,
  list_avg([{near}]) AS group_mean, list_aggregate([{near}], 'stddev_samp') AS group_std, spot_view - gas_view AS spark_spread_spot_view
FROM ({filled}) f WHERE {cols[0]} IS NOT NULL AND ts BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00'"""


_SPOTS = [f"spot_{z}" for z in _ZONES]


@query("n4_energy_dataset", _energy_sql(), f"{' '.join(_SPOTS)} gas_view hour_sin group_mean group_std spark_spread_spot_view")
def n4(v: Views):
    z = v("zone_series")
    gas = z.filter("zone = 'view' AND hour(ts) % 2 = 0").withColumn("value", F.col("value") / 2)
    out = datasets.build_energy_dataset(
        {"spot": z, "gas": gas}, target=_SPOTS[0], zones={"spot": list(_ZONES), "gas": ["view"]},
        neighbours=_SPOTS[1:], base="gas_view", start="2024-01-03 00:00:00", end="2024-01-20 00:00:00",
    )
    hour = F.date_format("ts", "yyyy-MM-dd HH").alias("hour_key")
    return out.select(hour, *_SPOTS, "gas_view", "hour", "hour_sin", "winter", "group_mean", "group_std", "spark_spread_spot_view")
