"""Queries over order books, option contracts and simulated paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.operators import book, pricing
from marketloom.plans.registry import Views, query

# --- books ------------------------------------------------------------------

_LEVELS = "(SELECT instrument, side, price, sum(qty)::BIGINT AS qty, count(*) AS n_orders FROM book_orders GROUP BY ALL)"
_SIGN = "CASE WHEN side = 'buy' THEN -price ELSE price END"


@query("i1_depth", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY instrument, side ORDER BY {_SIGN})::INT AS level FROM {_LEVELS}) WHERE level <= 5")
def i1(v: Views):
    return book.depth(v("book_orders"), 5)


def _top(table: str) -> str:
    levels = f"(SELECT instrument, side, price, sum(qty)::BIGINT AS qty FROM {table} GROUP BY ALL)"
    return f"(SELECT instrument, max(price) FILTER (side = 'buy') AS best_bid, coalesce(arg_max(qty, price) FILTER (side = 'buy'), 0) AS bid_qty, min(price) FILTER (side = 'sell') AS best_ask, coalesce(arg_min(qty, price) FILTER (side = 'sell'), 0) AS ask_qty FROM {levels} GROUP BY instrument)"


@query("i2_top_of_book", f"SELECT * FROM {_top('resting')} t")
def i2(v: Views):
    return book.top_of_book(v("resting"))


@query("i3_mid_price", f"SELECT instrument, round_even((best_bid + best_ask) / 2 / 0.2, 0) * 0.2 AS mid FROM {_top('resting')} t", "mid")
def i3(v: Views):
    return book.mid_price(v("resting"), 0.2)


_AVAILABLE = "(SELECT t.*, coalesce((SELECT sum(qty) FROM resting r WHERE r.instrument = t.instrument AND r.side <> t.side AND CASE WHEN t.side = 'buy' THEN r.price <= t.price ELSE r.price >= t.price END), 0)::BIGINT AS available FROM takers t)"


@query("i4_fok_feasible", f"SELECT id, instrument, available, available >= qty AS feasible FROM {_AVAILABLE} a")
def i4(v: Views):
    return book.fok_feasible(v("takers"), v("resting")).select("id", "instrument", F.coalesce("available", F.lit(0)).alias("available"), F.coalesce("feasible", F.lit(False)).alias("feasible"))


_FLAGS = f"(SELECT a.*, a.available >= a.qty AS feasible, coalesce(CASE WHEN a.side = 'buy' THEN a.price >= t.best_ask ELSE a.price <= t.best_bid END, FALSE) AS crosses FROM {_AVAILABLE} a LEFT JOIN {_top('resting')} t USING (instrument))"


@query("i5_crossing_flags", f"SELECT id, instrument, crosses, post_only AND crosses AS rejected FROM {_FLAGS} f")
def i5(v: Views):
    return book.crossing_flags(v("takers"), v("resting")).select("id", "instrument", "crosses", "rejected")


_FILLS = f"""(SELECT t.id AS taker_id, r.instrument, r.id AS resting_id, r.price, greatest(0, least(r.qty, t.qty - r.ahead))::BIGINT AS fill
FROM (SELECT *, coalesce(sum(qty) OVER (PARTITION BY instrument, side ORDER BY {_SIGN}, ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM resting) r
JOIN {_FLAGS} t ON t.instrument = r.instrument AND t.side <> r.side AND CASE WHEN t.side = 'buy' THEN r.price <= t.price ELSE r.price >= t.price END
WHERE NOT (t.post_only AND t.crosses) AND (t.tif <> 'FOK' OR t.feasible))"""


@query("i6_sweep_fills", f"SELECT instrument, taker_id, resting_id, price, fill FROM {_FILLS} f WHERE fill > 0")
def i6_fills(v: Views):
    return book.sweep_fills(v("takers"), v("resting"))


@query("i6_sweep", f"""WITH s AS (SELECT taker_id, sum(fill)::BIGINT AS filled_qty, sum(fill * price) AS paid FROM {_FILLS} f WHERE fill > 0 GROUP BY taker_id)
SELECT id, instrument, side, qty, coalesce(filled_qty, 0) AS filled_qty, paid / filled_qty AS mean_price, qty - coalesce(filled_qty, 0) AS remainder,
  CASE WHEN post_only AND crosses THEN 'rejected' WHEN tif = 'FOK' AND NOT feasible THEN 'killed' WHEN coalesce(filled_qty, 0) = qty THEN 'filled' WHEN tif = 'IOC' THEN 'cancelled' ELSE 'rests' END AS status
FROM {_FLAGS} t LEFT JOIN s ON s.taker_id = t.id""", "mean_price")
def i6(v: Views):
    return book.sweep(v("takers"), v("resting"))


@query("i7_uncross", f"""WITH x AS (SELECT *, sum(qty) OVER (PARTITION BY instrument, side ORDER BY {_SIGN}, ts, id)::BIGINT AS e FROM book_orders)
SELECT b.instrument, (b.price + s.price) / 2 AS price, least(b.e, s.e) - greatest(b.e - b.qty, s.e - s.qty) AS volume, b.id AS buy_id, s.id AS sell_id, CASE WHEN b.e >= s.e THEN 'buy' ELSE 'sell' END AS initiator
FROM x b JOIN x s ON b.instrument = s.instrument AND b.side = 'buy' AND s.side = 'sell' AND b.price >= s.price AND least(b.e, s.e) > greatest(b.e - b.qty, s.e - s.qty)""", "price")
def i7(v: Views):
    return book.uncross(v("book_orders"))


@query("i8_stop_triggers", f"""WITH last AS (SELECT instrument, ts, arg_max(price, id) AS price FROM trades GROUP BY ALL),
judged AS (SELECT s.*, (SELECT arg_max(price, ts) FROM last l WHERE l.instrument = s.instrument AND l.ts <= s.ts) AS before, best_bid, best_ask,
    (SELECT min(ts) FROM last l WHERE l.instrument = s.instrument AND l.ts > s.ts AND CASE WHEN s.side = 'buy' THEN l.price >= s.stop_price ELSE l.price <= s.stop_price END) AS later
  FROM stops s LEFT JOIN {_top('resting')} t USING (instrument)),
found AS (SELECT *, CASE WHEN coalesce(CASE WHEN side = 'buy' THEN coalesce(before, best_ask) >= stop_price ELSE coalesce(before, best_bid) <= stop_price END, FALSE) THEN ts ELSE later END AS t FROM judged)
SELECT id, instrument, side, stop_price, strftime(t, '%Y-%m-%d %H:%M:%S') AS trigger_ts, CASE WHEN t IS NOT NULL THEN CASE WHEN type = 'stop' THEN 'market' ELSE 'limit' END END AS becomes FROM found""")
def i8(v: Views):
    found = book.stop_triggers(v("stops"), v("trades"), book.top_of_book(v("resting")))
    return found.withColumn("trigger_ts", F.date_format("trigger_ts", "yyyy-MM-dd HH:mm:ss"))


@query("i9_trade_pnl", "SELECT instrument, sum(CASE WHEN side = 'buy' THEN -price * qty ELSE price * qty END) AS pnl FROM trades GROUP BY instrument", "pnl")
def i9(v: Views):
    return book.trade_pnl(v("trades"), ["instrument"])


@query("i10_trade_summary", "SELECT instrument, count(*) AS n_trades, sum(qty)::BIGINT AS volume, arg_max(price, {t: ts, i: id}) AS last_price FROM trades GROUP BY instrument")
def i10(v: Views):
    return book.trade_summary(v("trades"))


# --- pricing ----------------------------------------------------------------


def _pdf(x: str) -> str:
    return f"({pricing.INV_SQRT_2PI!r}::DOUBLE * exp(-({x}) * ({x}) / 2))"


def cdf(x: str) -> str:
    """The same rational formula as SQL text."""
    a = f"abs({x})"

    def horner(coefficients) -> str:
        out = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            out = f"({out} * {a} + {c!r}::DOUBLE)"
        return out

    near = f"exp(-{a} * {a} / 2) * {horner(pricing.CDF_TOP)} / {horner(pricing.CDF_BOTTOM)}"
    tail = f"exp(-{a} * {a} / 2) * {pricing.INV_SQRT_2PI!r}::DOUBLE * (1 / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65::DOUBLE))))))"
    below = f"CASE WHEN {a} > 37 THEN 0.0::DOUBLE WHEN {a} < 7.07106781186547::DOUBLE THEN {near} ELSE {tail} END"
    return f"(CASE WHEN {x} > 0 THEN 1 - ({below}) ELSE {below} END)"


@query("j1_normal", f"SELECT event_id, {_pdf('z')} AS pdf, {cdf('z')} AS cdf FROM (SELECT event_id, flux / 200 AS z FROM order_flow) x", "pdf cdf", 9)
def j1(v: Views):
    z = F.col("flux") / 200
    return v("order_flow").select("event_id", pricing.norm_pdf(z).alias("pdf"), pricing.norm_cdf(z).alias("cdf"))


def _priced(table: str) -> str:
    d = f"(SELECT *, (ln(s / k) + (r + sigma * sigma / 2) * t) / (sigma * sqrt(t)) AS d1 FROM {table})"
    return f"(SELECT *, {cdf('d1')} AS n1, {cdf('(d1 - sigma * sqrt(t))')} AS n2, {_pdf('d1')} AS p1, d1 - sigma * sqrt(t) AS d2, exp(-r * t) AS disc FROM {d} c)"


_PRICE = "CASE WHEN option_type = 'call' THEN s * n1 - k * disc * n2 ELSE k * disc * (1 - n2) - s * (1 - n1) END"


@query("j2_black_scholes", f"SELECT contract_id, {_PRICE} AS price FROM {_priced('contract')} p", "price")
def j2(v: Views):
    return pricing.black_scholes(v("contract")).select("contract_id", "price")


_G = ("delta", "gamma", "vega", "theta", "rho", "vomma")


@query("j3_greeks", f"""SELECT contract_id, CASE WHEN option_type = 'call' THEN n1 ELSE n1 - 1 END AS delta, p1 / (s * sigma * sqrt(t)) AS gamma, s * p1 * sqrt(t) AS vega,
  -s * p1 * sigma / (2 * sqrt(t)) + CASE WHEN option_type = 'call' THEN -r * k * disc * n2 ELSE r * k * disc * (1 - n2) END AS theta,
  CASE WHEN option_type = 'call' THEN k * t * disc * n2 ELSE -k * t * disc * (1 - n2) END AS rho, s * p1 * sqrt(t) * d1 * d2 / sigma AS vomma FROM {_priced('contract')} p""", " ".join(_G))
def j3(v: Views):
    return pricing.greeks(v("contract")).select("contract_id", *_G)


@query("j4_scenario_grid", f"""WITH g AS (SELECT contract_id, k, t, r, sigma, option_type, i::INT AS point, 500 + i * 1000.0::DOUBLE / 10 AS s FROM contract, range(11) x(i))
SELECT contract_id, point, s, {_PRICE} AS price FROM {_priced('g')} p""", "s price")
def j4(v: Views):
    grid = pricing.scenario_grid(v("contract"), "s", 500, 1500, 11)
    return pricing.black_scholes(grid).select("contract_id", "point", "s", "price")


@query("j5_gbm_paths")
def j5(v: Views):
    paths = pricing.gbm_paths(v("contract"), 200, 50)
    return paths.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg("last").alias("mean_last"), F.max("highest").alias("highest"))


_PATH = "(SELECT sim_id, step, 100 * exp(sum(-0.5::DOUBLE * 0.2 * 0.2 / 252 + 0.01 / 252 + 0.2::DOUBLE * sqrt(1 / 252.0::DOUBLE) * z) OVER (PARTITION BY sim_id ORDER BY step)) AS price FROM shocks)"


def _paths(v: Views):
    return pricing.apply_shocks(v("shocks"), 100.0, 0.01, 0.2, 1 / 252)


@query("j6_apply_shocks", f"SELECT * FROM {_PATH} p", "price")
def j6(v: Views):
    return _paths(v).select("sim_id", "step", "price")


@query("j7_barrier_payoff", f"SELECT sim_id, max(price) AS highest, arg_max(price, step) AS last, CASE WHEN max(price) > 150 THEN 0 ELSE greatest(arg_max(price, step) - 90, 0) END AS payoff FROM {_PATH} p GROUP BY sim_id", "highest last payoff")
def j7(v: Views):
    return pricing.barrier_payoff(_paths(v), 90, 150)


@query("j7_payoff", "SELECT contract_id, greatest(s - 1000, 0) AS call, greatest(1000 - s, 0) AS put FROM contract", "call put", 4)
def j7_plain(v: Views):
    both = pricing.payoff(v("contract"), "s", 1000).withColumnRenamed("payoff", "call")
    return pricing.payoff(both, "s", 1000, "put").select("contract_id", "call", F.col("payoff").alias("put"))


@query("j8_portfolio_var", "WITH s AS (SELECT sim_id, sum(3 * z - 2 * z * z) AS pnl FROM shocks GROUP BY sim_id) SELECT avg(pnl) AS mean_pnl, quantile_cont(pnl, 0.05) AS value_at_risk FROM s", "mean_pnl value_at_risk")
def j8(v: Views):
    return pricing.portfolio_var(v("shocks").select("sim_id", F.col("z").alias("a"), (F.col("z") * F.col("z")).alias("b")), {"a": 3, "b": -2}, 0.95)
