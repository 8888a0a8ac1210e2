"""Order-book tables: one row per order, many instruments.

A book is a table ``id, instrument, side, price, qty, ts`` of resting orders.
Priority is price, then time, then id. Everything is per instrument and built
from running sums and as-of lookups; no pair of orders is ever joined by
inequality.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.clean import round_to_tick
from marketloom.sources.durable import durable
from marketloom.sources.tables import rank_within, running

_c = F.col


def signed_price(side: Column = None, price: Column = None) -> Column:
    """Smaller is better for both sides: asks as they are, bids negated."""
    side, price = (F.col("side") if side is None else side), (F.col("price") if price is None else price)
    return F.when(side == "buy", -price).otherwise(price)


def depth(orders: DataFrame, n: int) -> DataFrame:
    """Quantity of the best ``n`` price levels of each side, level 1 first."""
    levels = orders.groupBy("instrument", "side", "price").agg(F.sum("qty").alias("qty"), F.count(F.lit(1)).alias("n_orders"))
    rank = F.row_number().over(Window.partitionBy("instrument", "side").orderBy(signed_price()))
    return levels.withColumn("level", rank).filter(_c("level") <= n)


def top_of_book(orders: DataFrame) -> DataFrame:
    """``best_bid, bid_qty, best_ask, ask_qty`` per instrument; null price and quantity 0 for an empty side."""
    levels = orders.groupBy("instrument", "side", "price").agg(F.sum("qty").alias("qty"))
    buy, sell = _c("side") == "buy", _c("side") == "sell"
    return levels.groupBy("instrument").agg(
        F.max(F.when(buy, _c("price"))).alias("best_bid"), F.coalesce(F.max_by(F.when(buy, _c("qty")), F.when(buy, _c("price"))), F.lit(0)).alias("bid_qty"),
        F.min(F.when(sell, _c("price"))).alias("best_ask"), F.coalesce(F.min_by(F.when(sell, _c("qty")), F.when(sell, _c("price"))), F.lit(0)).alias("ask_qty"),
    )


def mid_price(orders: DataFrame, tick: float) -> DataFrame:
    """The mean of best bid and ask, snapped to the tick; null if a side is empty."""
    return top_of_book(orders).select("instrument", round_to_tick((_c("best_bid") + _c("best_ask")) / 2, tick).alias("mid"))


def _opposite(side: Column) -> Column:
    return F.when(side == "buy", "sell").otherwise("buy")


def available(takers: DataFrame, orders: DataFrame) -> DataFrame:
    """Takers with ``available``: what rests opposite at their limit or better (all of it without a limit).

    Takers and price levels are stacked in price order; a running sum of level
    quantities is the answer at each taker's place.
    """
    levels = orders.groupBy("instrument", "side", "price").agg(F.sum("qty").alias("qty"))
    book = levels.select("instrument", "side", signed_price().alias("at"), _c("qty").cast("long").alias("add"), F.lit(0).alias("is_taker"), F.lit(None).cast("long").alias("taker_id"))
    limit = F.when(_c("price").isNull(), float("inf")).otherwise(signed_price(_opposite(_c("side"))))
    asks = takers.select("instrument", _opposite(_c("side")).alias("side"), limit.alias("at"), F.lit(0).cast("long").alias("add"), F.lit(1).alias("is_taker"), _c("id").alias("taker_id"))
    summed = running(book.unionByName(asks), ["instrument", "side"], ["at", "is_taker", "taker_id"], sums={"available": "add"})
    found = summed.filter("is_taker = 1").select("taker_id", "available")
    return takers.join(found, takers["id"] == found["taker_id"]).drop("taker_id")


def fok_feasible(takers: DataFrame, orders: DataFrame) -> DataFrame:
    """Whether each taker could be filled whole at once."""
    return available(takers, orders).withColumn("feasible", _c("available") >= _c("qty"))


def crossing_flags(takers: DataFrame, orders: DataFrame) -> DataFrame:
    """Whether a taker would trade at once, and whether it is rejected for being post-only."""
    top = top_of_book(orders).select("instrument", "best_bid", "best_ask")
    crosses = F.when(_c("side") == "buy", _c("best_ask").isNotNull() & (_c("price").isNull() | (_c("price") >= _c("best_ask")))).otherwise(_c("best_bid").isNotNull() & (_c("price").isNull() | (_c("price") <= _c("best_bid"))))
    return takers.join(top, "instrument", "left").withColumn("crosses", crosses).withColumn("rejected", _c("post_only") & _c("crosses")).drop("best_bid", "best_ask")


def judged_takers(takers: DataFrame, orders: DataFrame) -> DataFrame:
    """Takers with ``available, feasible, crosses, rejected``, computed once into the checkpoint folder."""
    return durable(crossing_flags(fok_feasible(takers, orders), orders))


def _fills(judged: DataFrame, orders: DataFrame) -> DataFrame:
    eligible = judged.filter(~_c("rejected") & ((_c("tif") != "FOK") | _c("feasible")))
    t = eligible.select("instrument", _c("id").alias("taker_id"), _opposite(_c("side")).alias("side"), _c("price").alias("limit"), _c("qty").alias("want"))
    # only what a taker of the other side can meet is laid out
    met = orders.join(t, ["instrument", "side"])
    reached = F.when(_c("side") == "sell", _c("price") <= _c("limit")).otherwise(_c("price") >= _c("limit"))
    met = met.filter(_c("limit").isNull() | reached).withColumn("signed", signed_price())
    ranked = running(met, ["instrument", "side"], ["signed", "ts", "id"], sums={"upto": "qty"})
    fill = F.greatest(F.lit(0), F.least(_c("qty"), _c("want") - (_c("upto") - _c("qty"))))
    return ranked.withColumn("fill", fill).filter("fill > 0").select("instrument", "taker_id", _c("id").alias("resting_id"), "price", "fill")


def _one_taker_each(judged: DataFrame) -> DataFrame:
    """The takers themselves, if no instrument has two."""
    crowded = judged.filter("instrument IS NOT NULL").groupBy("instrument").count().filter("count > 1").first()
    if crowded:
        raise ValueError(f"{crowded['count']} takers of instrument {crowded['instrument']}: sweep them one after another")
    return judged


def sweep_fills(takers: DataFrame, orders: DataFrame) -> DataFrame:
    """Fills of one taker per instrument: ``instrument, taker_id, resting_id, price, fill``.

    A running sum in price-time priority says what is ahead of each resting order
    that the taker's limit reaches; those before it in priority are reached too.
    A second taker of an instrument would meet what the first one left, which one
    sum can't say: it is an error.
    """
    return _fills(_one_taker_each(judged_takers(takers, orders)), orders)


def sweep(takers: DataFrame, orders: DataFrame) -> DataFrame:
    """Outcome per taker: quantity filled, mean price, remainder, and ``filled``, ``rests`` (the remainder stays), ``cancelled``, ``rejected`` or ``killed``."""
    judged = _one_taker_each(judged_takers(takers, orders))
    sums = _fills(judged, orders).groupBy("taker_id").agg(F.sum("fill").alias("filled_qty"), F.sum(_c("fill") * _c("price")).alias("paid"))
    out = judged.join(sums, judged["id"] == sums["taker_id"], "left").withColumn("filled_qty", F.coalesce("filled_qty", F.lit(0)))
    status = (
        F.when(_c("rejected"), "rejected").when((_c("tif") == "FOK") & ~_c("feasible"), "killed").when(_c("filled_qty") == _c("qty"), "filled")
        .when((_c("tif") == "IOC") | _c("price").isNull(), "cancelled").otherwise("rests")
    )
    return out.select("id", "instrument", "side", "qty", "filled_qty", F.try_divide("paid", "filled_qty").alias("mean_price"), (_c("qty") - _c("filled_qty")).alias("remainder"), status.alias("status"))


def uncross(orders: DataFrame) -> DataFrame:
    """Call auction: trades ``instrument, price, volume, buy_id, sell_id, initiator`` while bids reach asks.

    Each side is laid out by priority along its cumulative quantity. The ends of
    both sides' orders cut the common axis into segments, in each of which one bid
    meets one ask: found by filling backwards over the ordered ends. Segments
    trade at the mean of both prices while bid >= ask. The initiator is the side
    whose order has more left.
    """
    laid = orders.filter("qty > 0").withColumn("signed", signed_price())
    ends = running(laid, ["instrument", "side"], ["signed", "ts", "id"], sums={"end": "qty"})
    order = F.struct("id", "price", "end")
    of = lambda side: F.first(F.when(_c("side") == side, order), ignorenulls=True)
    cuts = ends.groupBy("instrument", "end").agg(of("buy").alias("b"), of("sell").alias("s"))
    # the order whose end comes next holds the segment, which begins where the one before it ended
    segments = running(cuts, ["instrument"], ["end"], nexts={"bid": "b", "ask": "s"}, lags={"before": "end"}).withColumn("begin", F.coalesce("before", F.lit(0)))
    crossing = segments.filter("bid.price >= ask.price")
    # what each order still has where the segment begins
    initiator = F.when(_c("bid.end") >= _c("ask.end"), "buy").otherwise("sell")
    return crossing.select("instrument", ((_c("bid.price") + _c("ask.price")) / 2).alias("price"), (_c("end") - _c("begin")).alias("volume"), _c("bid.id").alias("buy_id"), _c("ask.id").alias("sell_id"), initiator.alias("initiator"))


#: Trades of an instrument that one task searches, and stops that look through one such block in a task.
BLOCK_TRADES, BLOCK_STOPS = 4096, 200_000


def stop_triggers(stops: DataFrame, trades: DataFrame, quotes: DataFrame | None = None, *, block_trades: int = BLOCK_TRADES, block_stops: int = BLOCK_STOPS) -> DataFrame:
    """``id, trigger_ts`` and the order each stop becomes, null if it never triggers.

    A stop triggers when the last trade's price reaches it: buy stops at or above,
    sell stops at or below; at its arrival by the last trade before or at that
    time (by the best quote if there is none), later by the last trade of each
    time.

    An instrument's trades are cut into blocks of bounded size. A stop looks
    through the rest of the block in which it arrives; if nothing there reaches
    it, through the extremes of all later blocks, and then through the first
    block whose extreme does. Stops of one block are dealt out by a hash of their
    id, with a copy of the block, so that neither a busy instrument nor a crowd of
    stops gathers in one task. Stop ids are unique.
    """
    last = trades.groupBy("instrument", "ts").agg(F.max_by("price", "id").alias("price"))
    numbered = rank_within(last, ["instrument"], ["ts"], "__n")
    tape = durable(numbered.select("instrument", "ts", _c("price").cast("double").alias("price"), F.floor(_c("__n") / block_trades).cast("int").alias("block")))
    blocks = durable(tape.groupBy("instrument", "block").agg(F.min("ts").alias("ts"), F.max("price").alias("high"), F.min("price").alias("low")))

    # the block in which each stop arrives: the last one that has begun
    begins = blocks.select("instrument", "ts", F.lit(0).alias("is_stop"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("side"), F.lit(None).cast("double").alias("level"), "block")
    asking = stops.select("instrument", "ts", F.lit(1).alias("is_stop"), "id", "side", _c("stop_price").cast("double").alias("level"), F.lit(None).cast("int").alias("block"))
    placed = running(begins.unionByName(asking), ["instrument"], ["ts", "is_stop", "id"], lasts={"own_block": "block"})
    placed = placed.filter("is_stop = 1").select("instrument", "id", "side", "level", _c("ts").alias("arrival"), F.coalesce("own_block", F.lit(0)).alias("block"))
    in_block = durable(_search(durable(placed), tape, block_stops))

    # those that wait on: the first later block that reaches them, then the place in it
    waiting = in_block.filter("trigger IS NULL").drop("trigger", "first_price")
    found = durable(_next_block(waiting, blocks, block_stops))
    later = _search(found.filter("block >= 0"), tape, block_stops).select(_c("id").alias("later_id"), _c("trigger").alias("later"))
    matched = in_block.join(later, _c("id") == _c("later_id"), "left").withColumn("trigger", F.coalesce("trigger", "later"))
    if quotes is not None:
        q = quotes.select("instrument", "best_bid", "best_ask")
        quoted = matched.join(q, "instrument", "left")
        reached = F.when(_c("side") == "buy", _c("best_ask") >= _c("level")).otherwise(_c("best_bid") <= _c("level"))
        at_quote = _c("first_price").isNull() & F.coalesce(reached, F.lit(False))
        matched = quoted.withColumn("trigger", F.when(at_quote, _c("arrival")).otherwise(_c("trigger")))
    becomes = F.when(_c("type") == "stop", "market").otherwise("limit")
    when = matched.select("id", _c("trigger").alias("trigger_ts"))
    return stops.join(when, "id").select("id", "instrument", "side", "stop_price", "trigger_ts", F.when(_c("trigger_ts").isNotNull(), becomes).alias("becomes"))


def _salted(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``salt``: rows of a crowded key on the left are dealt over several, each with a copy of the right side."""
    crowds = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(_c("n") / most).cast("int")).drop("n")
    named = crowds.select(*[_c(k).alias(f"__{k}") for k in keys], "salts")
    same = [_c(k).eqNullSafe(_c(f"__{k}")) for k in keys]
    drop = [f"__{k}" for k in keys] + ["salts"]
    dealt = left.join(named, same).withColumn("salt", F.pmod(F.xxhash64("id"), _c("salts")).cast("int")).drop(*drop)
    copied = right.join(named, same).withColumn("salt", F.explode(F.sequence(F.lit(0), _c("salts") - 1))).drop(*drop)
    # columns of their own: the left side comes from the same tables
    return dealt, copied.select(*[_c(c).alias(c) for c in copied.columns])


def _kinds(df: DataFrame) -> str:
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    return f"instrument {kind['instrument']}, id {kind['id']}, side string, level double, arrival {kind['arrival']}, block int"


def _search(stops: DataFrame, tape: DataFrame, block_stops: int) -> DataFrame:
    """Stops with ``trigger`` and ``first_price`` (the last price at arrival) as far as the trades of their block tell."""

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("ts")
        out = left.drop(columns="salt").reset_index(drop=True)
        if not len(out):
            return out.assign(trigger=pd.Series(dtype="datetime64[ns]"), first_price=pd.Series(dtype=float))
        trigger, first, _ = first_reached(right["ts"].to_numpy(), right["price"].to_numpy(float), out["arrival"].to_numpy(), out["side"].to_numpy() == "buy", out["level"].to_numpy(float))
        return out.assign(trigger=trigger, first_price=pd.array(first, dtype="Float64") if len(first) else first)

    left, right = _salted(stops, tape, ["instrument", "block"], block_stops)
    schema = f"{_kinds(stops)}, trigger {stops.schema['arrival'].dataType.simpleString()}, first_price double"
    found = left.groupBy("instrument", "block", "salt").cogroup(right.groupBy("instrument", "block", "salt")).applyInPandas(look, schema)
    return found.withColumn("first_price", F.nanvl("first_price", F.lit(None).cast("double")))


def _next_block(stops: DataFrame, blocks: DataFrame, block_stops: int) -> DataFrame:
    """Stops with ``block`` moved on to the first later one whose extreme reaches them, -1 if none does."""

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("block")
        out = left.drop(columns="salt").reset_index(drop=True)
        buys, at = out["side"].to_numpy() == "buy", out["block"].to_numpy(np.int64)
        moved = np.full(len(out), -1, np.int64)
        for mine, sign, c in ((buys, 1.0, "high"), (~buys, -1.0, "low")):
            if mine.any() and len(right):
                moved[mine] = _first_at_least(_extremes(sign * right[c].to_numpy(float)), at[mine] + 1, sign * out["level"].to_numpy(float)[mine])
        return out.assign(block=moved.astype("int32"))

    left, right = _salted(stops, blocks, ["instrument"], block_stops)
    return left.groupBy("instrument", "salt").cogroup(right.groupBy("instrument", "salt")).applyInPandas(look, _kinds(stops))


def first_reached(times: np.ndarray, prices: np.ndarray, arrivals: np.ndarray, buys: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """When each stop is first reached on a tape in time order, the last price at its arrival, and the price that reached it.

    NaT and NaN where there is none. A sparse table of running extremes and a
    descent for all stops at once; no stop is compared with every trade.
    """
    at = np.searchsorted(times, arrivals, "right") - 1
    hit = np.full(len(arrivals), -1, np.int64)
    for mine, sign in ((buys, 1.0), (~buys, -1.0)):
        if mine.any() and len(times):
            hit[mine] = _first_at_least(_extremes(sign * prices), np.maximum(at[mine], 0), sign * levels[mine])
    found, when = hit >= 0, arrivals.astype("datetime64[ns]")
    when[~found] = np.datetime64("NaT")
    later = found & (hit > at)
    when[later] = times[hit[later]]
    price = np.full(len(arrivals), np.nan)
    price[found] = prices[hit[found]]
    first = np.full(len(arrivals), np.nan)
    first[at >= 0] = prices[at[at >= 0]]
    return when, first, price


def _extremes(x: np.ndarray) -> list[np.ndarray]:
    """Maxima over runs of 1, 2, 4, ... values."""
    out = [x]
    while 2 ** len(out) <= len(x):
        half = 2 ** (len(out) - 1)
        out.append(np.maximum(out[-1][:-half], out[-1][half:]))
    return out


def _first_at_least(table: list[np.ndarray], begin: np.ndarray, level: np.ndarray) -> np.ndarray:
    """For each start the first position with a value of at least ``level``, or -1; all starts descend together."""
    n, at = len(table[0]), begin.astype(np.int64).copy()
    for j in range(len(table) - 1, -1, -1):  # jump over runs that stay below, from long to short and twice
        for _ in range(2):
            ok = at + 2**j <= n
            skip = np.zeros(len(at), bool)
            skip[ok] = table[j][at[ok]] < level[ok]
            at[skip] += 2**j
    found = at < n
    found[found] &= table[0][at[found]] >= level[found]
    return np.where(found, at, -1)


def trade_pnl(trades: DataFrame, by: list[str]) -> DataFrame:
    """Cash flow of trades: buys pay, sells receive."""
    value = _c("price") * _c("qty")
    return trades.groupBy(*by).agg(F.sum(F.when(_c("side") == "buy", -value).otherwise(value)).alias("pnl"))


def trade_summary(trades: DataFrame) -> DataFrame:
    """Number, volume and last price per instrument."""
    return trades.groupBy("instrument").agg(F.count(F.lit(1)).alias("n_trades"), F.sum("qty").alias("volume"), F.max_by("price", F.struct("ts", "id")).alias("last_price"))
