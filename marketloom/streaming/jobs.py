"""Structured Streaming forms of the event jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from marketloom.operators.book import first_reached


def stream_hourly_mean(sdf: DataFrame, delay: str = "2 hours", ts: str = "ts", key: str = "zone", value: str = "value") -> DataFrame:
    """Hourly mean per zone; rows later than ``delay`` behind the newest are left out, an hour is given out once it is over."""
    mean = sdf.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour"), key).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))
    return mean.select(F.col("window.start").alias("hour"), key, "mean_value", "n")


def stream_dedupe(sdf: DataFrame, delay: str = "2 hours", ts: str = "ts", keys: tuple[str, ...] = ("zone", "ts")) -> DataFrame:
    """Repeated (zone, time) rows are dropped; the state forgets what the watermark has passed."""
    return sdf.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_trade_state(sdf: DataFrame, key: str = "instrument") -> DataFrame:
    """Running last price, number and volume of trades per instrument (update mode with ``upsert_by_batch``, or complete mode)."""
    return sdf.groupBy(key).agg(F.max_by("price", F.struct("ts", "id")).alias("last_price"), F.count(F.lit(1)).alias("n_trades"), F.sum("qty").alias("volume"))


#: Price bands per unit of the logarithm, in which stops wait together: about 0.4 percent of the price each.
BANDS = 256
#: Beyond that many bands between two prices the bands that hold stops are listed instead.
MOST_BANDS = 4096
_LONG_AGO = np.datetime64("1678-01-01", "ns")


def bands_of(prices: np.ndarray) -> np.ndarray:
    """Numbers of price bands, in the order of the prices."""
    return np.floor(np.sign(prices) * np.log1p(np.abs(prices)) * BANDS).astype(np.int64)


class PendingStops(StatefulProcessor):
    """Stops of one instrument, waiting by side and price band.

    State: the last price (kept for good), for each side and band the ids and prices
    that wait there, for each waiting id its side and band, and how near to the price the first band is on either
    side. A batch reads and writes the bands that its prices reach and those its new stops go to; all others stay untouched.
    """

    FAR = 1 << 40

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price double")
        self.edges = handle.getValueState("edges", "buys long, sells long")
        self.bands = handle.getMapState("bands", "side string, band long", "ids array<long>, prices array<double>")
        self.placed = handle.getMapState("placed", "id long", "side string, band long")

    def close(self) -> None:
        pass

    def _reached(self, side: str, low: int, high: int) -> list[int]:
        """Bands from ``low`` to ``high`` where stops of a side wait."""
        if high - low > MOST_BANDS:
            return sorted(b for s, b in self.bands.keys() if s == side and low <= b <= high)
        return [b for b in range(low, high + 1) if self.bands.containsKey((side, b))]

    def _taken(self, side: str, bands: list[int], held: dict) -> None:
        for b in bands:
            if (side, b) not in held:
                held[side, b] = list(zip(*self.bands.getValue((side, b)), strict=True)) if self.bands.containsKey((side, b)) else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        table = pd.concat(list(rows)).dropna(subset=["price"]).sort_values(["ts", "id"])
        table["ts"] = table["ts"].astype("datetime64[ns]")
        new, traded = table[table["kind"] == "stop"].drop_duplicates("id", keep="last"), table[table["kind"] != "stop"].drop_duplicates("ts", keep="last")
        times, path = traded["ts"].to_numpy(), traded["price"].to_numpy(float)
        low, high = self.edges.get() if self.edges.exists() else (self.FAR, -self.FAR)
        held: dict[tuple[str, int], list[tuple[int, float]]] = {}  # bands of this batch as they were, then as they are left
        for i in new["id"].tolist():  # a stop that is sent again takes the place of the one that waits
            if self.placed.containsKey((i,)):
                side, band = self.placed.getValue((i,))
                self._taken(side, [band], held)
                held[side, band] = [x for x in held[side, band] if x[0] != i]
                self.placed.removeKey((i,))
        waiting = []
        if len(path):
            bottom, top = bands_of(np.array([path.min(), path.max()])).tolist()
            for side, bands in (("buy", self._reached("buy", low, top)), ("sell", self._reached("sell", bottom, high))):
                self._taken(side, bands, held)
                for b in bands:
                    waiting += [(i, side, price, _LONG_AGO, False) for i, price in held[side, b]]
                    held[side, b] = []
            low, high = max(low, top + 1), min(high, bottom - 1)
        waiting += [(i, side, price, ts, True) for i, side, price, ts in zip(new["id"].tolist(), new["side"], new["price"].astype(float), new["ts"].to_numpy(), strict=True)]
        if self.last.exists():
            times, path = np.concatenate(([_LONG_AGO], times)), np.concatenate((self.last.get(), path))
        stops = pd.DataFrame(waiting, columns=["id", "side", "price", "ts", "is_new"])
        levels, arrivals = stops["price"].to_numpy(float), stops["ts"].to_numpy().astype("datetime64[ns]")
        when, _, reached = first_reached(times, path, arrivals, stops["side"].to_numpy() == "buy", levels)
        hit = ~np.isnat(when)
        for row, band in zip(stops[~hit].itertuples(), bands_of(levels[~hit]).tolist(), strict=True):
            self._taken(row.side, [band], held)
            held[row.side, band].append((row.id, row.price))
            if row.is_new:
                self.placed.updateValue((row.id,), (row.side, band))
            low, high = (min(low, band), high) if row.side == "buy" else (low, max(high, band))
        for row in stops[hit & ~stops["is_new"].to_numpy(bool)].itertuples():
            self.placed.removeKey((row.id,))
        for place, stay in held.items():
            if stay:
                self.bands.updateValue(place, ([i for i, _ in stay], [x for _, x in stay]))
            elif self.bands.containsKey(place):
                self.bands.removeKey(place)
        self.edges.update((low, high))
        if len(path):
            self.last.update((float(path[-1]),))
        done = stops[hit]
        yield pd.DataFrame({"instrument": key[0], "id": done["id"].astype("int64"), "side": done["side"], "stop_price": levels[hit], "trigger_ts": when[hit], "trade_price": reached[hit]})


def stream_stop_triggers(sdf: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Pending stops per instrument, given out when a trade's price reaches them.

    Input rows: ``instrument, kind ('stop' or 'trade'), id, ts, side, price``; a
    stop's price is its stop price. Within a micro-batch rows count in the order of time, then id; of
    trades at one time only the last sets the price. Rows later than ``delay``, and rows without a price, are
    left out. Stops and the last price wait for as long as it takes. The session needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    schema = "instrument long, id long, side string, stop_price double, trigger_ts timestamp, trade_price double"
    return sdf.withWatermark("ts", delay).groupBy("instrument").transformWithStateInPandas(PendingStops(), schema, "Append", "EventTime")


def upsert_by_batch(out: str, keys: list[str]):
    """A ``foreachBatch`` function for update mode: the rows of a batch as a folder named by its number.

    A batch that is run again replaces its own folder, so nothing counts twice. ``latest`` reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(keys).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return write


def latest(spark: SparkSession, out: str, keys: list[str], schema: str | StructType) -> DataFrame:
    """Of each key the row of the last batch that changed it."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(StructType([*fields.fields, StructField("batch", LongType())])).parquet(out)
    others = [f.name for f in fields.fields if f.name not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("__last"))
    return last.select(*[F.col(f.name) if f.name in keys else F.col(f"__last.{f.name}").alias(f.name) for f in fields.fields])


def compact(spark: SparkSession, out: str, into: str, keys: list[str], schema: str | StructType) -> None:
    """Write the table as it stands to ``into``, as one batch that later ones can follow."""
    latest(spark, out, keys, schema).write.mode("overwrite").parquet(f"{into}/batch=-1")
