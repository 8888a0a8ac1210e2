"""Streams in several micro-batches: late rows, repeated rows, stops that are pending across batches."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest

from marketloom.operators.book import first_reached
from marketloom.streaming import jobs

START = dt.datetime(2024, 1, 1)


@pytest.fixture
def play(spark, tmp_path):
    """Write batches as files in order and run a job over them one file at a time."""

    def run(batches, schema, job, mode="append"):
        source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{source}/b{i}")
            time.sleep(1.1)  # files are taken in the order of their times
        stream = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"))
        writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", state).outputMode(mode)
        if mode == "append":
            writer.format("parquet").start(out).awaitTermination(120)
        else:
            def twice(df, number):  # a batch may be run again
                for _ in range(2):
                    jobs.upsert_by_batch(out, ["instrument"])(df, number)

            writer.foreachBatch(twice).start().awaitTermination(120)
            return jobs.latest(spark, out, ["instrument"], stream.schema).collect()
        return spark.read.schema(stream.schema).parquet(out).collect()

    return run


def at(hours):
    return START + dt.timedelta(hours=hours)


def test_late_rows_are_left_out(play):
    rows = play([[(at(0.1), "a", 1.0), (at(0.5), "a", 3.0)], [(at(1.2), "a", 5.0), (at(9), "a", 7.0)], [(at(9.2), "a", 8.0)], [(at(0.2), "a", 100.0), (at(9.5), "a", 9.0)]], "ts timestamp, zone string, value double", jobs.stream_hourly_mean)
    assert {(r.hour, r.mean_value, r.n) for r in rows} == {(at(0), 2.0, 2), (at(1), 5.0, 1)}


def test_repeated_rows_are_dropped_across_batches(play):
    rows = play([[(at(0), "a", 1.0), (at(0), "a", 2.0)], [(at(0), "a", 3.0), (at(1), "a", 4.0)]], "ts timestamp, zone string, value double", jobs.stream_dedupe)
    assert sorted((r.ts, r.zone) for r in rows) == [(at(0), "a"), (at(1), "a")]


def test_running_trade_state(play):
    rows = play([[(1, 1, at(0), 10.0, 5)], [(1, 2, at(1), 11.0, 6), (2, 3, at(0), 1.0, 1)]], "instrument long, id long, ts timestamp, price double, qty long", jobs.stream_trade_state, "update")
    assert {tuple(r) for r in rows} == {(1, 11.0, 2, 11), (2, 1.0, 1, 1)}


def test_compacted_tables_take_further_batches(spark, tmp_path):
    schema, out, into = "k long, x double", str(tmp_path / "out"), str(tmp_path / "into")
    write = jobs.upsert_by_batch(out, ["k"])
    write(spark.createDataFrame([(1, 1.0), (2, 2.0)], schema), 0)
    write(spark.createDataFrame([(2, 5.0)], schema), 1)
    jobs.compact(spark, out, into, ["k"], schema)
    jobs.upsert_by_batch(into, ["k"])(spark.createDataFrame([(1, 7.0), (3, None)], schema), 2)
    assert sorted(map(tuple, jobs.latest(spark, into, ["k"], schema).collect())) == [(1, 7.0), (2, 5.0), (3, None)]


def test_stops_wait_across_batches(play):
    schema = "instrument long, kind string, id long, ts timestamp, side string, price double"
    batches = [
        [(1, "stop", 1, at(0), "buy", 12.0), (1, "stop", 2, at(0), "sell", 8.0), (1, "trade", 3, at(0.1), "buy", 10.0)],
        [(1, "trade", 4, at(0.5), "buy", 12.0), (1, "trade", 5, at(0.5), "buy", 11.0)],
        [(1, "trade", 6, at(0.6), "buy", 12.5), (1, "stop", 7, at(0.7), "buy", 12.0), (1, "stop", 8, at(0.7), "sell", 1.0)],
    ]
    rows = play(batches, schema, jobs.stream_stop_triggers)
    assert {(r.id, r.trigger_ts, r.trade_price) for r in rows} == {(1, at(0.6), 12.5), (7, at(0.7), 12.5)}


def test_stops_on_a_stream_equal_the_batch_search(spark, sf_dir):
    import __spark_entry__

    asked = __spark_entry__.queries()
    streamed = asked["m4_stream_stop_triggers"](spark, sf_dir).selectExpr("id", "date_format(trigger_ts, 'yyyy-MM-dd HH:mm:ss') AS ts").collect()
    from marketloom.operators import book
    from marketloom.sources.views import view

    batch = book.stop_triggers(view(spark, sf_dir, "stops"), view(spark, sf_dir, "trades")).filter("trigger_ts IS NOT NULL")
    batch = batch.selectExpr("id", "date_format(trigger_ts, 'yyyy-MM-dd HH:mm:ss') AS ts").collect()
    assert len(streamed) > 50 and sorted(map(tuple, streamed)) == sorted(map(tuple, batch))


def test_a_stop_after_a_quiet_hour_is_judged_by_the_last_trade(play):
    """The same tape in one batch and in several, with pauses and a stop sent again."""
    schema = "instrument long, kind string, id long, ts timestamp, side string, price double"
    batches = [
        [(1, "trade", 1, at(0), "buy", 10.0), (2, "trade", 2, at(0), "buy", 5.0)],
        [(1, "stop", 3, at(5), "buy", 9.0), (1, "stop", 4, at(5), "buy", 30.0), (2, "stop", 5, at(5), "sell", 4.0), (2, "stop", 6, at(5), "sell", 3.0)],
        [(2, "stop", 5, at(6), "sell", 2.0), (2, "trade", 7, at(7), "buy", 3.5)],
        [(1, "trade", 8, at(9), "buy", 29.9), (2, "trade", 9, at(9), "buy", 2.9)],
        [(1, "trade", 10, at(10), "buy", 30.0), (2, "trade", 11, at(11), "buy", 1.0)],
    ]
    rows = play(batches, schema, jobs.stream_stop_triggers)
    assert {(r.id, r.trigger_ts, r.trade_price) for r in rows} == {(3, at(5), 10.0), (4, at(10), 30.0), (6, at(9), 2.9), (5, at(11), 1.0)}


class Held:
    """A state in a dictionary that counts what is written."""

    def __init__(self):
        self.values, self.writes = {}, 0

    def get(self):
        return self.values[None]

    def exists(self):
        return bool(self.values)

    def update(self, value):
        self.updateValue(None, value)

    def getValue(self, key):  # noqa: N802
        return self.values[key]

    def containsKey(self, key):  # noqa: N802
        return key in self.values

    def updateValue(self, key, value):  # noqa: N802
        self.values[key], self.writes = value, self.writes + 1

    def removeKey(self, key):  # noqa: N802
        del self.values[key]
        self.writes += 1

    def keys(self):
        return list(self.values)


class Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Held())

    getValueState = getMapState  # noqa: N815


@pytest.mark.parametrize("most", [4096, 3])
def test_a_batch_touches_what_its_prices_reach(monkeypatch, most):
    """Random tapes in batches against one search, and the writes of a batch among thousands of stops."""
    monkeypatch.setattr(jobs, "MOST_BANDS", most)
    handle, rng = Handle(), np.random.default_rng(8)
    stops = jobs.PendingStops()
    stops.init(handle)
    levels, sides = np.round(rng.uniform(500, 1500, 3000), 1), rng.choice(["buy", "sell"], 3000)
    prices = np.round(1000 + np.cumsum(rng.normal(size=2000)), 1)
    when = [START + dt.timedelta(seconds=60 * i) for i in range(5000)]
    is_stop = np.concatenate((np.ones(1500, bool), rng.permutation(np.repeat([True, False], [1500, 2000]))))
    s, t, rows = iter(range(3000)), iter(range(2000)), []
    for i, stop in enumerate(is_stop):
        j = next(s) if stop else next(t)
        rows.append(("stop", j, when[i], sides[j], levels[j]) if stop else ("trade", 10_000 + j, when[i], "buy", prices[j]))
    table = pd.DataFrame(rows, columns=["kind", "id", "ts", "side", "price"])
    got, per_batch = {}, []
    for at_ in range(0, len(table), 50):
        before = sum(h.writes for h in handle.states.values())
        for out in stops.handleInputRows((1,), iter([table.iloc[at_ : at_ + 50]]), None):
            got |= {i: (ts, p) for i, ts, p in zip(out["id"], out["trigger_ts"], out["trade_price"], strict=True)}
        per_batch.append(sum(h.writes for h in handle.states.values()) - before)
    own, tape = table[table["kind"] == "stop"], table[table["kind"] == "trade"]
    hit, _, reached = first_reached(tape["ts"].to_numpy("datetime64[ns]"), tape["price"].to_numpy(), own["ts"].to_numpy("datetime64[ns]"), own["side"].to_numpy() == "buy", own["price"].to_numpy())
    want = {i: (ts, p) for i, ts, p in zip(own["id"], hit, reached, strict=True) if not np.isnat(ts)}
    assert got == want and len(want) > 1000
    assert max(per_batch[35:]) < 250 and len(handle.states["placed"].values) == 3000 - len(want)
