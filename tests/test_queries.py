"""Every registered query against its DuckDB SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = list(__spark_entry__.queries())


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return str(x)[:19] if hasattr(x, "isoformat") else x


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, duck, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert len(df.columns) > 0
        return
    want = duck.sql(sql)
    at = [want.columns.index(c) for c in columns]
    assert sorted(want.columns) == columns
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_log_shift_where_it_is_infinite_or_missing(spark, tmp_path):
    # ids that are 18, 19, 20 and 21 modulo 41 multiply the value by -2, -1, 0 and 1
    values = {18: "0.5", 19: "1", 20: "1", 21: "-1", 59: "0.5", 60: "2", 61: "'Infinity'", 62: "'Infinity'", 101: "'Infinity'", 103: "'NaN'", 144: "NULL"}
    rows = ", ".join(f"({i}::BIGINT, TIMESTAMP '2024-01-01 00:00:00', 1::BIGINT, 'click', {v}::DOUBLE)" for i, v in values.items())
    con = duckdb.connect()
    con.sql(f"COPY (SELECT * FROM (VALUES {rows}) e(event_id, ts, user_id, event_type, value)) TO '{tmp_path}/events.parquet'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = {r.event_id: (plain(r.log_abs), plain(r.log_plain)) for r in __spark_entry__.queries()["b15_log_shift"](spark, str(tmp_path)).collect()}
    want = con.sql(__spark_entry__.oracle_sql()["b15_log_shift"]).select("event_id", "log_abs", "log_plain").fetchall()
    assert got == {i: (plain(a), plain(b)) for i, a, b in want}
    assert got[18] == got[19] == got[21] == (-math.inf, None)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(NAMES)
