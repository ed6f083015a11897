"""Every query of the catalogue against its SQL."""

import datetime as dt

import duckdb
import pytest

from tributary import queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, list):
        return [plain(v) for v in x]
    if isinstance(x, float):
        return round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, con, name):
    got = queries.QUERIES[name](spark, D)
    names = sorted(got.columns)
    result = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = sorted(repr([plain(r[columns.index(n)]) for n in names]) for r in result.fetchall())
    assert sorted(repr([plain(r[n]) for n in names]) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["join_interval", "win_range_frame"])
def test_seconds_of_parts_of_a_second(spark, tmp_path, name):
    """Times an hour or a bit more or less apart: SQL rounds to seconds, halves to the even one."""
    start, parts = dt.datetime(2024, 1, 1), [0, 499_999, 500_000, 500_001, 999_999]
    times = [start + dt.timedelta(seconds=s, microseconds=us) for s in (0, 1, 2, 3600, 3601, 3602) for us in parts] + [dt.datetime(1969, 12, 31, 23, 59, 58, us) for us in parts]
    rows = [(i, t, i % 2, "view", 1.0, "{}") for i, t in enumerate(times)] + [(len(times), None, 0, "view", 1.0, "{}")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    result = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).select(columns).collect())) == sorted(result.fetchall())
