import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def same(spark, query, sql, sf_dir="/root/testdata/sf0.01"):
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    con = connect(sf_dir)
    want = con.execute(sql)
    assert sorted(d[0] for d in want.description) == names
    at = [[d[0] for d in want.description].index(n) for n in names]
    a = sorted(repr(tuple(r[n] for n in names)) for r in got.collect())
    b = sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
    assert len(a) == len(b)
    assert a == b
