import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from tributary.operators import chunks, kv, partitioning, relational, transforms


def log(spark, *statements):
    return spark.createDataFrame([(i, 1, s) for i, s in enumerate(statements, 1)], "idx long, term long, sql string")


def test_statements_of_the_log(spark):
    df = log(spark, "SET testkey testvalue", "DELETE testkeydel", "INVALIDCMD foo bar", "GET querykey", "", None, "set  a   b  c ", "SET k", "SET", "DELETE a b", "GET")
    got = [(r.rows_affected, r.error) for r in kv.execute(df).orderBy("idx").collect()]
    assert got[:4] == [(1, None), (1, None), (0, "unrecognized statement type in EXECUTE: INVALIDCMD"), (0, "GET is a query")]
    assert got[4:6] == [(0, "empty statement")] * 2 and got[6:8] == [(1, None)] * 2
    assert [g[0] for g in got[8:]] == [0, 0, 0]
    values = {r.key: r.value for r in kv.state(df).collect()}
    assert values == {"testkey": "testvalue", "a": "b c", "k": ""}


def test_last_write_wins(spark):
    df = log(spark, "SET a 1", "SET b 1", "DELETE a", "SET b 2", "SET c x", "DELETE nothing", "DELETE c", "SET c y")
    assert sorted(map(tuple, kv.state(df).collect())) == [("b", "2", 4), ("c", "y", 8)]
    assert [tuple(r) for r in kv.get(df, "b").collect()] == [("b", "2")]
    assert kv.get(df, "nonexistingkey").collect() == [] and kv.state(log(spark).limit(0)).collect() == []


def test_log_bounds(spark):
    entries = spark.createDataFrame([(1, 1, 0, "first"), (2, 1, 0, "second"), (3, 2, 1, "third")], "idx long, term long, type int, data string")
    assert tuple(kv.first_last(entries).first()) == (1, 3) and tuple(kv.first_last(entries.limit(0)).first()) == (0, 0)
    assert tuple(kv.last_command(entries).first()) == (2, True) and tuple(kv.last_command(entries, 3, 9).first()) == (0, False)
    five = spark.range(1, 6).withColumnRenamed("id", "idx")
    assert [r[0] for r in kv.delete_range(five, 2, 4).orderBy("idx").collect()] == [1, 5]


def test_stale_reads(spark):
    rows = [  # now, contact, fsm update, appended, fsm idx, commit idx, freshness, strict, stale
        (100, 0, 0, 0, 1, 2, 0, True, False),
        (100, 90, 0, 0, 1, 2, 5, False, True),
        (100, 97, 0, 0, 1, 2, 5, False, False),
        (100, 97, 50, None, 1, 2, 5, True, False),
        (100, 97, 50, 10, 2, 2, 5, True, False),
        (100, 97, 50, 44, 1, 2, 5, True, True),
        (100, 97, 50, 45, 1, 2, 5, True, False),
    ]
    df = spark.createDataFrame(rows, "now long, a long, b long, c long, d long, e long, f long, g boolean, stale boolean")
    ts = lambda c: F.timestamp_seconds(c)
    got = df.select("stale", kv.is_stale(ts("now"), ts("a"), ts("b"), ts("c"), F.col("d"), F.col("e"), F.col("f") * 10**9, F.col("g")).alias("got")).collect()
    assert all(r.stale == r.got for r in got)


def test_snapshots(spark):
    df = spark.createDataFrame([(10, 2), (4, 3), (7, 3), (99, 1)], "idx long, term long")
    assert tuple(kv.snapshots_latest(df).first()) == (7, 3) and tuple(kv.snapshots_latest(df.limit(0)).first()) == (0, 0)
    assert sorted(tuple(r) for r in kv.snapshots_reap(df, 2).select("idx", "term").collect()) == [(10, 2), (99, 1)]


def test_upsert(spark):
    table = spark.createDataFrame([(1, 0, "a"), (2, 0, "b"), (3, 0, "c")], "id long, seq long, v string")
    changes = spark.createDataFrame([(1, 5, "x", False), (1, 4, "y", False), (2, 6, None, True), (4, 7, "new", False)], "id long, seq long, v string, gone boolean")
    assert sorted(tuple(r) for r in kv.upsert(table, changes, "id", "seq", "gone").collect()) == [(1, 5, "x"), (3, 0, "c"), (4, 7, "new")]


def split(data, size):
    if not data:
        return []
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return parts + [b""] if len(data) % size == 0 else parts


def test_chunks(spark):
    rnd = random.Random(1)
    data = [b"Hello, world!", b"Hello", b"", None, bytes(rnd.randrange(256) for _ in range(997)), "é".encode() * 7]
    df = spark.createDataFrame([(str(i), None if d is None else bytearray(d)) for i, d in enumerate(data)], "id string, data binary")
    for gzipped in (False, True):
        out = chunks.chunk(df, "id", "data", 5, gzipped)
        by = {}
        for r in out.orderBy("stream_id", "sequence_num").collect():
            by.setdefault(r.stream_id, []).append((r.sequence_num, r.is_last, gzip.decompress(bytes(r.data)) if gzipped and r.data else bytes(r.data)))
        for i, d in enumerate(data):
            parts = split(d, 5)
            assert by.get(str(i), []) == [(n, n == len(parts), p) for n, p in enumerate(parts, 1)]
        back = {r.stream_id: r for r in chunks.dechunk(out.repartition(4), gzipped).collect()}
        assert {k: bytes(r.data) for k, r in back.items()} == {str(i): d for i, d in enumerate(data) if d}
        assert all(r.error is None for r in back.values())


def test_broken_streams(spark):
    rows = [("gap", 1, False), ("gap", 3, True), ("twice", 1, False), ("twice", 1, True), ("open", 1, False), ("late", 2, True)]
    df = spark.createDataFrame([(s, n, e, bytearray(b"x")) for s, n, e in rows], "stream_id string, sequence_num long, is_last boolean, data binary")
    got = {r.stream_id: (r.data, r.error) for r in chunks.dechunk(df).collect()}
    assert got == {"gap": (None, "chunks out of order"), "twice": (None, "chunks out of order"), "open": (None, "no last chunk"), "late": (None, "chunks out of order")}


def test_compression_rule(spark):
    df = spark.createDataFrame([(0, ["select 1"]), (1, ["x"] * 50), (2, ["y" * 1024]), (3, ["z" * 1023])], "i int, s array<string>")
    assert [r[0] for r in df.orderBy("i").select(chunks.worth_compressing(F.col("s"))).collect()] == [False, True, True, False]
    data = spark.createDataFrame([(0, bytearray(b"a" * 5000)), (1, bytearray(b"abc")), (2, None)], "i int, data binary")
    got = chunks.compress_if_smaller(data, "data", F.lit(True)).orderBy("i").collect()
    assert [r.compressed for r in got] == [True, False, False] and gzip.decompress(bytes(got[0].data)) == b"a" * 5000
    forced = chunks.compress_if_smaller(data, "data", F.lit(False), force=True).orderBy("i").collect()
    assert forced[1].compressed and gzip.decompress(bytes(forced[1].data)) == b"abc"
    assert [r[0] for r in chunks.compress_if_smaller(data, "data", F.lit(False)).select("compressed").collect()] == [False] * 3


def test_routing(spark):
    df = spark.createDataFrame([(f"payload {i}",) for i in range(200)] + [(None,)], "t string")
    dealt = partitioning.partition_by_hash(df, "t", 5)
    assert dealt.rdd.getNumPartitions() == 5
    where = dealt.withColumn("at", F.spark_partition_id()).select("partition_id", "at").collect()
    assert all(r.partition_id == r.at for r in where) and {r.at for r in where} == set(range(5))
    own = partitioning.with_partition(df, "t", 3, lambda c, n: F.pmod(F.length(c), F.lit(n)))
    assert {r[0] for r in own.select("partition_id").collect()} <= {0, 1, 2, None}
    with pytest.raises(ValueError):
        partitioning.with_partition(df, "t", 0)


def test_chains(spark):
    chain = transforms.Chain().add(transforms.Step("a", lambda df: df.where("id > 2"))).add(transforms.Step("b", lambda df: df.withColumn("id", F.col("id") * 10)))
    assert [r[0] for r in chain.apply(spark.range(5)).orderBy("id").collect()] == [30, 40]
    assert chain.parent("b").id == "a" and chain.parent("a") is None
    with pytest.raises(ValueError):
        chain.add(transforms.Step("a", lambda df: df))


def test_upper_payload_without_a_schema(spark):
    df = spark.createDataFrame([('{"a": "x", "l": ["y"]}',), (None,), ("plain",)], "p string")
    got = [r.p for r in transforms.upper_payload(df, "p").collect()]
    assert json.loads(got[0]) == {"a": "X", "l": ["y"]} and got[1:] == ["plain"]


def test_asof_with_tolerance_and_ties(spark):
    a = spark.createDataFrame([(1, "k", 10), (2, "k", 30), (3, "z", 5)], "id long, k string, t long")
    b = spark.createDataFrame([("k", 10, 1), ("k", 10, 2), ("k", 12, 3), ("y", 1, 9)], "k string, t long, v long")
    got = {r.id: r.v for r in relational.asof_join(a, b, "t", "k", ["v"]).collect()}
    assert got == {1: 2, 2: 3, 3: None}
    for width in (1, 7, 1000):
        assert {r.id: r.v for r in relational.asof_join(a, b, "t", "k", ["v"], block=lambda c, w=width: F.floor(c / w)).collect()} == got
    got = {r.id: r.v for r in relational.asof_join(a, b, "t", "k", ["v"], F.lit(5)).collect()}
    assert got == {1: 2, 2: None, 3: None}


def test_interval_and_range_joins(spark):
    rnd = random.Random(2)
    a = [(i, rnd.choice("xy"), s := rnd.randint(0, 200), s + rnd.randint(1, 60)) for i in range(120)]
    df = spark.createDataFrame(a, "id long, k string, start long, end long")
    got = sorted((r.id, r.r_id) for r in relational.interval_overlap_join(df, df, "k", 25).collect())
    assert got == sorted((p[0], q[0]) for p in a for q in a if p[1] == q[1] and p[2] < q[3] and q[2] < p[3])
    points = spark.createDataFrame([(i, rnd.random() * 100) for i in range(100)], "pid long, x double")
    ranges = spark.createDataFrame([(i, lo := rnd.random() * 90, lo + rnd.random() * 12) for i in range(40)], "rid long, lo double, hi double")
    want = sorted((p.pid, r.rid) for p in points.collect() for r in ranges.collect() if r.lo <= p.x <= r.hi)
    assert sorted((r.pid, r.rid) for r in relational.range_join(points, ranges, "x", "lo", "hi", 5.0).collect()) == want


def test_range_join_of_odd_rows(spark, monkeypatch):
    """Copies, nulls, NaN, both zeros, ranges the wrong way round; cells and blocks of a few rows."""
    monkeypatch.setattr(relational, "BLOCK", 3)
    monkeypatch.setattr(relational, "CELL", 7)
    rnd = random.Random(5)
    xs = [0.0, -0.0, 1.5, 9.99, 10.0, -3.0, float("nan"), None]
    p = [(rnd.randrange(30), rnd.choice("ab"), rnd.choice(xs)) for _ in range(300)] + [(1, None, 1.5)] + [(99, "a", 1.5)] * 70
    r = [(rnd.randrange(30), rnd.choice("ab"), lo := rnd.choice([-3.0, 0.0, -0.0, 1.5, 7.0, None]), None if lo is None else lo + rnd.choice([0, 2.5, 40, -1])) for _ in range(200)] + [(2, None, 0.0, 9.0), (3, "a", 0.0, None)]
    points = spark.createDataFrame(p, "pid long, k string, x double")
    ranges = spark.createDataFrame(r, "rid long, k string, lo double, hi double")
    made = relational.range_join(points, ranges, "x", "lo", "hi", 5.0, by=["k"])
    assert made.columns == ["k", "pid", "x", "rid", "lo", "hi"]
    want = [(k, i, x, j, lo, hi) for i, k, x in p for j, k2, lo, hi in r if k and k == k2 and None not in (x, lo, hi) and lo <= x <= hi]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want)) and len(want) > 5000


def test_range_join_of_many_pairs(spark, tmp_path):
    """Few rows that give many pairs are the work of several tasks, and what is written is a small part of a byte a pair."""
    points = spark.range(50).select(F.col("id").alias("pid"), (F.col("id") % 2 / 100).alias("x")).coalesce(1)
    ranges = spark.range(40_000).select(F.col("id").alias("rid"), F.lit(0.0).alias("lo"), (F.lit(0.01) + F.col("id") % 3 / 100).alias("hi")).coalesce(1)
    relational.range_join(points, ranges, "x", "lo", "hi", 0.1).select("pid", "rid").write.parquet(f"{tmp_path}/pairs")
    back = spark.read.parquet(f"{tmp_path}/pairs")
    assert back.count() == back.distinct().count() == 2_000_000
    sizes = [f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")]
    assert sum(sizes) < 0.5 * 2_000_000
    assert back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 1_500_000


def test_payload_schemas(spark):
    from tributary.sources import formats

    texts = ['{"a": 1, "b": "x"}', '{"a": 1.5, "b": "x"}', '{"a": null, "b": null}', '{"a": 1}', "[1]", None, '{"a": 2, "b": "y", "c": 3}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(formats.conforms(F.col("t"), "a int, b string")).collect()][2:] == [True, False, False, False, True]
    assert df.select(formats.decode(F.col("t"), "json", "a int, b string").alias("x")).first().x.asDict() == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        formats.decode(F.col("t"), "tape", "a int")
    grown = formats.evolve(spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2.5, True)], "a double, c boolean"))
    assert sorted(map(tuple, grown.collect()), key=str) == [(1.0, "x", None), (2.5, None, True)]
    with pytest.raises(ValueError):
        formats.evolve(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([("x",)], "a string"))
    waits, calls = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert formats.retried(work, sleep=waits.append) == "done" and len(waits) == 2 and waits[0] <= 0.1
    with pytest.raises(OSError):
        formats.retried(lambda: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)


def test_running_sums_in_blocks(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.choice([None, 1, 2, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    want = sorted(map(str, relational.running(df, "k", ["i"], "v").collect()))
    for width in (1, 13, 500):
        assert sorted(map(str, relational.running(df, "k", ["i"], "v", lambda c, w=width: F.floor(c / w)).collect())) == want
    sums, held = {}, {}
    for r in relational.running(df, "k", ["i"], "v").orderBy("i").collect():
        if r.v is not None:
            sums[r.k], held[r.k] = sums.get(r.k, 0) + r.v, held.get(r.k, 0) + 1
        assert (r.running_sum, r.running_n) == (sums.get(r.k), held.get(r.k, 0))


def test_rendezvous_moves_few(spark):
    from tributary.functions.hashing import rendezvous

    rows = spark.range(3000).select(rendezvous(F.col("id"), 5).alias("a"), rendezvous(F.col("id"), 6).alias("b")).collect()
    assert {r.a for r in rows} == set(range(5)) and all(r.a == r.b or r.b == 5 for r in rows)
    assert 350 < sum(r.b == 5 for r in rows) < 650


def test_log_appends_once(spark, tmp_path):
    path = f"{tmp_path}/log"
    log = spark.createDataFrame([(1, 0)], "idx long, type int")
    log.write.parquet(path)
    log = spark.read.parquet(path)
    for _ in range(2):
        log = kv.append(log, spark.createDataFrame([(1, 5), (2, 0)], "idx long, type int"), path)
    assert sorted(map(tuple, log.collect())) == [(1, 0), (2, 0)]
    with pytest.raises(ValueError):
        kv.use_store(spark, "tape")
