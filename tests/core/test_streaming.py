import time

from pyspark.sql import functions as F

from tributary.operators import kv
from tributary.streaming import windows

D = "/root/testdata/sf0.001"


def ordered_files(spark, tmp_path, n=4):
    """events as files in order of time, written one after the other."""
    ev = spark.read.parquet(f"{D}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = [r[0] for r in ev.selectExpr(f"percentile(cast(ts as double), array({', '.join(str(i / n) for i in range(1, n))}))").collect()][0]
    lows, highs = [None, *bounds], [*bounds, None]
    for low, high in zip(lows, highs, strict=True):
        part = ev
        if low is not None:
            part = part.where(F.col("ts").cast("double") >= low)
        if high is not None:
            part = part.where(F.col("ts").cast("double") < high)
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    return ev, spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events")


def collect(stream, tmp_path, mode="append"):
    out = []
    windows.run_once(stream, lambda df, _: out.extend(df.collect()), f"{tmp_path}/ck-{len(list(tmp_path.iterdir()))}", mode)
    return out


def test_closed_windows_are_the_batch_ones(spark, tmp_path):
    batch, stream = ordered_files(spark, tmp_path)
    want = {tuple(r) for r in windows.tumbling(batch, "ts", "1 day", [], F.count(F.lit(1)).alias("n")).collect()}
    got = collect(windows.tumbling(windows.timed(stream, "ts", "1 hour"), "ts", "1 day", [], F.count(F.lit(1)).alias("n")), tmp_path)
    assert {tuple(r) for r in got} <= want and len(got) >= len(want) - 2


def test_sessions_and_dedup(spark, tmp_path):
    batch, stream = ordered_files(spark, tmp_path)
    want = {tuple(r) for r in windows.sessions(batch, "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n")).collect()}
    got = collect(windows.sessions(windows.timed(stream, "ts", "1 hour"), "ts", "30 minutes", ["user_id"], F.count(F.lit(1)).alias("n")), tmp_path)
    assert {tuple(r) for r in got} <= want and len(got) > 0.8 * len(want)
    once = collect(windows.distinct_by(windows.timed(stream, "ts", "60 days"), ["user_id"]), tmp_path)
    assert len(once) == batch.select("user_id").distinct().count()


def test_stream_stream_join(spark, tmp_path):
    batch, stream = ordered_files(spark, tmp_path)
    side = lambda df, kind: df.where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    pairs = lambda df: {(r.a, r.b) for r in df}
    join = lambda x: windows.join_within(side(x, "view"), side(x, "purchase"), "user_id", "ts", "ts", "3 hours").select(F.col("l.event_id").alias("a"), F.col("r.event_id").alias("b"))
    assert pairs(collect(join(windows.timed(stream, "ts", "6 hours")), tmp_path)) == pairs(join(batch).collect())


def test_key_value_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    batch, stream = ordered_files(spark, tmp_path)
    change = lambda df: df.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), F.col("event_type").alias("value"))
    out = {}
    for r in collect(windows.last_writes(change(stream)), tmp_path, "update"):
        if r.seq > out.get(r.key, (-1,))[0]:
            out[r.key] = (r.seq, r.op, r.value)
    want = {r.key: tuple(r.last) for r in change(batch).groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("last")).collect()}
    assert out == want


def test_late_rows_follow_arrival(spark):
    rows = [(i, t) for i, t in enumerate([100, 200, 150, 95, 300, 239, 240])]
    df = spark.createDataFrame(rows, "arrival long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = [r.late for r in windows.split_late(df, "ts", "arrival", "60 seconds").orderBy("arrival").collect()]
    assert got == [False, False, False, True, False, True, False]
    wide = df.withColumn("arrival", F.col("arrival") * 70_000)
    assert [r.late for r in windows.split_late(wide, "ts", "arrival", "60 seconds").orderBy("arrival").collect()] == got


def test_patterns(spark):
    rows = [("u", i, k) for i, k in enumerate("abcabxabc")] + [("v", 0, "a"), ("v", 1, "b")]
    df = spark.createDataFrame(rows, "u string, i long, k string").withColumn("ts", F.timestamp_seconds(F.col("i") * 10))
    assert sorted(r.i for r in windows.follows(df, "u", ["i"], "k", ["a", "b", "c"]).collect()) == [0, 6]
    assert windows.follows(df, "u", ["i"], "k", ["a", "b", "c"], "ts", "15 seconds").collect() == []


def test_a_pattern_across_batches(spark, tmp_path):
    batch, stream = ordered_files(spark, tmp_path)
    events = stream.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.unix_millis("ts").alias("at_ms"))
    with kv.stored_in(spark, "rocksdb"):
        got = collect(windows.follows_in_stream(events, ["view", "click"], 3_600_000 * 24), tmp_path)
    want = windows.follows(batch.withColumn("ts", F.timestamp_millis(F.unix_millis("ts"))), "user_id", ["ts", "event_id"], "event_type", ["view", "click"], "ts", "24 hours")
    assert sorted(r.id for r in got) == sorted(r.event_id for r in want.collect()) and got


def test_maps_and_lists_by_key(spark, tmp_path):
    rows = [
        [("k", 1, "put", "b", "1"), ("k", 2, "put", "a", "0"), ("k", 3, "get", "b", None), ("j", 4, "get", "b", None)],
        [("k", 5, "put", "c", "2"), ("k", 6, "range", "a", "c"), ("k", 7, "delete", "a", None), ("k", 8, "get", "a", None), ("k", 9, "append", None, "x")],
        [("k", 10, "append", None, "y"), ("k", 11, "all", None, None), ("k", 12, "range", "a", "z"), ("j", 13, "all", None, None)],
    ]
    schema = "key string, seq long, op string, field string, value string"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/requests")
        time.sleep(1.1)  # files are read in order of their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/requests")
    with kv.stored_in(spark, "rocksdb"):
        got = collect(windows.keyed_fields(stream), tmp_path)
    assert sorted((r.seq, r.key, r.field, r.value) for r in got) == [(3, "k", "b", "1"), (6, "k", "a", "0"), (6, "k", "b", "1"), (11, "k", "0", "x"), (11, "k", "1", "y"), (12, "k", "b", "1"), (12, "k", "c", "2")]


def test_late_rows_are_kept_apart(spark, tmp_path):
    for hours in ([0, 5, 3], [4, 6, 1], [2, 9]):
        spark.createDataFrame([(h, f"2024-01-01 {h:02d}:00:00") for h in hours], "h int, t string").selectExpr("h", "cast(t as timestamp) as ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema("h int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    on_time, late = windows.route_late(stream, "ts", "2 hours", f"{tmp_path}/out")
    assert sorted(r.h for r in on_time.collect()) == [0, 3, 4, 5, 6, 9] and sorted(r.h for r in late.collect()) == [1, 2]
    assert on_time.columns == ["h", "ts"]


def test_the_sessions_store_holds_again(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    with kv.stored_in(spark, "rocksdb"):
        assert "RocksDB" in spark.conf.get(key)
    assert spark.conf.get(key) == was
