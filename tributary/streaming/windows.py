"""Event-time windows, late data, deduplication and joins of streams. All but the state machine run on batches too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def timed(df: DataFrame, ts: str, lateness: str | None = None) -> DataFrame:
    """df with ts as a timestamp with a zone, which watermarks need, and a watermark if lateness is given."""
    df = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df.withWatermark(ts, lateness) if lateness else df


def _flat(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in df.columns if c != "window"])


def tumbling(df: DataFrame, ts: str, size: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per window of size and keys, as window_start, window_end, keys, aggregates."""
    return _flat(df.groupBy(F.window(ts, size).alias("window"), *keys).agg(*aggregates))


def sliding(df: DataFrame, ts: str, size: str, slide: str, keys: list[str], *aggregates: Column) -> DataFrame:
    return _flat(df.groupBy(F.window(ts, size, slide).alias("window"), *keys).agg(*aggregates))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggregates: Column) -> DataFrame:
    """Aggregates per run of rows less than gap apart."""
    return _flat(df.groupBy(F.session_window(ts, gap).alias("window"), *keys).agg(*aggregates))


def split_late(df: DataFrame, ts: str, arrival: str, lateness: str) -> DataFrame:
    """df with late: whether a row came when a row later by more than lateness had arrived before it.

    arrival orders the rows. The running maximum is taken in blocks of arrival and then carried over them, so no task
    orders all rows; one task sees a row for each block of 65,536, which holds up to some 10^12 rows.
    """
    from pyspark.sql import Window as W

    block = F.floor(F.col(arrival) / 65_536)
    marked = df.withColumn("__block", block)
    tops = marked.groupBy("__block").agg(F.max(ts).alias("__top"))
    before = tops.select("__block", F.max("__top").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    within = F.max(ts).over(W.partitionBy("__block").orderBy(arrival).rowsBetween(W.unboundedPreceding, -1))
    out = marked.withColumn("__within", within).join(before, "__block")
    top = F.greatest("__within", "__before")
    return out.withColumn("late", F.coalesce(F.col(ts) < top - F.expr(f"interval {lateness}"), F.lit(False))).drop("__block", "__within", "__before")


def distinct_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each value of keys; in a stream with a watermark, within its bound."""
    return df.dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


def join_within(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, interval: str, how: str = "inner") -> DataFrame:
    """Rows of equal key whose right time is at or after the left one by interval at most. Watermarks on both sides, if
    they are streams, bound the state."""
    a, b = left.alias("l"), right.alias("r")
    near = F.col(f"r.{right_ts}").between(F.col(f"l.{left_ts}"), F.col(f"l.{left_ts}") + F.expr(f"interval {interval}"))
    return a.join(b, (F.col(f"l.{key}") == F.col(f"r.{key}")) & near, how)


class LastWrite(StatefulProcessor):
    """A key-value store as state: rows (key, seq, op, value); it gives out each key's value when it changes."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "seq long, op string, value string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seq, op, value = self.held.get() if self.held.exists() else (-1, "", None)
        was = seq
        for pdf in rows:
            at = pdf["seq"].idxmax()
            if pdf.at[at, "seq"] > seq:
                seq, op, value = int(pdf.at[at, "seq"]), str(pdf.at[at, "op"]), pdf.at[at, "value"]
        if seq != was:
            value = None if value is None or pd.isna(value) else str(value)
            self.held.update((seq, op, value))
            yield pd.DataFrame({"key": [key[0]], "seq": [seq], "op": [op], "value": [value]})

    def close(self) -> None:
        pass


def last_writes(changes: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(key, seq, op, value): a change log's last write of each key, given out anew at each change. changes is a stream of
    (key, seq, op, value); the state store must be RocksDB's."""
    return changes.groupBy("key").transformWithStateInPandas(statefulProcessor=LastWrite(ttl_ms), outputStructType="key string, seq long, op string, value string", outputMode="Update", timeMode="None" if ttl_ms is None else "ProcessingTime")


def follows(df: DataFrame, by: str, order: list[str], kind: str, pattern: list[str], ts: str | None = None, within: str | None = None) -> DataFrame:
    """Rows at which a pattern of kinds begins: the next rows of the same by have these kinds in turn, the last within an
    interval of the first if one is given."""
    from pyspark.sql import Window as W

    w = W.partitionBy(by).orderBy(*order)
    hit = F.col(kind) == pattern[0]
    for i, k in enumerate(pattern[1:], 1):
        hit = hit & (F.lead(kind, i).over(w) == k)
    if within:
        hit = hit & (F.lead(ts, len(pattern) - 1).over(w) <= F.col(ts) + F.expr(f"interval {within}"))
    return df.withColumn("__hit", F.coalesce(hit, F.lit(False))).where("__hit").drop("__hit")


class Follows(StatefulProcessor):
    """Keeps the last rows of a key, and gives out those at which the pattern of kinds began."""

    def __init__(self, pattern: list[str], within_ms: int | None = None):
        self.pattern, self.within_ms = pattern, within_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "kinds array<string>, ids array<long>, times array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kinds, ids, times = (list(x) for x in self.held.get()) if self.held.exists() else ([], [], [])
        new = pd.concat(list(rows)).sort_values(["at_ms", "id"])
        found, n = [], len(self.pattern)
        for kind, id_, at in zip(new["kind"].tolist(), new["id"].tolist(), new["at_ms"].tolist(), strict=True):
            kinds, ids, times = [*kinds, kind][-n:], [*ids, id_][-n:], [*times, at][-n:]
            if kinds == self.pattern and (self.within_ms is None or times[-1] - times[0] <= self.within_ms):
                found.append(ids[0])
        self.held.update((kinds, ids, times))
        if found:
            yield pd.DataFrame({"key": pd.Series([key[0]] * len(found), dtype=object), "id": pd.Series(found, dtype="int64")})

    def close(self) -> None:
        pass


def follows_in_stream(events: DataFrame, pattern: list[str], within_ms: int | None = None) -> DataFrame:
    """(key, id) of the rows at which a pattern begins: follows() for a stream of (key string, id long, kind string, at_ms long).

    Rows of a key are put in order within a micro-batch, and follow those of earlier ones. The state is a key's last
    rows, as many as the pattern has; the state store must be RocksDB's.
    """
    return events.select("key", "id", "kind", "at_ms").groupBy("key").transformWithStateInPandas(statefulProcessor=Follows(pattern, within_ms), outputStructType="key string, id long", outputMode="Append", timeMode="None")


class Fields(StatefulProcessor):
    """A sorted map and a list for each key: put, delete, get and range over the map's fields, append and all over the list."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "value string", self.ttl_ms)
        self.list = handle.getListState("list", "value string", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():
            if r.op == "put":
                self.fields.updateValue((r.field,), (r.value,))
            elif r.op == "delete" and self.fields.containsKey((r.field,)):
                self.fields.removeKey((r.field,))
            elif r.op == "get" and self.fields.containsKey((r.field,)):
                out.append((key[0], r.seq, r.field, self.fields.getValue((r.field,))[0]))
            elif r.op == "range":  # from field on, before value
                out += [(key[0], r.seq, f[0], v[0]) for f, v in sorted((tuple(f), tuple(v)) for f, v in self.fields.iterator()) if r.field <= f[0] < r.value]
            elif r.op == "append":
                self.list.appendValue((r.value,))
            elif r.op == "all" and self.list.exists():
                out += [(key[0], r.seq, str(i), v[0]) for i, v in enumerate(self.list.get())]
        if out:
            yield pd.DataFrame({c: pd.Series(v, dtype="int64" if c == "seq" else object) for c, v in zip(("key", "seq", "field", "value"), zip(*out, strict=True), strict=True)})

    def close(self) -> None:
        pass


def keyed_fields(requests: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """(key, seq, field, value): answers to a stream of (key, seq, op, field, value) over each key's map and list; ops are
    those of Fields, in order of seq. The state store must be RocksDB's."""
    return requests.groupBy("key").transformWithStateInPandas(statefulProcessor=Fields(ttl_ms), outputStructType="key string, seq long, field string, value string", outputMode="Append", timeMode="None" if ttl_ms is None else "ProcessingTime")


def route_late(stream: DataFrame, ts: str, lateness: str, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) of all that a stream has now, as tables under path: late is what comes in a later batch
    than a row that is later by more than lateness. Spark drops such rows behind a watermark; here they are kept apart.

    Each batch leaves the latest time so far beside its rows, written anew if the batch is tried again.
    """
    spark, schema = stream.sparkSession, stream.schema

    def write(batch: DataFrame, n: int) -> None:
        marks = spark.read.schema("n long, top timestamp").option("recursiveFileLookup", "true").parquet(f"{path}/top") if n else None
        top = marks.where(F.col("n") < n).agg(F.max("top")).first()[0] if n else None
        late = F.lit(False) if top is None else F.coalesce(F.col(ts).cast("timestamp") < F.lit(top) - F.expr(f"interval {lateness}"), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").parquet(f"{path}/rows/{n}")
        batch.agg(F.max(F.col(ts).cast("timestamp")).alias("top")).select(F.lit(n).cast("long").alias("n"), "top").write.mode("overwrite").parquet(f"{path}/top/{n}")

    run_once(stream, write, f"{path}/checkpoint")
    made = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.fields)}, late boolean").option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    return made.where("not late").drop("late"), made.where("late").drop("late")


def run_once(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there now, batch by batch, and ends. The checkpoint makes a rerun go on."""
    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def stored(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """What a stream gives out over all that is there now, as a table under path; in complete mode the last batch's.

    Each batch has a folder of its own, written anew if it is tried again.
    """
    spark = stream.sparkSession
    last = []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/{n if mode != 'complete' else 0}")
        last.append(n)

    run_once(stream, write, f"{path}/checkpoint", mode)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out") if last else spark.createDataFrame([], stream.schema)
