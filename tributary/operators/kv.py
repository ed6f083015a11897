"""A key-value store as a log of statements, folded by key: the last write wins."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.functions.hashing import bytes_to_uint64

#: Types of log entries.
COMMAND, NOOP, BARRIER, CONFIGURATION = 0, 1, 3, 5


def parse(df: DataFrame, sql: str = "sql") -> DataFrame:
    """df with op, key, value, error of each statement.

    A statement is split at white space. SET needs a key; its value is the rest, joined by single spaces, and may be
    empty. DELETE and GET take exactly a key. The operation may be in any case; another one is an error.
    """
    tokens = F.filter(F.split(F.coalesce(F.col(sql), F.lit("")), r"\s+"), lambda x: x != "")
    op, n = F.upper(F.try_element_at(tokens, F.lit(1))), F.size(tokens)
    fits = (op == "SET") & (n >= 2) | op.isin("DELETE", "GET") & (n == 2)
    error = (
        F.when(n == 0, "empty statement")
        .when(fits, None)
        .when(op.isin("SET", "DELETE", "GET"), F.concat(F.lit("wrong number of arguments for "), op))
        .otherwise(F.concat(F.lit("unrecognized statement type in EXECUTE: "), op))
    )
    value = F.when((op == "SET") & fits, F.array_join(F.slice(tokens, 3, F.greatest(n - 2, F.lit(0))), " "))
    return df.withColumns({"op": op, "key": F.when(fits, F.try_element_at(tokens, F.lit(2))), "value": value, "error": error})


def execute(df: DataFrame, order: str = "idx", sql: str = "sql") -> DataFrame:
    """(order, rows_affected, error) of each statement: 1 for SET and DELETE, whether the key was there or not."""
    made = parse(df, sql)
    write = F.col("op").isin("SET", "DELETE") & F.col("error").isNull()
    told = F.when(F.col("op") == "GET", "GET is a query").otherwise(F.col("error"))
    return made.select(order, F.when(write, 1).otherwise(0).cast("long").alias("rows_affected"), told.alias("error"))


#: Types of commands, by their number.
COMMAND_TYPES = ("UNKNOWN", "QUERY", "EXECUTE", "NOOP", "LOAD", "JOIN", "EXECUTE_QUERY", "LOAD_CHUNK")


def dispatch(commands: DataFrame, kind: str = "type", order: str = "idx", sql: str = "sql") -> DataFrame:
    """(order, rows_affected, error) of each command by its type's name: statements are executed, NOOP does nothing, loads
    and mixed requests aren't implemented here, queries change no state; any other type is an error."""
    name = F.col(kind)
    told = (
        F.when(name == "EXECUTE", F.col("error"))
        .when(name == "NOOP", None)
        .when(name.isin("LOAD", "EXECUTE_QUERY"), "not implemented")
        .when(name == "QUERY", "QUERY command type should not be applied to FSM state")
        .otherwise(F.concat(F.lit("unhandled command type: "), F.coalesce(name, F.lit("UNKNOWN"))))
    )
    parsed = parse(commands.select(order, kind, sql), sql)
    write = (name == "EXECUTE") & F.col("op").isin("SET", "DELETE") & F.col("error").isNull()
    error = F.when(F.col("op") == "GET", "GET is a query").otherwise(F.col("error"))
    parsed = parsed.withColumn("error", error)
    return parsed.select(order, F.when(write, 1).otherwise(0).cast("long").alias("rows_affected"), told.alias("error"))


def set_values(store: DataFrame, entries: DataFrame) -> DataFrame:
    """store (key, value in bytes) with entries (key, value) put in; of a key's entries the last by order, if they have it."""
    order = F.col("order") if "order" in entries.columns else F.lit(1)
    new = entries.groupBy("key").agg(F.max_by("value", order).alias("value"))
    return store.join(new, "key", "left_anti").select("key", "value").unionByName(new)


def get_values(store: DataFrame, *keys: str) -> DataFrame:
    """(key, value) of these keys; one that isn't there has no row."""
    return store.where(F.col("key").isin(list(keys))).select("key", "value")


def get_uint64(store: DataFrame, *keys: str) -> DataFrame:
    """(key, value) of these keys, whose values are numbers of 8 bytes; 0 for a key that isn't there."""
    asked = store.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    found = get_values(store, *keys).select("key", bytes_to_uint64(F.col("value")).alias("n"))
    return asked.join(found, "key", "left").select("key", F.coalesce("n", F.lit(0).cast("decimal(20,0)")).alias("value"))


def state(df: DataFrame, order: str = "idx", sql: str = "sql") -> DataFrame:
    """(key, value, version): the store after all statements of the log. Map-side maxima, one shuffle by key."""
    writes = parse(df, sql).where("error is null and op in ('SET', 'DELETE')")
    last = F.max_by(F.struct("op", "value", F.col(order).alias("version")), F.col(order))
    return writes.groupBy("key").agg(last.alias("last")).where("last.op = 'SET'").select("key", "last.value", "last.version")


def get(df: DataFrame, *keys: str, order: str = "idx", sql: str = "sql") -> DataFrame:
    """(key, value) of these keys; a key that isn't there has no row. Only these keys' statements are folded."""
    writes = parse(df, sql).where(F.col("key").isin(list(keys)))
    return state(writes.drop("op", "key", "value", "error"), order, sql).select("key", "value")


def first_last(log: DataFrame, idx: str = "idx") -> DataFrame:
    """(first_idx, last_idx), 0 for an empty log."""
    return log.agg(F.coalesce(F.min(idx), F.lit(0)).alias("first_idx"), F.coalesce(F.max(idx), F.lit(0)).alias("last_idx"))


def last_command(log: DataFrame, first: int | None = None, last: int | None = None, idx: str = "idx", kind: str = "type") -> DataFrame:
    """(last_command_idx, has_command) in [first, last]; 0 and false if there is none."""
    inside = reduce(lambda a, b: a & b, [F.lit(True), *([F.col(idx) >= first] if first is not None else []), *([F.col(idx) <= last] if last is not None else [])])
    at = F.max(F.when(inside & (F.col(kind) == COMMAND), F.col(idx)))
    return log.agg(F.coalesce(at, F.lit(0)).alias("last_command_idx"), at.isNotNull().alias("has_command"))


def delete_range(log: DataFrame, least: int, most: int, idx: str = "idx") -> DataFrame:
    """The log without the entries from least to most, both included."""
    return log.where(~F.col(idx).between(least, most))


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str, deleted: str | None = None) -> DataFrame:
    """table (which has order too) after changes: per key the row that is last by order, without those marked deleted."""
    every = table if deleted is None or deleted in table.columns else table.withColumn(deleted, F.lit(False))
    merged = every.unionByName(changes, allowMissingColumns=True)
    last = merged.groupBy(key).agg(F.max_by(F.struct(*merged.columns), F.col(order)).alias("last")).select("last.*")
    return last if deleted is None else last.where(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted)


def is_stale(now: Column, leader_last_contact: Column, last_fsm_update: Column, last_appended: Column, fsm_idx: Column, commit_idx: Column, freshness_ns: Column, strict: Column) -> Column:
    """Whether a read is stale. Without a freshness none is; a leader that was silent for longer makes any stale; else,
    in strict mode, one is if entries are missing and the last applied one came later than freshness after it was appended."""
    nanos = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)) * 1000
    return (
        F.when(freshness_ns == 0, False)
        .when(nanos(now, leader_last_contact) > freshness_ns, True)
        .when(~strict | last_appended.isNull() | (fsm_idx == commit_idx), False)
        .otherwise(nanos(last_fsm_update, last_appended) > freshness_ns)
    )


def level(name: Column) -> Column:
    """The read consistency that a name says, in any case: none, strong, auto; weak for any other."""
    lower = F.lower(F.trim(name))
    return F.when(lower.isin("none", "strong", "auto"), lower).otherwise("weak")


def snapshots_latest(snapshots: DataFrame) -> DataFrame:
    """(idx, term) of the newest snapshot by term, then idx; (0, 0) if there is none."""
    newest = snapshots.agg(F.max(F.struct("term", "idx")).alias("s"))
    return newest.select(F.coalesce("s.idx", F.lit(0)).alias("idx"), F.coalesce("s.term", F.lit(0)).alias("term"))


def snapshots_reap(snapshots: DataFrame, keep: int = 1) -> DataFrame:
    """The snapshots that go when the newest keep ones stay. The kept ones are a top-k, so nothing is sorted as a whole."""
    stay = snapshots.orderBy(F.desc("term"), F.desc("idx")).limit(keep).select("term", "idx")
    return snapshots.join(F.broadcast(stay), ["term", "idx"], "left_anti")


#: State stores of streams by name.
STORES = {"rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"}


def use_store(spark: SparkSession, name: str) -> None:
    """Keeps the state of streams that start from now on in the store of this name."""
    if name not in STORES:
        raise ValueError(f"unknown store {name!r}; there are {', '.join(sorted(STORES))}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORES[name])


@contextmanager
def stored_in(spark: SparkSession, name: str) -> Iterator[None]:
    """Streams that start inside keep their state in the store of this name; the session's own setting holds again after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    use_store(spark, name)
    try:
        yield
    finally:
        spark.conf.set(key, was)


def append(log: DataFrame, entries: DataFrame, path: str) -> DataFrame:
    """The log under path after entries whose idx isn't in log yet were appended; appending the same again changes nothing."""
    entries.join(log.select("idx"), "idx", "left_anti").select(*log.columns).write.mode("append").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)
