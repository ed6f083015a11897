"""The catalogue of queries on the test tables, and DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tributary.functions import hashing, sizes, statements, urls
from tributary.functions import json as J
from tributary.operators import chunks, kv, partitioning, relational, transforms
from tributary.plans import envelope
from tributary.plans.pipeline import Registry, create_pipeline, union_initial_and_live
from tributary.session import scratch, table
from tributary.sources import documents as feed
from tributary.sources import files, formats
from tributary.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Payloads as a pipeline's records: JSON made of a table's columns.
_EVENT = "to_json(named_struct('eventTime', date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"), 'type', event_type, 'user', user_id))"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _n(name: str = "n"):
    return F.count(F.lit(1)).alias(name)


def _seconds(c: str):
    """A time's nearest whole second, halves to the even one, as epoch(c)::bigint has it in SQL."""
    return F.rint(F.unix_micros(F.col(c).cast("timestamp")) / 1e6).cast("long")


# Envelope, validity, JSON


@query(
    "select 'job-' || event_id as id, props as data, 0 as priority, case when event_id % 3 = 0 then epoch_us(date_trunc('second', ts)) end as event_time_us from events"
)
def job_envelope(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.expr(_EVENT)).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit('{"eventTime": "2024-01-01"}'))
    jobs = envelope.envelop(_events(spark, d).withColumn("payload", text), "payload", F.concat(F.lit("job-"), F.col("event_id").cast("string")), F.col("ts").cast("timestamp"), keep=("props",))
    return jobs.select("id", F.col("props").alias("data"), "priority", F.unix_micros("event_time").alias("event_time_us"))


@query(
    "select event_id, epoch_us(date_trunc('second', ts)) + case when event_id % 2 = 0 then 0 else -7200000000 end as event_time_us from events"
)
def event_time_extract(spark, d):
    zone = F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+02:00")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), zone)
    return _events(spark, d).select("event_id", F.unix_micros(envelope.rfc3339(text)).alias("event_time_us"))


@query("select event_id, props from events where event_type in ('click', 'purchase', 'signup')")
def valid_json_filter(spark, d):
    kind = F.col("event_type")
    odd = F.when(kind == "view", "[1, 2]").when(kind == "error", "{broken").when(kind == "signup", "null").otherwise(F.col("props"))
    return envelope.valid_objects(_events(spark, d).withColumn("payload", odd), "payload").select("event_id", "props")


@query("select event_id, 'not a JSON object' as error from events where event_type = 'error'")
def dead_letters(spark, d):
    made = _events(spark, d).withColumn("payload", F.when(F.col("event_type") == "error", "12").otherwise(F.col("props")))
    return envelope.split_invalid(made, "payload")[1].select("event_id", "error")


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field_extract(spark, d):
    return _events(spark, d).select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("select event_id, json_extract(props, '$.k')::varchar as k, json_extract(props, '$.k')::varchar as beyond, '{}' as missing, props as whole from events")
def sub_json_path(spark, d):
    p = F.col("props")
    return _events(spark, d).select("event_id", J.sub_json(p, "k").alias("k"), J.sub_json(p, "k.deeper").alias("beyond"), J.sub_json(p, "nothing.k").alias("missing"), J.sub_json(p, "").alias("whole"))


_UPPER_SQL = "replace(upper({}), 'ẞ', 'ß')"


@query(f"select conv_id, turn, {_UPPER_SQL.format('text')} as text, {_UPPER_SQL.format('role')} as role, [text, role] as kept, turn as n from conversations")
def upper_json_values(spark, d):
    """Typed: a struct with strings, a number, and an array whose bare strings stay as they are."""
    made = table(spark, d, "conversations").withColumn("payload", F.struct("text", F.struct("role").alias("inner"), F.array("text", "role").alias("kept"), F.col("turn").alias("n")))
    out = transforms.upper_payload(made, "payload")
    return out.select("conv_id", "turn", "payload.text", "payload.inner.role", "payload.kept", "payload.n")


@query(f"select conv_id, turn, {_UPPER_SQL.format('text')} as text, [text] as kept from conversations")
def upper_json_text(spark, d):
    """The same on JSON text, parsed by a schema."""
    made = table(spark, d, "conversations").withColumn("payload", F.to_json(F.struct("text", F.array("text").alias("kept"))))
    return transforms.upper_payload(made, "payload", "text string, kept array<string>").select("conv_id", "turn", "payload.text", "payload.kept")


@query("select conv_id, turn, 'Processed: ' || text as text from conversations")
def map_prefix(spark, d):
    return transforms.prefix_lines(table(spark, d, "conversations"), "text").select("conv_id", "turn", "text")


@query(f"select conv_id, turn, 'Processed: ' || {_UPPER_SQL.format('text')} as text from conversations where role = 'user'")
def op_chain(spark, d):
    chain = transforms.Chain()
    chain.add(transforms.Step("users", lambda df: df.where("role = 'user'"))).add(transforms.Step("upper", lambda df: df.withColumn("text", J.upper_simple(F.col("text")))))
    chain.add(transforms.map_rows("prefix", F.col("conv_id"), F.col("turn"), F.concat(F.lit("Processed: "), F.col("text")).alias("text")))
    return chain.apply(table(spark, d, "conversations"))


# Partitioning

_FNV_SQL = """list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(string_split(
  '[' || array_to_string(list_transform(range(octet_length(encode({c}))), lambda i: ('0x' || substr(hex(encode({c})), (2 * i + 1)::int, 2))::int::varchar), ' ') || ']', ''), lambda c: ascii(c)::uhugeint)),
  lambda a, b: (xor(a, b) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)"""


@query(f"select event_id, lower(lpad(hex({_FNV_SQL.format(c='props')}::ubigint), 16, '0')) as hash, ({_FNV_SQL.format(c='props')} % 7)::int as partition_id from events")
def fnv1a_partition(spark, d):
    made = partitioning.with_partition(_events(spark, d), "props", 7)
    return made.select("event_id", hashing.fnv1a_hex(F.col("props")).alias("hash"), "partition_id")


@query(f"select ({_FNV_SQL.format(c='props')} % 4)::int as partition_id, count(*) as n_rows from events group by 1")
def partition_histogram(spark, d):
    return partitioning.histogram(_events(spark, d), "props", 4)


_RECORD_SQL = """('{"type":"' || event_type || '","user":' || user_id || '}')"""


@query(f"select ({_FNV_SQL.format(c=_RECORD_SQL)} % 4)::int as partition_id, upper(event_type) as event_type, count(*) as n_rows from events group by 1, 2")
def flagship(spark, d):
    """Records enveloped, filtered, routed, transformed and counted: a pipeline's path. The scan reads two columns, and the
    only shuffle is of partial counts."""
    record = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    jobs = envelope.envelop(_events(spark, d).withColumn("payload", record), "payload")
    routed = partitioning.with_partition(envelope.valid_objects(jobs, "data"), "data", 4)
    upper = transforms.upper_payload(routed, "data", "type string, user long")
    return upper.groupBy("partition_id", F.col("data.type").alias("event_type")).agg(_n("n_rows"))


@query("select user_id, count(*) as n from events group by user_id")
def partition_by_key(spark, d):
    return partitioning.partition_by_key(_events(spark, d), 8, "user_id").groupBy("user_id").agg(_n())


# Sources and sinks as tables


@query("select event_id, event_type, ts < timestamp '2024-01-15' as stored from events")
def initial_plus_live_union(spark, d):
    ev, cut = _events(spark, d), F.lit("2024-01-15").cast("timestamp_ntz")
    first = ev.where(F.col("ts") < cut).select("event_id", "event_type", F.lit(True).alias("stored"))
    live = ev.where(F.col("ts") >= cut).select("event_id", "event_type")
    return union_initial_and_live(first, live).withColumn("stored", F.coalesce("stored", F.lit(False)))


def _changes(spark, d) -> DataFrame:
    """Events as change events: inserts and updates of a user's document, and deletions."""
    op = F.when(F.col("event_id") % 20 < 9, "insert").when(F.col("event_id") % 20 < 18, "update").otherwise("delete")
    document = F.when(op != "delete", F.to_json(F.struct(F.col("user_id").alias("_id"), "event_type", "event_id")))
    event = F.struct(F.create_map(F.lit("_data"), F.col("event_id").cast("string")).alias("_id"), F.create_map(F.lit("_id"), F.col("user_id").cast("string")).alias("documentKey"), op.alias("operationType"), document.alias("fullDocument"))
    return _events(spark, d).select("event_id", F.to_json(event).alias("value"))


@query("select event_id, user_id, event_type from events where event_id % 20 < 18")
def cdc_full_document(spark, d):
    doc = feed.full_documents(_changes(spark, d)).select(F.from_json("value", "_id long, event_type string, event_id long").alias("x"))
    return doc.select("x.event_id", F.col("x._id").alias("user_id"), "x.event_type")


@query(
    "select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by event_id desc) as r from events) where r = 1 and event_id % 20 < 18"
)
def cdc_upsert_latest(spark, d):
    made = _changes(spark, d).select("event_id", feed.decode(F.col("value")).alias("e"))
    doc = F.from_json("e.fullDocument", "event_type string")
    changes = made.select(F.col("e.documentKey")["_id"].cast("long").alias("user_id"), "event_id", doc["event_type"].alias("event_type"), (F.col("e.operationType") == "delete").alias("gone"))
    return kv.upsert(changes.limit(0).drop("gone"), changes, "user_id", "event_id", "gone")


# Key-value log


def _statements(spark, d) -> DataFrame:
    sql = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("delete  k"), F.col("user_id")))
        .when(F.col("event_type") == "view", F.concat(F.lit("GET k"), F.col("user_id")))
        .when(F.col("event_type") == "signup", F.concat(F.lit("BAD k"), F.col("user_id")))
        .otherwise(F.concat(F.lit(" SET k"), F.col("user_id"), F.lit("  v  "), F.col("event_id")))
    )
    return _events(spark, d).select(F.col("event_id").alias("idx"), sql.alias("sql"))


@query(
    """select key, value, idx as version from (select 'k' || user_id as key, 'v ' || event_id as value, event_id as idx, event_type, row_number() over (partition by user_id order by event_id desc) as r
    from events where event_type not in ('view', 'signup')) where r = 1 and event_type <> 'error'"""
)
def kv_set_delete_get(spark, d):
    return kv.state(_statements(spark, d))


@query("select event_id as idx, case when event_type in ('view', 'signup') then 0 else 1 end::bigint as rows_affected, case event_type when 'view' then 'GET is a query' when 'signup' then 'unrecognized statement type in EXECUTE: BAD' end as error from events")
def kv_execute(spark, d):
    return kv.execute(_statements(spark, d))


@query(
    """select key, value from (select 'k' || user_id as key, 'v ' || event_id as value, event_type, row_number() over (partition by user_id order by event_id desc) as r
    from events where event_type not in ('view', 'signup')) where r = 1 and event_type <> 'error' and key in ('k1', 'k2', 'k3', 'k4', 'k5', 'k6', 'k7', 'k8', 'k9')"""
)
def kv_get(spark, d):
    return kv.get(_statements(spark, d), *[f"k{i}" for i in range(1, 10)], "nonexistingkey")


@query("select 'nonexistingkey' as key, false as found union all select key, event_type <> 'error' from (select 'k' || user_id as key, event_type, row_number() over (partition by user_id order by event_id desc) as r from events where event_type not in ('view', 'signup')) where r = 1 and key in ('k1', 'k2', 'k3')")
def kv_missing_key(spark, d):
    """Whether each key asked for is there; those that nothing was ever written to aren't."""
    keys = ["nonexistingkey", *(r.key for r in kv.parse(_statements(spark, d)).where("error is null and op in ('SET', 'DELETE') and key in ('k1', 'k2', 'k3')").select("key").distinct().collect())]
    asked = spark.createDataFrame([(k,) for k in keys], "key string")
    return asked.join(kv.get(_statements(spark, d), *keys), "key", "left").select("key", F.col("value").isNotNull().alias("found"))


@query(
    """select event_id as idx, case when event_id % 4 = 0 and event_type not in ('view', 'signup') then 1 else 0 end::bigint as rows_affected,
    case event_id % 4 when 0 then case event_type when 'view' then 'GET is a query' when 'signup' then 'unrecognized statement type in EXECUTE: BAD' end
      when 2 then 'not implemented' when 3 then case when event_id % 8 = 3 then 'QUERY command type should not be applied to FSM state' else 'unhandled command type: JOIN' end end as error from events"""
)
def kv_dispatch(spark, d):
    i = F.col("idx")
    kind = F.when(i % 4 == 0, "EXECUTE").when(i % 4 == 1, "NOOP").when(i % 4 == 2, F.when(i % 8 == 2, "LOAD").otherwise("EXECUTE_QUERY")).otherwise(F.when(i % 8 == 3, "QUERY").otherwise("JOIN"))
    return kv.dispatch(_statements(spark, d).withColumn("type", kind))


@query("select 'last' as key, max(event_id)::decimal(20, 0) as value from events union all select 'none', 0::decimal(20, 0)")
def kv_stable_uint64(spark, d):
    """Numbers set and read in a store of bytes."""
    entries = _events(spark, d).select(F.lit("last").alias("key"), hashing.uint64_to_bytes(F.col("event_id")).alias("value"), F.col("event_id").alias("order"))
    store = kv.set_values(spark.createDataFrame([("last", b"\0" * 8), ("other", b"x")], "key string, value binary"), entries)
    return kv.get_uint64(store, "last", "none")


@query("select event_id as idx from events")
def log_append(spark, d):
    """Entries appended to a log, a part of them twice."""
    path, every = scratch(spark, "log"), _events(spark, d).select(F.col("event_id").alias("idx"))
    every.where("idx % 2 = 0").write.parquet(path)
    log = kv.append(spark.read.schema("idx long").parquet(path), every.where("idx % 3 = 0"), path)
    return kv.append(log, every, path)


@query("select s_suppkey as id, '{' || case when s_suppkey % 2 = 1 then '\"last_insert_id\":' || s_suppkey || ',' else '' end || '\"rows_affected\":' || (s_suppkey + 1) || case when s_suppkey % 3 = 0 then ',\"error\":\"went wrong\"' else '' end || ',\"time\":' || ((s_suppkey + 1) * 10) || '}' as row from supplier")
def rows_execute_json(spark, d):
    """Outcomes of statements as JSON, without what is empty."""
    k = F.col("s_suppkey")
    made = table(spark, d, "supplier").select(k.alias("id"), F.when(k % 2 == 1, k).otherwise(0).alias("last_insert_id"), (k + 1).alias("rows_affected"), F.when(k % 3 == 0, "went wrong").otherwise("").alias("error"), ((k + 1) * 10).cast("double").alias("time"))
    rows = J.execute_rows(made)
    return rows.select(F.coalesce(F.get_json_object("row", "$.last_insert_id"), F.get_json_object("row", "$.rows_affected").cast("long") - 1).cast("long").alias("id"), "row")


@query("select doc_id, md5(text) as digest from documents where text is not null")
def gzip_round_trip(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(chunks.uncompress(chunks.compress(F.encode("text", "utf-8")))).alias("digest"))


@query("select value from (select props as value from events) where json_type(value) = 'OBJECT'")
def file_pipeline(spark, d):
    """A folder of lines through a pipeline into another, run twice: each record is there once."""
    src, out = scratch(spark, "in"), scratch(spark, "out")
    _events(spark, d).select(F.when(F.col("event_id") % 5 == 0, "not json").otherwise(F.col("props")).alias("value")).unionByName(_events(spark, d).where("event_id % 5 = 0").select(F.col("props").alias("value"))).write.text(src)
    made = create_pipeline({"source": {"type": "file", "name": "in", "config": {"path": src}}, "sink": {"type": "file", "name": "out", "key": "k", "config": {"file_path": out}}})
    made.run(spark)
    made.run(spark)
    return spark.read.text(out).select("value")


@query("select event_id, case when event_id % 3 <> 0 then event_id end as a, case when event_id % 3 <> 0 then 'x' end as b, event_id % 3 <> 0 as fits from events")
def payload_schema(spark, d):
    text = F.when(F.col("event_id") % 3 == 0, F.lit('{"a": "text", "b": "x"}')).otherwise(F.to_json(F.struct(F.col("event_id").alias("a"), F.lit("x").alias("b"))))
    made = _events(spark, d).select("event_id", text.alias("t"))
    fits = formats.conforms(F.col("t"), "a long, b string")
    return made.select("event_id", F.when(fits, formats.decode(F.col("t"), "json", "a long, b string")).alias("x"), fits.alias("fits")).select("event_id", "x.a", "x.b", "fits")


@query("select s_suppkey::double as id, s_name as name, null::bigint as size from supplier union all select p_retailprice, null, p_size from part")
def schema_evolution(spark, d):
    old = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = table(spark, d, "part").select(F.col("p_retailprice").alias("id"), F.col("p_size").cast("long").alias("size"))
    return formats.evolve(old, new)


@query("select o_orderkey, true as balanced from orders")
def partition_round_robin(spark, d):
    """No task has more than its share of rows and one for each task that dealt them out."""
    dealt = partitioning.round_robin(table(spark, d, "orders").select("o_orderkey"), 4).withColumn("p", F.spark_partition_id())
    n = dealt.groupBy("p").agg(_n())
    total = table(spark, d, "orders").agg(_n("total"))
    return dealt.join(n, "p").crossJoin(total).select("o_orderkey", (F.abs(F.col("n") - F.col("total") / 4) <= 0.1 * F.col("total")).alias("balanced"))


@query("select event_id, true as stays from events")
def consistent_hash(spark, d):
    """With one bucket more a payload stays, or goes to the new one."""
    made = _events(spark, d).select("event_id", hashing.rendezvous(F.col("props"), 5).alias("a"), hashing.rendezvous(F.col("props"), 6).alias("b"))
    return made.select("event_id", (F.col("a").between(0, 4) & ((F.col("a") == F.col("b")) | (F.col("b") == 5))).alias("stays"))


@query("select event_id, true as valid from events")
def uuid7_ids(spark, d):
    """Ids of version 7 begin with their time."""
    at = F.col("ts").cast("timestamp")
    made = _events(spark, d).select("event_id", hashing.uuid7(at).alias("u"), at.alias("at"))
    ms = F.conv(F.concat(F.substring("u", 1, 8), F.substring("u", 10, 4)), 16, 10).cast("long")
    return made.select("event_id", (F.col("u").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$") & (ms == F.unix_millis("at"))).alias("valid"))


@query("select 'columns' as kind, n_name as name, count(*) as n from customer join nation on c_nationkey = n_nationkey where n_regionkey = 1 group by n_name union all select 'error', 'UNRESOLVED', 1")
def statements_run(spark, d):
    """A client's request: statements with parameters, of which one fails and doesn't stop the others."""
    for t in ("customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(f"tributary_{t}")
    body = '["select nothing from nowhere", ["select n_name, count(*) as n from tributary_customer join tributary_nation on c_nationkey = n_nationkey where n_regionkey = ? group by n_name", 1]]'
    (_, error), (rows, _) = statements.run_all(spark, statements.parse_request(body))
    failed = spark.createDataFrame([("error", "UNRESOLVED" if "TABLE_OR_VIEW_NOT_FOUND" in error else error, 1)], "kind string, name string, n long")
    return rows.select(F.lit("columns").alias("kind"), F.col("n_name").alias("name"), "n").unionByName(failed)


@query("select c_nationkey as key, 'v2' as version from customer where c_nationkey < 5 group by 1")
def registry_versions(spark, d):
    """Configurations of pipelines by key, stored twice; the last version is read."""
    keys = sorted(r.k for r in table(spark, d, "customer").where("c_nationkey < 5").select(F.col("c_nationkey").alias("k")).distinct().collect())
    path = scratch(spark, "config")
    for v in ("v1", "v2"):
        Registry.parse({"sources": [{"type": "memory", "name": v, "key": str(k), "config": {"table": "t"}} for k in keys]}).save(spark, path)
    return spark.createDataFrame([(int(i["key"]), i["source"]) for i in Registry.load(spark, path).info()], "key int, version string")


def _log(spark, d) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", kv.NOOP).otherwise(kv.COMMAND)
    return _events(spark, d).select((F.col("event_id") + 1).alias("idx"), kind.alias("type"))


@query("select event_id + 1 as idx from events where event_id + 1 not between 100 and 200")
def kv_range_delete(spark, d):
    return kv.delete_range(_log(spark, d), 100, 200).select("idx")


@query("select min(event_id + 1) as first_idx, max(event_id + 1) as last_idx from events")
def log_first_last(spark, d):
    return kv.first_last(_log(spark, d))


@query("select coalesce(max(event_id + 1) filter (where event_type <> 'error' and event_id + 1 <= 500), 0) as last_command_idx, bool_or(event_type <> 'error' and event_id + 1 <= 500) as has_command from events")
def log_last_command(spark, d):
    return kv.last_command(_log(spark, d), 1, 500)


@query("select count(*) as n_keys from (select distinct user_id from events)")
def kv_count_keys(spark, d):
    return _events(spark, d).select("user_id").distinct().agg(_n("n_keys"))


@query(
    """select event_id, case when event_id % 5 = 0 then false when event_id % 100 > 50 then true when event_id % 2 = 0 or event_id % 7 = 0 or event_id % 3 = 0 then false else event_id % 11 > 5 end as stale from events"""
)
def stale_read_flags(spark, d):
    e, t0 = F.col("event_id"), F.lit("2024-06-01 00:00:00").cast("timestamp")
    back = lambda s: F.timestamp_seconds(F.unix_seconds(t0) - s)
    stale = kv.is_stale(
        t0, back(e % 100), back(F.lit(1000) - e % 11), F.when(e % 7 != 0, back(F.lit(1000))), e % 3, F.lit(0).cast("long"),
        F.when(e % 5 == 0, 0).otherwise(F.lit(50_000_000_000)),
        e % 2 != 0,
    )
    lag = kv.is_stale(t0, t0, back(F.lit(1000) - e % 11), back(F.lit(1000)), e % 3, F.lit(0).cast("long"), F.lit(5_000_000_000), F.lit(True))
    plain = (e % 5 != 0) & ~(e % 100 > 50) & (e % 2 != 0) & (e % 7 != 0) & (e % 3 != 0)
    return _events(spark, d).select("event_id", F.when(plain, lag).otherwise(stale).alias("stale"))


@query("select o_orderkey as idx, (o_custkey % 50) as term from orders order by term desc, idx desc limit 1")
def snapshot_latest(spark, d):
    return kv.snapshots_latest(table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 50).alias("term")))


@query("select idx, term from (select o_orderkey as idx, o_custkey % 50 as term, row_number() over (order by o_custkey % 50 desc, o_orderkey desc) as r from orders) where r > 3")
def snapshot_reap(spark, d):
    return kv.snapshots_reap(table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 50).alias("term")), 3).select("idx", "term")


# Nodes and configurations


@query("select s_suppkey as id, s_name as name from supplier where s_acctbal > 0 order by id")
def nodes_voters_sorted(spark, d):
    return table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).orderBy("id")


@query("select s_suppkey as id, s_name as name, true as found from supplier where s_suppkey = 3")
def node_lookup(spark, d):
    return table(spark, d, "supplier").where("s_suppkey = 3").limit(1).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit(True).alias("found"))


@query(
    """select coalesce(a.key, b.key) as key, a.name as source_name, b.name as sink_name
    from (select c_nationkey as key, arg_max(c_name, c_custkey) as name from customer group by 1) a
    full join (select s_nationkey + 3 as key, arg_max(s_name, s_suppkey) as name from supplier group by 1) b on a.key = b.key"""
)
def source_sink_pairing(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("name"), F.col("c_custkey").alias("at"))
    b = table(spark, d, "supplier").select((F.col("s_nationkey") + 3).alias("key"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("at"))
    return relational.pair_by_key(a, b, "key", "at").select("key", F.col("source.name").alias("source_name"), F.col("sink.name").alias("sink_name"))


@query("select distinct c_nationkey as key from customer")
def key_registry(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("key")).distinct()


# Chunks


@query(
    """select doc_id as stream_id, i as sequence_num, n - (i - 1) * 1000 < 1000 as is_last, greatest(0, least(1000, n - (i - 1) * 1000)) as n_bytes
    from (select doc_id, octet_length(encode(text)) as n, unnest(range(1, octet_length(encode(text)) // 1000 + 2)) as i from documents where octet_length(encode(text)) > 0)"""
)
def chunk_split(spark, d):
    out = chunks.chunk(table(spark, d, "documents"), "doc_id", "text", 1000)
    return out.select("stream_id", "sequence_num", "is_last", F.octet_length("data").cast("long").alias("n_bytes"))


@query("select doc_id as stream_id, octet_length(encode(text)) // 1000 + 1 as n_chunks, md5(text) as digest from documents where text <> ''")
def chunk_reassemble(spark, d):
    out = chunks.dechunk(chunks.chunk(table(spark, d, "documents"), "doc_id", "text", 1000))
    return out.select("stream_id", "n_chunks", F.md5("data").alias("digest"))


@query("select doc_id, octet_length(encode(text)) >= 1024 as worth from documents")
def compress_decision(spark, d):
    return table(spark, d, "documents").select("doc_id", chunks.worth_compressing(F.array("text")).alias("worth"))


# Sizes and addresses


def _human_sql(base: int, names: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{x}'" for x in names)
    return f"""select doc_id, case when n < 10 then n || ' B' else (case when v < 10 then printf('%.1f', v) else printf('%.0f', v) end) || ' ' || ([{listed}])[e::int + 1] end as size
    from (select *, floor(n / pow({base}.0, e) * 10 + 0.5) / 10 as v from (select doc_id, n, floor(ln(n) / ln({base}.0)) as e from (select doc_id, n_chars * n_chars * (doc_id % 9 + 1) as n from documents) where n > 0))"""


def _sizes(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.col("n_chars") * F.col("n_chars") * (F.col("doc_id") % 9 + 1)).alias("n")).where("n > 0")


@query(_human_sql(1000, sizes.SI))
def human_bytes_si(spark, d):
    return _sizes(spark, d).select("doc_id", sizes.human_bytes(F.col("n")).alias("size"))


@query(_human_sql(1024, sizes.IEC))
def human_bytes_iec(spark, d):
    return _sizes(spark, d).select("doc_id", sizes.human_bytes_iec(F.col("n")).alias("size"))


@query("select doc_id, case doc_id % 4 when 0 then n_chars * 1000000 when 1 then n_chars * 1024 when 2 then n_chars end::bigint as n_bytes from documents")
def parse_bytes(spark, d):
    n = F.col("n_chars").cast("string")
    text = F.when(F.col("doc_id") % 4 == 0, F.concat(n, F.lit(" MB"))).when(F.col("doc_id") % 4 == 1, F.concat(n, F.lit(" KiB "))).when(F.col("doc_id") % 4 == 2, n).otherwise(F.concat(n, F.lit(" parsecs")))
    return table(spark, d, "documents").select("doc_id", sizes.parse_bytes(text).cast("long").alias("n_bytes"))


@query(
    """select page_id, case when url like 'http://%' or url like 'https://%' then url else 'http://' || url end as normal,
    case when url like 'https://%' then url when url like 'http://%' then 'https://' || substr(url, 8) else 'https://' || url end as secure, url like 'https://%' as is_secure from pages"""
)
def url_normalize(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.normalize(u).alias("normal"), urls.ensure_https(u).alias("secure"), urls.is_https(u).alias("is_secure"))


@query("select page_id, regexp_replace(url, '^(https?://)', '\\1bob:xxxxx@') as redacted from pages where url like 'http%'")
def url_redact(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").where("url like 'http%'").select("page_id", urls.redact(urls.add_basic_auth(u, "bob", "secret")).alias("redacted"))


@query("select o_orderkey, lower(lpad(hex(o_orderkey), 16, '0')) as bytes, o_orderkey as back from orders")
def uint64_bytes(spark, d):
    b = hashing.uint64_to_bytes(F.col("o_orderkey"))
    return table(spark, d, "orders").select("o_orderkey", F.lower(F.hex(b)).alias("bytes"), hashing.bytes_to_uint64(b).cast("long").alias("back"))


@query("""select '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' as row from nation""")
def rows_associative_json(spark, d):
    return J.associative_rows(table(spark, d, "nation"))


@query("""select '[' || n_nationkey || ',"' || n_name || '",' || n_regionkey || ']' as row from nation""")
def rows_value_json(spark, d):
    return J.value_rows(table(spark, d, "nation"))


@query("select c_custkey, base64(encode(c_name)) as as_text, list_transform(range(octet_length(encode(c_name))), lambda i: ('0x' || substr(hex(encode(c_name)), (2 * i + 1)::int, 2))::int) as as_list from customer")
def blob_rendering(spark, d):
    raw = F.col("c_name").cast("binary")
    return table(spark, d, "customer").select("c_custkey", F.base64(raw).alias("as_text"), hashing.byte_values(raw).alias("as_list"))


@query("select c_custkey, case c_custkey % 5 when 0 then 'strong' when 1 then 'none' when 2 then 'auto' else 'weak' end as level from customer")
def consistency_level(spark, d):
    names = F.array(*[F.lit(x) for x in ("STRONG", "none", "Auto", "weak", "other")])
    return table(spark, d, "customer").select("c_custkey", kv.level(F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int"))).alias("level"))


# Event time


@query("select time_bucket(interval '1 hour', ts) as window_start, time_bucket(interval '1 hour', ts) + interval '1 hour' as window_end, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3")
def tumbling_count(spark, d):
    return windows.tumbling(_events(spark, d), "ts", "1 hour", ["event_type"], _n(), F.round(F.sum("value"), 4).alias("total"))


@query("select s as window_start, s + interval '6 hours' as window_end, round(avg(value), 6) as mean, count(*) as n from (select value, unnest([time_bucket(interval '2 hours', ts), time_bucket(interval '2 hours', ts) - interval '2 hours', time_bucket(interval '2 hours', ts) - interval '4 hours']) as s from events) group by 1, 2")
def sliding_avg(spark, d):
    return windows.sliding(_events(spark, d), "ts", "6 hours", "2 hours", [], F.round(F.avg("value"), 6).alias("mean"), _n())


@query(
    """select user_id, min(ts) as window_start, max(ts) + interval '30 minutes' as window_end, count(*) as n from (select *, sum(new) over (partition by user_id order by ts, event_id) as s
    from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval '30 minutes' then 0 else 1 end as new from events)) group by user_id, s"""
)
def session_user(spark, d):
    return windows.sessions(_events(spark, d), "ts", "30 minutes", ["user_id"], _n())


@query("select event_id, coalesce(ts < max(ts) over (order by event_id * 7919 % 10007, event_id rows between unbounded preceding and 1 preceding) - interval '1 day', false) as late from events")
def watermark_late_split(spark, d):
    ev = _events(spark, d).withColumn("arrival", F.expr("(event_id * 7919 % 10007) * 10000000 + event_id"))
    return windows.split_late(ev, "ts", "arrival", "1 day").select("event_id", "late")


@query("select distinct user_id, event_type from events")
def dedup_key(spark, d):
    return windows.distinct_by(_events(spark, d), ["user_id", "event_type"]).select("user_id", "event_type")


@query("select a.event_id as first_id, b.event_id as next_id from events a join events b on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval '1 hour' where a.event_type = 'view' and b.event_type = 'purchase'")
def stream_interval_join(spark, d):
    a = _events(spark, d).where("event_type = 'view'").select("event_id", "user_id", "ts")
    b = _events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return windows.join_within(a, b, "user_id", "ts", "ts", "1 hour").select(F.col("l.event_id").alias("first_id"), F.col("r.event_id").alias("next_id"))


@query("select event_id from (select event_id, event_type, lead(event_type) over w as b, lead(event_type, 2) over w as c from events window w as (partition by user_id order by ts, event_id)) where event_type = 'view' and b = 'click' and c = 'purchase'")
def pattern_match(spark, d):
    return windows.follows(_events(spark, d), "user_id", ["ts", "event_id"], "event_type", ["view", "click", "purchase"]).select("event_id")


# Joins


@query("select o.o_orderkey, c.c_name from orders o join customer c on o.o_custkey = c.c_custkey")
def join_inner(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("select c.c_custkey, o.o_orderkey from customer c left join orders o on o.o_custkey = c.c_custkey and o.o_totalprice > 200000")
def join_left(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def join_semi(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey % 3 <> 0)")
def join_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_custkey % 3 <> 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("select s.s_suppkey, c.c_custkey from supplier s full join customer c on s.s_suppkey = c.c_custkey + 5")
def join_full(spark, d):
    return table(spark, d, "supplier").join(table(spark, d, "customer"), F.col("s_suppkey") == F.col("c_custkey") + 5, "full").select("s_suppkey", "c_custkey")


@query("select n_name, r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2")
def join_broadcast(spark, d):
    """nation and region have a fixed number of rows."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(_n())


@query("select a.n_nationkey as a, b.n_nationkey as b from nation a join nation b on a.n_regionkey < b.n_regionkey and a.n_nationkey > b.n_nationkey")
def join_theta(spark, d):
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    return a.join(F.broadcast(b), (F.col("a.n_regionkey") < F.col("b.n_regionkey")) & (F.col("a.n_nationkey") > F.col("b.n_nationkey"))).select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query("select event_id, p_partkey from events join part on round(value, 2) between p_retailprice / 100 and p_retailprice / 100 + 0.05")
def join_range(spark, d):
    ranges = table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("low"), (F.col("p_retailprice") / 100 + 0.05).alias("high"))
    return relational.range_join(_events(spark, d).select("event_id", F.round("value", 2).alias("point")), ranges, "point", "low", "high", 0.1).select("event_id", "p_partkey")


@query(
    """select a.event_id, b.event_id as prior_id from (select * from events where event_type = 'purchase') a
    asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'view' group by user_id, ts) b on a.user_id = b.user_id and a.ts >= b.ts"""
)
def join_asof(spark, d):
    a = _events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = _events(spark, d).where("event_type = 'view'").select(F.col("event_id").alias("prior_id"), "user_id", "ts")
    return relational.asof_join(a, b, "ts", "user_id", ["prior_id"], block=lambda c: F.date_trunc("day", c)).select("event_id", "prior_id")


@query(
    """with s as (select event_id, user_id, epoch(ts)::bigint as start, epoch(ts)::bigint + event_id % 5000 + 1 as "end" from events)
    select a.event_id as one, b.event_id as two from s a join s b on a.user_id = b.user_id and a.event_id < b.event_id and a.start < b."end" and b.start < a."end\""""
)
def join_interval(spark, d):
    at = _seconds("ts")
    s = _events(spark, d).select("event_id", "user_id", at.alias("start"), (at + F.col("event_id") % 5000 + 1).alias("end"))
    return relational.interval_overlap_join(s, s, "user_id", 3600).where("event_id < r_event_id").select(F.col("event_id").alias("one"), F.col("r_event_id").alias("two"))


@query("select l_orderkey, l_linenumber, s_name from lineitem join supplier on l_suppkey = s_suppkey")
def join_salted(spark, d):
    small = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey").select("l_suppkey", "s_name")
    return relational.salted_join(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), small, "l_suppkey", 4).select("l_orderkey", "l_linenumber", "s_name")


# Aggregates

_CENTS = "cast(round(l_extendedprice * 100) as bigint)"


@query(f"select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum({_CENTS})::bigint as sum_cents, count(*) as n, min(l_shipdate) as first_ship, max(l_shipdate) as last_ship from lineitem group by 1, 2")
def agg_hash(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.expr(f"sum({_CENTS})").alias("sum_cents"), _n(), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))


@query("select event_type, count(distinct user_id) as users, count(distinct props) as props from events group by 1")
def agg_distinct(spark, d):
    return _events(spark, d).groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("props"))


_NATIONS = "select c_mktsegment, r_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by "


def _customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))


@query(_NATIONS + "rollup (c_mktsegment, r_name)")
def agg_rollup(spark, d):
    return _customers(spark, d).rollup("c_mktsegment", "r_name").agg(_n())


@query(_NATIONS + "cube (c_mktsegment, r_name)")
def agg_cube(spark, d):
    return _customers(spark, d).cube("c_mktsegment", "r_name").agg(_n())


@query(_NATIONS + "grouping sets ((c_mktsegment), (r_name))")
def agg_grouping_sets(spark, d):
    c = _customers(spark, d)
    return c.groupingSets([[F.col("c_mktsegment")], [F.col("r_name")]], F.col("c_mktsegment"), F.col("r_name")).agg(_n())


@query("select l_returnflag, count(distinct l_linenumber) as lines, true as parts_close from lineitem group by l_returnflag")
def agg_approx_distinct(spark, d):
    """Estimates only, in one pass. Of a few values the estimate is exact; of the parts there are as many as rows of part, of which a group may lack a fifth."""
    n_parts = table(spark, d, "part").agg(_n("n_parts"))
    made = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_linenumber").alias("lines"), F.approx_count_distinct("l_partkey", 0.02).alias("parts"))
    return made.crossJoin(n_parts).select("l_returnflag", "lines", F.col("parts").between(F.col("n_parts") * 0.8, F.col("n_parts") * 1.1).alias("parts_close"))


@query("select c_mktsegment, count(*) filter (where c_nationkey < 10) as low, count(*) filter (where c_nationkey >= 10) as high from customer group by 1")
def agg_pivot(spark, d):
    side = table(spark, d, "customer").withColumn("side", F.when(F.col("c_nationkey") < 10, "low").otherwise("high"))
    return side.groupBy("c_mktsegment").pivot("side", ["low", "high"]).agg(_n()).na.fill(0)


@query("select sum(octet_length(encode(n_name)) + 1)::bigint as n_bytes from nation")
def dir_size(spark, d):
    """Bytes of a folder's files: each nation's name as a line of some file."""
    path = scratch(spark, "files")
    table(spark, d, "nation").select("n_name").repartition(3).write.text(path)
    return files.dir_size(spark, path)


# Windows, order, sets


@query("select o_orderkey, rank() over w as rank, dense_rank() over w as dense, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as number from orders window w as (partition by o_custkey order by o_orderdate)")
def win_rank(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("number"))


@query("select event_id, lag(event_id) over w as prior, lead(event_id, 2) over w as later, first_value(event_id) over w as first from events window w as (partition by user_id order by ts, event_id)")
def win_lag(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, d).select("event_id", F.lag("event_id").over(w).alias("prior"), F.lead("event_id", 2).over(w).alias("later"), F.first("event_id").over(w).alias("first"))


@query("select l_orderkey, l_linenumber, sum(l_quantity) over w as running_sum, count(l_quantity) over w as running_n from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate rows unbounded preceding)")
def win_running(spark, d):
    return relational.running(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], "l_quantity", lambda n: F.floor(n / 3)).select("l_orderkey", "l_linenumber", "running_sum", "running_n")


@query("select event_id, count(*) over (partition by user_id order by epoch(ts)::bigint range between 3600 preceding and current row) as n from events")
def win_range_frame(spark, d):
    w = W.partitionBy("user_id").orderBy("at").rangeBetween(-3600, 0)
    return _events(spark, d).withColumn("at", _seconds("ts")).select("event_id", F.count(F.lit(1)).over(w).alias("n"))


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def topk(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


@query("select o_custkey, o_orderkey, rank from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rank from orders) where rank <= 2")
def topk_per_group(spark, d):
    return relational.top_k_per(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("select c_nationkey as k from customer union all select s_nationkey from supplier")
def union_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).unionAll(table(spark, d, "supplier").select("s_nationkey"))


@query("select c_custkey as k from customer intersect select o_custkey from orders")
def set_intersect(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("select c_custkey as k from customer except select o_custkey from orders where o_custkey % 4 <> 0")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_custkey % 4 <> 0").select("o_custkey"))


@query("select event_type, count(*) as n, round(avg(value), 6) as mean from events where value > 10 group by event_type having count(*) > 1")
def sql_transform(spark, d):
    return spark.sql("select event_type, count(*) as n, round(avg(value), 6) as mean from {events} where value > :least group by event_type having count(*) > 1", args={"least": 10.0}, events=_events(spark, d))


# UDFs


@query("select event_id, upper(event_type) || '!' as shout from events")
def udf_map(spark, d):
    def shout(batches):
        for pdf in batches:
            yield pdf.assign(shout=pdf["event_type"].str.upper() + "!")[["event_id", "shout"]]

    return transforms.map_batches("shout", shout, "event_id long, shout string").apply(_events(spark, d).select("event_id", "event_type"))


@query("select event_type, max(value) - min(value) as spread from events group by event_type")
def udaf_spread(spark, d):
    @F.pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    # Partial extremes first: the aggregate then sees a few rows of each group, however large the group is.
    part = _events(spark, d).groupBy("event_type", F.spark_partition_id().alias("p")).agg(F.array(F.min("value"), F.max("value")).alias("x"))
    return part.select("event_type", F.explode("x").alias("value")).groupBy("event_type").agg(spread("value").alias("spread"))


@query("select event_id, unnest(range(event_id % 3)) as i from events")
def udtf_expand(spark, d):
    @F.udtf(returnType="i: long")
    class Expand:
        def eval(self, n: int):
            for i in range(n):
                yield (i,)

    spark.udtf.register("tributary_expand", Expand)
    return spark.sql("select event_id, x.i from {events}, lateral tributary_expand(event_id % 3) x", events=_events(spark, d))


# Streams, run over all that is there and read back


def _stream(spark: SparkSession, d: str, columns: str = "*") -> DataFrame:
    return spark.readStream.schema(_events(spark, d).schema).parquet(f"{d}/event[s].parquet").selectExpr(*[columns])


@query("select time_bucket(interval '1 day', ts) as window_start, time_bucket(interval '1 day', ts) + interval '1 day' as window_end, event_type, count(*) as n from events group by 1, 2, 3")
def stream_tumbling(spark, d):
    out = windows.tumbling(windows.timed(_stream(spark, d), "ts"), "ts", "1 day", ["event_type"], _n())
    made = windows.stored(out, scratch(spark), "complete")
    return made.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(f"select event_id, 'Processed: ' || upper(event_type) as text, ({_FNV_SQL.format(c='props')} % 4)::int as partition_id from events where event_type <> 'error'")
def stream_pipeline(spark, d):
    """Filter, transform and route a stream; append."""
    kept = _stream(spark, d).where("event_type <> 'error'").withColumn("text", J.upper_simple(F.col("event_type")))
    out = partitioning.with_partition(transforms.prefix_lines(kept, "text"), "props", 4).select("event_id", "text", "partition_id")
    return windows.stored(out, scratch(spark))


@query("select user_id, event_type, 1::bigint as n from events group by user_id, event_type")
def stream_dedup(spark, d):
    timed = windows.timed(_stream(spark, d), "ts", "100 days")
    out = windows.stored(windows.distinct_by(timed, ["user_id", "event_type"]).select("user_id", "event_type"), scratch(spark))
    return out.groupBy("user_id", "event_type").agg(_n())


@query("select a.event_id as first_id, b.event_id as next_id from events a join events b on a.user_id = b.user_id and b.ts between a.ts and a.ts + interval '1 hour' where a.event_type = 'view' and b.event_type = 'purchase'")
def stream_stream_join(spark, d):
    side = lambda kind: windows.timed(_stream(spark, d), "ts", "2 hours").where(F.col("event_type") == kind).select("event_id", "user_id", "ts")
    out = windows.join_within(side("view"), side("purchase"), "user_id", "ts", "ts", "1 hour")
    return windows.stored(out.select(F.col("l.event_id").alias("first_id"), F.col("r.event_id").alias("next_id")), scratch(spark))


@query("select user_id::varchar as key, max(event_id) as version, arg_max(event_type, event_id) as value from events group by user_id having arg_max(event_type, event_id) <> 'error'")
def stream_key_value(spark, d):
    """A keyed store as a stream's state: last writes, deletions left out when it is read."""
    changes = _stream(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("set").alias("op"), F.col("event_type").alias("value"))
    with kv.stored_in(spark, "rocksdb"):
        out = windows.stored(windows.last_writes(changes), scratch(spark), "update")
    last = out.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("x"))
    return last.where("x.op = 'set'").select("key", F.col("x.seq").alias("version"), "x.value")


@query("select event_type, count(*) as n from events group by event_type")
def counted_rows(spark, d):
    """Counters of a plan's rows, observed while it runs."""
    from tributary.plans.metrics import counted

    # The types that there are, one row each; any that came later would be counted under OTHER.
    types = sorted(r.event_type for r in _events(spark, d).where("event_type is not null").select("event_type").distinct().collect())
    rows, counts = counted(_events(spark, d), "event_type", types)
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(k, n) for k, n in sorted(counts.get.items()) if n], "event_type string, n long")


@query("select event_id from (select event_id, event_type, lead(event_type) over w as b, lead(event_type, 2) over w as c from events window w as (partition by user_id order by epoch_ms(ts), event_id)) where event_type = 'view' and b = 'click' and c = 'purchase'")
def stream_pattern_match(spark, d):
    """The pattern in a stream, with each user's last rows as state."""
    with kv.stored_in(spark, "rocksdb"):
        events = _stream(spark, d).select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
        return windows.stored(windows.follows_in_stream(events, ["view", "click", "purchase"]), scratch(spark)).select(F.col("id").alias("event_id"))


@query("select op, count(*) > 0 as some from (select unnest(['insert', 'update', 'delete']) as op) group by op")
def cdc_workload(spark, d):
    """Random changes in the shares 0.45, 0.45 and 0.1, alike for one seed."""
    from tributary.sources.generate import changes

    return changes(spark, 20_000, seed=1).groupBy("op").agg((F.count(F.lit(1)).between(20_000 * 0.08, 20_000 * 0.5)).alias("some"))
