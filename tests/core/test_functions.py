import datetime as dt
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions import hashing, sizes, statements, urls
from tributary.functions import json as J
from tributary.plans import envelope


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def fnv(data: bytes) -> int:
    h = 0xCBF29CE484222325
    for b in f"[{' '.join(map(str, data))}]".encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return h


def test_fnv_matches_a_plain_one(spark):
    texts = ["", "a", '{"a": 1}', "é日本\U0001f600", "x" * 3000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", hashing.fnv1a_hex(F.col("t")).alias("h"), hashing.fnv1a_bucket(F.col("t"), 13).alias("p"), hashing.fnv1a_expression(F.col("t")).alias("e")).collect():
        assert r.h == f"{fnv(r.t.encode()):016x}" and r.p == fnv(r.t.encode()) % 13 and r.e % 2**64 == fnv(r.t.encode())
    assert hashing.fnv1a_of([]).tolist() == [] and hashing.fnv1a_of([bytes(range(256)), b"", b"\x09\x63\x64"]).tolist() == [fnv(bytes(range(256))), fnv(b""), fnv(b"\x09\x63\x64")]
    assert one(spark, hashing.fnv1a_bucket(F.lit(None).cast("string"), 5))[0] == 0


@pytest.mark.parametrize("n", [0, 42, 2**64 - 1])
def test_uint64_round_trip(spark, n):
    c = F.lit(str(n)).cast("decimal(20,0)")
    r = one(spark, hashing.uint64_to_bytes(c), hashing.bytes_to_uint64(hashing.uint64_to_bytes(c)))
    assert bytes(r[0]) == n.to_bytes(8, "big") and int(r[1]) == n


def test_uuid7(spark):
    at = dt.datetime(2024, 5, 6, 7, 8, 9, 123000, tzinfo=dt.timezone.utc)
    ids = [uuid.UUID(r[0]) for r in spark.range(50).select(hashing.uuid7(F.lit(at))).collect()]
    assert len(set(ids)) == 50
    assert all(u.version == 7 and u.variant == uuid.RFC_4122 and u.int >> 80 == int(at.timestamp() * 1000) for u in ids)


def test_sizes(spark):
    shown = lambda f, n: one(spark, f(F.lit(str(n)).cast("decimal(20,0)")))[0]
    assert [shown(sizes.human_bytes, n) for n in (0, 9, 10, 999, 1500, 7350000, 2**64 - 1)] == ["0 B", "9 B", "10 B", "999 B", "1.5 kB", "7.4 MB", "18 EB"]
    assert [shown(sizes.human_bytes_iec, n) for n in (9, 1536, 7350000)] == ["9 B", "1.5 KiB", "7.0 MiB"]
    said = lambda t: one(spark, sizes.parse_bytes(F.lit(t)))[0]
    assert [said(t) and int(said(t)) for t in ("3 MB", "3 mib", "2,048", "1.5k", "17", " 17", "", "1.2.3 kb", "5 parsecs", "99999 EB", "7 GiB ")] == [3000000, 3145728, 2048, 1500, 17, None, None, None, None, None, 7 * 2**30]


def test_urls(spark):
    f = lambda g, u: one(spark, g(F.lit(u)))[0]
    assert [f(urls.normalize, u) for u in ("host:1", "http://h", "https://h")] == ["http://host:1", "http://h", "https://h"]
    assert [f(urls.ensure_https, u) for u in ("host:1", "http://h/http://x", "https://h")] == ["https://host:1", "https://h/http://x", "https://h"]
    assert [f(urls.redact, u) for u in ("http://u:p@h/x", "http://u@h", "http://h/a:b@c")] == ["http://u:xxxxx@h/x", "http://u@h", "http://h/a:b@c"]
    assert f(lambda c: urls.add_basic_auth(c, "a b", "p:q"), "http://h/x") == "http://a%20b:p%3Aq@h/x"
    assert f(lambda c: urls.add_basic_auth(c, "", "p"), "http://h") == "http://h"
    with pytest.raises(Exception, match="names a user"):
        f(lambda c: urls.add_basic_auth(c, "a", "p"), "http://u:x@h")


def test_json_objects_and_paths(spark):
    valid = lambda t: one(spark, J.is_object(F.lit(t).cast("string")))[0]
    assert [valid(t) for t in ('{"a": 1}', "{}", "null", "[1]", "1", '"s"', "{", "", None)] == [True, True, True] + [False] * 6
    doc = '{"a": {"b": {"c": 5}, "s": "x"}, "n": null, "l": [1, {"k": 2}], "it\'s": 1}'
    at = lambda p: one(spark, J.sub_json(F.lit(doc), p))[0]
    assert [json.loads(at(p)) for p in ("", "a.b", "a.b.c", "a.missing", "a.s.deeper", "l.0", "n", "missing.x")] == [json.loads(doc), {"c": 5}, 5, {}, "x", [1, {"k": 2}], None, {}]
    assert one(spark, J.sub_json(F.lit("{broken"), "a"))[0] is None


def upper(x):
    if isinstance(x, dict):
        return {k: (v.upper() if isinstance(v, str) else upper(v)) for k, v in x.items()}
    return [upper(v) for v in x] if isinstance(x, list) else x


def test_upper_values(spark):
    doc = {"s": "ab", "n": 1, "b": True, "z": None, "o": {"t": "cd"}, "l": ["kept", {"u": "ef", "v": ["kept"]}, [{"w": "gh"}]]}
    assert json.loads(one(spark, J.upper_json(F.lit(json.dumps(doc))))[0]) == upper(doc)
    assert [one(spark, J.upper_json(F.lit(t).cast("string")))[0] for t in ("plain", '"s"', None, '["a"]')] == ["plain", '"s"', None, '["a"]']
    kind = T.DataType.fromDDL("s string, n int, m map<string,string>, l array<string>, o array<struct<u:string,v:array<string>>>")
    df = spark.createDataFrame([(("ab", 1, {"k": "v", "e": None}, ["kept"], [("ef", ["kept"]), None]),), (None,)], T.StructType([T.StructField("p", kind)]))
    got = df.select(J.upper_values(F.col("p"), kind).alias("p")).collect()
    assert got[0].p.asDict(True) == {"s": "AB", "n": 1, "m": {"k": "V", "e": None}, "l": ["kept"], "o": [{"u": "EF", "v": ["kept"]}, None]}
    assert got[1].p is None


def test_upper_letter_by_letter(spark):
    assert one(spark, J.upper_simple(F.lit("straße ﬁ ŉ ᾳ é")))[0] == "STRAßE ﬁ ŉ ᾼ É"
    assert json.loads(one(spark, J.upper_json(F.lit('{"a": "straße ﬁ ᾳ"}')))[0]) == {"a": "STRAßE ﬁ ᾼ"}


def test_rendering(spark):
    df = spark.createDataFrame([(123, 678.0, "fiona <a> & b", bytearray(b"hello"), None)], "c1 long, c2 double, c3 string, c4 binary, c5 string")
    types = ["int", "float", "string", "blob", "text"]
    assert J.render(df, types=types) == '{"columns":["c1","c2","c3","c4","c5"],"types":["int","float","string","blob","text"],"values":[[123,678.0,"fiona <a> & b","aGVsbG8=",null]]}'
    assert J.render(df, associative=True, types=types) == '{"types":{"c1":"int","c2":"float","c3":"string","c4":"blob","c5":"text"},"rows":[{"c1":123,"c2":678.0,"c3":"fiona <a> & b","c4":"aGVsbG8=","c5":null}]}'
    blob = spark.createDataFrame([(bytearray(b),) for b in (b"", b"*", b"\x00\xff\xd5\x7f*")], "b binary")
    assert [json.loads(r[0]) for r in J.value_rows(blob, True).collect()] == [[[]], [[42]], [[0, 255, 213, 127, 42]]]
    with pytest.raises(ValueError, match="differ in length"):
        J.render(df, types=["a"])
    with pytest.raises(ValueError, match="more than 2 rows"):
        J.render(spark.range(5), limit=2)


def test_event_times(spark):
    texts = ['{"eventTime": "2024-01-02T03:04:05Z"}', '{"eventTime": "2024-01-02T03:04:05.25+02:00"}', '{"eventTime": "2024-01-02"}', '{"eventTime": 5}', '{"x": 1}', "[1]", "{", None, '{"eventTime": "2024-13-02T03:04:05Z"}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, data string")
    got = [r.event_time for r in envelope.envelop(df, "data", F.col("i").cast("string")).orderBy("id").collect()]
    assert got[0] == dt.datetime(2024, 1, 2, 3, 4, 5) and got[1] == dt.datetime(2024, 1, 2, 1, 4, 5, 250000) and got[2:] == [None] * 7
    job = envelope.envelop(df, "data").first()
    assert job.priority == 0 and job.node_created_at == job.node_updated_at and uuid.UUID(job.id).version == 7


def test_statements(spark):
    got = statements.parse_request('["select 1", ["select ? + ?", 1, 2.5], ["select :a", {"a": [0, 255], "b": null}], ["select ?", true]]')
    assert got[0] == statements.Statement("select 1") and got[1].positional == [1, 2.5]
    assert got[2].named == {"a": bytearray([0, 255]), "b": None}
    assert statements.run(spark, got[1]).first()[0] == 3.5
    assert bytes(statements.run(spark, got[2]).first()[0]) == b"\x00\xff"
    for bad in ("", "{}", "[]", "[1]", "[[]]", '[[1, "x"]]'):
        with pytest.raises(ValueError):
            statements.parse_request(bad)
    for bad in ([256], [-1], ["x"], [1.5]):
        with pytest.raises(statements.UnsupportedType):
            statements.parameter(bad)
    with pytest.raises(statements.UnsupportedType):
        statements.parse_request('[["select :a", {"a": {"b": 1}}]]')


def test_a_batch_of_statements(spark):
    got = statements.run_all(spark, statements.parse_request('["select 1 as x", "selec", ["select :a as x", {"a": 5}]]'))
    assert got[0][0].first().x == 1 and got[1][0] is None and "PARSE_SYNTAX_ERROR" in got[1][1] and got[2][0].first().x == 5
    assert J.associative_rows(got[0][0], pretty=True).first()[0] == '{\n  "x" : 1\n}'


def test_request_options():
    assert statements.duration("1m30s") == 90 * 10**9 and statements.duration("-1.5h") == -5400 * 10**9 and statements.duration("0") == 0
    for bad in ("", "5", "1x", "s"):
        with pytest.raises(ValueError):
            statements.duration(bad)
    got = statements.query_params({"freshness": "1s", "freshness_strict": "", "level": "STRONG", "retries": "3", "pretty": "", "fmt": "sql"})
    assert (got["freshness"], got["freshness_strict"], got["level"], got["retries"], got["pretty"], got["format"]) == (10**9, True, "strong", 3, True, "sql")
    assert statements.query_params({"level": "other"})["level"] == "weak"
    for bad in ({"freshness_strict": ""}, {"q": ""}, {"timeout": "x"}, {"retries": "x"}):
        with pytest.raises(ValueError):
            statements.query_params(bad)


def test_random_json_both_ways(spark):
    rnd = random.Random(1)

    def make(depth=0):
        kind = rnd.choice(["s", "n", "o", "l", "b"] if depth < 3 else ["s", "n"])
        return {"s": lambda: rnd.choice(["ab", "é", "x y"]), "n": lambda: rnd.choice([1, 2.5, None]), "b": lambda: True, "o": lambda: {f"k{i}": make(depth + 1) for i in range(rnd.randint(0, 3))}, "l": lambda: [make(depth + 1) for _ in range(rnd.randint(0, 3))]}[kind]()

    docs = [{"d": make()} for _ in range(60)]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string")
    assert [json.loads(r[0]) for r in df.orderBy("i").select(J.upper_json(F.col("t"))).collect()] == [upper(d) for d in docs]


def test_outcomes_as_json(spark):
    rows = [(1, 2, "", 1234.0), (0, 5, "went wrong", 0.5), (0, 0, None, None)]
    made = J.execute_rows(spark.createDataFrame(rows, "last_insert_id long, rows_affected long, error string, time double"))
    assert [r.row for r in made.collect()] == ['{"last_insert_id":1,"rows_affected":2,"time":1234}', '{"rows_affected":5,"error":"went wrong","time":0.5}', "{}"]
    assert J.render_result({"rows_affected": 3, "error": "", "time": 2.0}) == '{"rows_affected":3,"time":2}'
    assert J.render_result({"rows_affected": 3}, associative=True) == '{"rows_affected":3,"rows":null}'
    assert J.render_result("bad") == '{"error":"bad"}'
    assert J.render_result(spark.sql("select 7 as n")) == '{"columns":["n"],"types":["integer"],"values":[[7]]}'
    with pytest.raises(ValueError):
        J.render_result("")


def test_requests(spark):
    ask = lambda *sql, **kw: statements.run_request(spark, statements.Request([statements.Statement(s) for s in sql], **kw))
    plain = ask("select 1 as a", "select nothing", "select 2 as b", timings=True)
    assert plain[0]["rows"] == [(1,)] and "error" in plain[1] and plain[2]["columns"] == ["b"] and all(r["time"] > 0 for r in plain)
    assert len(ask("select nothing", "select 2 as b", transaction=True)) == 1
    slow = "select count(*) from (select explode(sequence(1, 3000)) a) x cross join (select explode(sequence(1, 3000)) b) y cross join (select explode(sequence(1, 3000)) c) z where hash(a, b, c) = 7"
    assert ask(slow, timeout=1.0)[0]["error"] == "timeout"
    assert "time" not in ask("select 1 as a")[0]


def test_long_payloads_hash_alike():
    rnd = random.Random(3)

    def plain(data):
        h = 0xCBF29CE484222325
        for c in ("[" + " ".join(map(str, data)) + "]").encode():
            h = (h ^ c) * 0x100000001B3 % 2**64
        return h

    for n in (1, 5, 200):
        data = [rnd.randbytes(rnd.choice([0, 1, 7, 90])) for _ in range(n)] + [rnd.randbytes(3000)]
        assert hashing.fnv1a_of(data).tolist() == [plain(d) for d in data]
