import http.server
import json
import os
import shutil
import socketserver
import subprocess
import sys
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tributary.operators.transforms import Step
from tributary.plans.pipeline import Pipeline, Registry, create_pipeline, status
from tributary.session import shared_dir
from tributary.sources import registry, sinks
from tributary.sources.documents import PymongoClient
from tributary.sources.registry import Spec, begin, source
from tributary.sources.sinks import with_ids

KAFKA = {"bootstrap_servers": "b:9092", "group": "g", "topic": "t"}


def test_kafka_options():
    spec = Spec("kafka", "n", "k", {**KAFKA, "max_offsets_per_trigger": "500", "kafka.security.protocol": "SSL"})
    got = registry.kafka_options(spec)
    assert got["kafka.bootstrap.servers"] == "b:9092" and got["subscribe"] == "t" and got["startingOffsets"] == "earliest" and got["maxOffsetsPerTrigger"] == "500" and got["kafka.security.protocol"] == "SSL"
    assert registry.kafka_options(Spec("kafka", config={"bootstrap_servers": "b", "topic": "t"}), writing=True) == {"kafka.bootstrap.servers": "b", "topic": "t"}
    for missing in KAFKA:
        with pytest.raises(ValueError, match=missing):
            registry.kafka_options(Spec("kafka", config={**KAFKA, missing: ""}))


def test_configuration_errors():
    with pytest.raises(ValueError, match="unknown source type"):
        create_pipeline({"source": {"type": "tape"}, "sink": {"type": "file"}})
    with pytest.raises(ValueError, match="unknown sink type"):
        create_pipeline({"source": {"type": "kafka"}, "sink": {"type": "tape"}})
    with pytest.raises(ValueError, match="a sink is needed"):
        create_pipeline({"source": {"type": "kafka"}})
    with pytest.raises(ValueError, match="uri, database"):
        registry.mongo_options(Spec("mongodb", "n", "k", {"collection": "c"}))
    with pytest.raises(ValueError, match="a key and a name"):
        registry.mongo_options(Spec("mongodb", "", "", {}))
    made = registry.mongo_options(Spec("mongodb", "n", "k", {"uri": "u", "database": "d", "collection": "c", "load_initial_data": "perhaps"}))
    assert made["load_initial_data"] == "false"


def test_registry_pairs_by_key():
    got = Registry.parse({"sources": [{"key": "a", "type": "kafka", "name": "one"}, {"key": "a", "type": "kafka", "name": "two"}, {"key": "b", "type": "rate", "name": "r"}], "sinks": [{"key": "a", "type": "file", "name": "f"}, {"key": "c", "type": "file", "name": "g"}]})
    pairs = {k: (a and a.name, b and b.name) for k, (a, b) in got.pairs().items()}
    assert pairs == {"a": ("two", "f"), "b": ("r", None), "c": (None, "g")} and got.keys == ["a", "b", "c"]
    assert list(got.pipelines()) == ["a"] and got.pipelines()["a"].show() == "two -> f"
    assert got.info()[0] == {"key": "a", "source": "two", "sink": "f", "open": "false"}
    with pytest.raises(KeyError):
        got.close("nothing")


def lines(spark, path):
    return sorted(r[0] for r in spark.read.text(path).collect())


def test_file_to_file_in_batch(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out/deep"
    spark.createDataFrame([('{"a":"x"}',), ("[1]",), ("junk",), ("null",), ('{"a":"y"}',)], "value string").write.text(src)
    p = create_pipeline({"source": {"type": "file", "name": "in", "config": {"path": src}}, "sink": {"type": "file", "name": "out", "key": "k", "config": {"file_path": out}}, "parallelism": 3})
    p.add_operation(Step("upper", lambda df: df.withColumn("value", F.upper("value"))))
    assert p.show() == "in -> out" and p.key == "k"
    assert p.run(spark) is None
    assert lines(spark, out) == ["NULL", '{"A":"X"}', '{"A":"Y"}']
    p.run(spark)
    assert len(lines(spark, out)) == 3  # stored records are written anew, not doubled
    assert p.close() is False


def test_stream_goes_on_where_it_was(spark, tmp_path):
    src, out, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    add = lambda *rows: spark.createDataFrame([(r,) for r in rows], "value string").write.mode("append").text(src)
    add('{"n":1}', "junk")
    p = Pipeline(Spec("file", "in", "a", {"path": src, "stream": "true"}), Spec("file", "out", "a", {"file_path": out, "checkpoint": ck}))
    p.run(spark)
    assert lines(spark, out) == ['{"n":1}'] and not p.is_open
    add('{"n":2}')
    p.run(spark)
    assert lines(spark, out) == ['{"n":1}', '{"n":2}']
    with pytest.raises(ValueError, match="checkpoint"):
        Pipeline(Spec("file", config={"path": src, "stream": "true"}), Spec("file", config={"file_path": out})).run(spark)


def test_documents_then_changes(spark, tmp_path):
    feed = f"{tmp_path}/feed"
    event = lambda i, op, doc: json.dumps({"_id": {"_data": str(i)}, "documentKey": {"_id": str(i)}, "operationType": op, "fullDocument": doc, "ns": {"db": "d", "coll": "c"}})
    with open(feed, "w") as f:
        f.write("\n".join([event(1, "insert", {"_id": 7, "name": "live 1"}), event(2, "delete", None), event(3, "update", {"_id": 8, "name": "live 2"})]))
    config = {"uri": feed, "database": "d", "collection": "c", "load_initial_data": "true", "client": "tests.core.fakes:database"}
    out = f"{tmp_path}/out"
    p = Pipeline(Spec("mongodb", "db", "k", config), Spec("file", "out", "k", {"file_path": out, "checkpoint": f"{tmp_path}/ck"}))
    p.run(spark)
    assert [json.loads(x)["name"] for x in lines(spark, out)] == ["stored 0", "stored 1", "stored 2", "live 1", "live 2"]
    with open(feed, "a") as f:
        f.write("\n" + event(4, "insert", {"_id": 9, "name": "live 3"}))
    Pipeline(Spec("mongodb", "db", "k", {**config, "load_initial_data": "false"}), Spec("file", "out", "k", {"file_path": out, "checkpoint": f"{tmp_path}/ck"})).run(spark)
    assert sum("live" in x for x in lines(spark, out)) == 3


def test_bulk_upsert(spark, tmp_path):
    shutil.rmtree("/tmp/tributary-sent", ignore_errors=True)
    df = spark.createDataFrame([('{"_id":"a","v":1}',), ('{"v":2}',), ('{"_id":"b","v":3}',), ('{"_id":"a","v":4}',)], "value string").coalesce(1)
    sinks.write_documents(df, {"index_name": "i", "sender": "tests.core.fakes:send"})
    import glob

    sent = "".join(open(f).read() for f in glob.glob("/tmp/tributary-sent/*")).splitlines()
    pairs = {json.loads(a)["update"]["_id"]: json.loads(b) for a, b in zip(sent[::2], sent[1::2], strict=True)}
    assert pairs == {"a": {"doc": {"_id": "a", "v": 4}, "doc_as_upsert": True}, "b": {"doc": {"_id": "b", "v": 3}, "doc_as_upsert": True}}
    shutil.rmtree("/tmp/tributary-sent", ignore_errors=True)


def test_status(spark):
    assert json.loads(status(spark, "runtime.spark")) == spark.version and json.loads(status(spark, "nothing.here")) == {}


def test_services_through_a_client(spark, tmp_path):
    feed = f"{tmp_path}/feed"
    with open(feed, "w") as f:
        f.write('{"n": 1}\n{"n": 2}')
    shutil.rmtree("/tmp/tributary-sent", ignore_errors=True)
    source_ = Spec("sqs", "q", "k", {"uri": feed, "client": "tests.core.fakes:database"})
    Pipeline(source_, Spec("webhook", "w", "k", {"url": "http://h", "sender": "tests.core.fakes:send", "checkpoint": f"{tmp_path}/ck"})).run(spark)
    import glob

    assert sorted("".join(open(f).read() for f in glob.glob("/tmp/tributary-sent/*")).split("\n")) == ["", '{"n": 1}', '{"n": 2}']
    shutil.rmtree("/tmp/tributary-sent", ignore_errors=True)
    with pytest.raises(ValueError, match="client"):
        Pipeline(Spec("sqs"), Spec("memory", config={"table": "t"})).run(spark)
    with pytest.raises(ValueError, match="url"):
        spark.createDataFrame([("x",)], "value string").createOrReplaceTempView("v_in")
        Pipeline(Spec("memory", config={"table": "v_in"}), Spec("redis", config={}), validate=False).run(spark)


def test_memory_to_memory(spark):
    spark.range(3).createOrReplaceTempView("numbers_in")
    Pipeline(Spec("memory", config={"table": "numbers_in"}), Spec("memory", config={"table": "numbers_out"})).run(spark)
    assert sorted(r.value for r in spark.table("numbers_out").collect()) == ['{"id":0}', '{"id":1}', '{"id":2}']


def test_configurations_are_kept_by_version(spark, tmp_path):
    path = f"{tmp_path}/config"
    with pytest.raises(KeyError):
        Registry.load(spark, path)
    one = Registry.parse({"sources": [{"key": "a", "type": "rate", "name": "r"}], "sinks": [{"key": "a", "type": "file", "name": "f", "config": {"file_path": "x"}}]})
    assert one.save(spark, path) == 1
    one.add_sink(Spec("file", "g", "b", {"file_path": "y"}))
    assert one.save(spark, path) == 2
    assert Registry.load(spark, path) == one and Registry.load(spark, path, 1).keys == ["a"]
    with pytest.raises(KeyError):
        Registry.load(spark, path, 9)


def test_stored_documents_are_read_in_parts(spark, tmp_path):
    feed = f"{tmp_path}/feed"
    open(feed, "w").close()
    config = {"uri": feed, "database": "d", "collection": "c", "load_initial_data": "true", "client": "tests.core.fakes:database", "partitions": "3"}
    load = source(Spec("mongodb", "m", "k", config))[1][0](spark, Spec("mongodb", "m", "k", config))
    assert load.rdd.getNumPartitions() == 3
    assert sorted(json.loads(r.value)["_id"] for r in load.collect()) == [0, 1, 2]


class Feed:
    """A change stream that has nothing now and then, as a database's has."""

    def __init__(self, events, at):
        self.events, self.at, self.calls, self.resume_token = events, at, 0, {"_data": f"{at:04d}"}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass

    def try_next(self):
        self.calls += 1
        if self.calls % 2 or self.at >= len(self.events):
            return None
        self.at += 1
        self.resume_token = {"_data": f"{self.at:04d}"}
        return {"_id": self.resume_token, "fullDocument": self.events[self.at - 1]}


def test_a_feed_that_pauses_loses_nothing(monkeypatch):
    events = list(range(7))

    class Collection:
        def watch(self, full_document, resume_after=None):
            return Feed(events, int(resume_after["_data"]) if resume_after else len(events))

    made = PymongoClient()
    monkeypatch.setattr(made, "_collection", lambda options: Collection())
    assert json.loads(made.start({})) == {"_data": "0007"}
    token = lambda i: json.dumps({"_data": f"{i:04d}"})
    read = lambda a, b: [e["fullDocument"] for e in made.changes({"timeout": "0.2"}, token(a), token(b))]
    assert read(0, 7) == events and read(2, 5) == [2, 3, 4] and read(5, 7) == [5, 6] and read(3, 3) == []
    with pytest.raises(TimeoutError):
        read(5, 9)


def test_live_records_follow_stored_ones():
    spec = Spec("mongodb", "m", "k", {"uri": "u", "database": "d", "collection": "c", "load_initial_data": "true", "client": "tests.core.fakes:database"})
    assert begin(spec).config["start_token"] == "" and begin(begin(spec)) == begin(spec)
    assert begin(Spec("file", "f", "k", {"path": "p"})) == Spec("file", "f", "k", {"path": "p"})


def test_repeated_ids_are_settled_by_an_order(spark):
    rows = [('{"_id":"a","at":2,"v":"new"}',), ('{"_id":"a","at":10,"v":"newest"}',), ('{"_id":"a","v":"none"}',), ('{"_id":"b","at":1}',), ("{}",)]
    df = spark.createDataFrame(rows, "value string")
    for part in (df, df.repartition(4), df.orderBy("value")):
        assert {r.id: json.loads(r.value).get("v") for r in with_ids(part, "$.at").collect()} == {"a": "newest", "b": None}


def test_a_changed_configuration_is_taken_while_pipelines_run(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([('{"n":1}',)], "value string").write.text(src)
    raw = lambda out: {"sources": [{"type": "file", "name": "s", "key": "k", "config": {"path": src, "stream": "true", "schema": "value string"}}], "sinks": [{"type": "file", "name": "o", "key": "k", "config": {"file_path": f"{tmp_path}/{out}", "checkpoint": f"{tmp_path}/ck"}}]}
    registry = Registry.parse(raw("one"))
    registry.run(spark, "k")
    assert registry.reload(spark, raw("one")) == []
    spark.createDataFrame([('{"n":2}',)], "value string").write.mode("append").text(src)
    assert registry.reload(spark, raw("two")) == ["k"]
    registry.running["k"]._query.awaitTermination()
    assert [lines(spark, f"{tmp_path}/{x}") for x in ("one", "two")] == [['{"n":1}'], ['{"n":2}']]
    registry.running["k"].pause()
    spark.createDataFrame([('{"n":3}',)], "value string").write.mode("append").text(src)
    registry.running["k"].resume(spark, wait=True)
    assert lines(spark, f"{tmp_path}/two") == ['{"n":2}', '{"n":3}']


def test_shared_folder_is_needed_on_a_cluster():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Fake:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Fake)
    Fake.conf["spark.master"] = "local[4]"
    assert shared_dir(Fake) == shared_dir(Fake)


def test_entry_without_a_library_of_the_optional_operators(tmp_path):
    """A missing library leaves the optional queries out, with a warning; all others are there."""
    code = (
        "import sys, warnings\n"
        "class Block:\n"
        "    def find_spec(self, name, *_):\n"
        "        if name.split('.')[0] in ('xxhash', 'ahocorasick', 'zstandard'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "warnings.simplefilter('always')\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), any(q.startswith('op1_') for q in e.queries()))\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    n, has = said.stdout.split()[-2:]
    assert int(n) >= 90 and has == "False", said.stderr


def test_records_of_a_web_service(spark, tmp_path):
    """A first load in parts, then live records; what comes in between is read once."""
    held = [json.dumps({"n": i}) for i in range(1, 8)]

    class Service(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in urllib.parse.parse_qs(urllib.parse.urlparse(self.path).query).items()}
            body = str(len(held)) if "latest" in q else "\n".join(held[q["after"] : q["upto"]])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    config = {"url": f"http://127.0.0.1:{server.server_port}/records", "load_initial_data": "true", "partitions": "3", "max_records": "2"}
    p = Pipeline(Spec("http", "s", "k", config), Spec("file", "o", "k", {"file_path": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/ck"}))
    p.run(spark)
    assert sorted(json.loads(x)["n"] for x in lines(spark, f"{tmp_path}/out")) == list(range(1, 8))
    held += [json.dumps({"n": i}) for i in (8, 9)]
    p.resume(spark, wait=True)
    server.shutdown()
    assert sorted(json.loads(x)["n"] for x in lines(spark, f"{tmp_path}/out")) == list(range(1, 10))


def test_documents_are_stored_by_id(spark, tmp_path):
    rows = [('{"_id":"a","at":1}',), ('{"_id":"a","at":3,"v":"x"}',), ('{"_id":"b"}',), ("{}",), (None,)]
    spec = Spec("mongodb", "m", "k", {"uri": f"{tmp_path}/db", "database": "d", "collection": "c", "client": "tests.core.fakes:database", "order": "$.at"})
    registry.sink(spec)[1](spark.createDataFrame(rows, "value string").repartition(3), spec, False)
    got = [d for f in tmp_path.iterdir() if f.name.startswith("db-") for d in json.loads(f.read_text())]
    assert sorted(got, key=lambda d: d["_id"]) == [{"_id": "a", "at": 3, "v": "x"}, {"_id": "b"}]


def test_records_are_pushed_to_a_list():
    got = []

    class Server(socketserver.StreamRequestHandler):
        def handle(self):
            n = int(self.rfile.readline()[1:])
            got.append([(self.rfile.readline(), self.rfile.readline().strip())[1] for _ in range(n)])
            self.wfile.write(b":2\r\n" if b"bad" not in got[-1] else b"-ERR wrong\r\n")

    with socketserver.TCPServer(("127.0.0.1", 0), Server) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"redis://127.0.0.1:{server.server_address[1]}/things"
        sinks.push(url, '{"a":1}\n{"b":"é"}\n', {})
        with pytest.raises(OSError):
            sinks.push(url, "bad\n", {})
        server.shutdown()
    assert got[0] == [b"RPUSH", b"things", b'{"a":1}', '{"b":"é"}'.encode()]
