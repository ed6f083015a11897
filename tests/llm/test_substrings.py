import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.oracle import same
from tributary.llm import substrings
from tributary.llm.common import cut


def brute(rows, k=50):
    first = {}
    key = lambda i: (i is None, i or 0)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for p in range(len(t) - k + 1):
            s = t[p : p + k]
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - k + 1):
            if first[t[p : p + k]] < key(i):
                gone[p : p + k] = b"\1" * k
        runs = sum(1 for j in range(len(t)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((str(i), len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def result(df, **kw):
    out = substrings.dedup_substrings(df, **kw).collect()
    return sorted((str(r.id), r.n_bytes, r.n_removed, len(r.spans or ()) // 2, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out)


def data():
    rnd = random.Random(6)
    words = ["alpha", "béta", "γ", "the", "of", "日本"]
    para = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 60))) for _ in range(25)]
    rows = []
    for i in range(150):
        parts = [rnd.choice(para) if rnd.random() < 0.4 else " ".join(rnd.choice(words) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(1, 4))]
        rows.append((rnd.randint(0, 400), "\n".join(parts)))
    rows += [(500, "ab" * 400), (501, "ab" * 30), (502, "z" * 49), (503, "z" * 49), (504, "z" * 50), (505, "z" * 51), (506, None), (507, "")]
    rows += [(None, rows[0][1]), (None, "x" + rows[1][1]), rows[2], rows[2]]
    return rows


def test_against_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, spans string")
    want = brute(rows)
    assert result(df) == want
    assert result(df.repartition(5), bucket=1000) == want


def test_large_buckets_are_sliced(spark, monkeypatch):
    rows = data()
    texts = [(t or "").encode() for _, t in rows]
    text, start, end, _ = substrings.runs(texts)
    raw = b"".join(texts[t][s:e] for t, s, e in zip(text, start, end, strict=True))
    ids = np.array([10**6 if i is None else i for i, _ in rows])[text]
    args = raw, end - start, np.zeros_like(start), ids, text.astype(np.int64), start
    whole = {tuple(x) for x in zip(*(a.tolist() for a in substrings.repeated(*args)), strict=True)}
    monkeypatch.setattr(substrings, "SLICE", 5000)
    assert {tuple(x) for x in zip(*(a.tolist() for a in substrings.repeated(*args)), strict=True)} == whole


def test_equal_identifiers_are_parted(monkeypatch):
    monkeypatch.setattr(substrings, "_mix", lambda x, y=None: x & np.uint64(1))
    rnd = random.Random(1)
    buf = bytes(rnd.choice(b"ab") for _ in range(300)) * 2
    at = np.arange(len(buf) - 50)
    order, group = substrings.refine(buf + b"\0" * 16, at)
    got = {}
    for i, g in zip(order.tolist(), group.tolist(), strict=True):
        got.setdefault(g, set()).add(buf[i : i + 50])
    assert all(len(x) == 1 for x in got.values())
    assert len(set().union(*got.values())) == len(got)


def test_sf(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert result(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty_table(spark):
    assert substrings.dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sf_against_sql(spark):
    same(spark, substrings.op6_substrings, substrings.SQL)


def test_rounds_and_crowded_buckets(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        unit = rnd.choice(["the and ", "ab", "x", "0123456789" * 7, "common words go here, "])
        body = (unit * 400)[rnd.randint(0, 9) : rnd.randint(60, 900)]
        rows.append((rnd.randint(0, 99), rnd.choice(["", "head "]) + body + rnd.choice(["", " tail", "é"])))
    phrase = " of the first part of "
    rows += [(100 + i, "".join(phrase + rnd.choice(["alpha", "beta", "gamma", "delta"]) * rnd.randint(1, 3) for _ in range(40))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    for bucket in (1 << 20, 3000, 300):
        assert result(df, bucket=bucket) == want


def test_period():
    assert substrings.period(b"ab" * 200) == 2 and substrings.period(b"ab" * 200 + b"c") == 0 and substrings.period(b"ab" * 50) == 0
    unit = bytes(range(97))
    assert substrings.period((unit * 9)[5:800]) == 97 and substrings.period(unit * 2) == 0


def test_buckets_are_dealt_again(spark):
    """Few and small buckets, as beyond FAN * MOST bytes of input: the same spans."""
    rows = data()
    df = spark.createDataFrame(rows, "id long, text string").select(F.monotonically_increasing_id().alias("__row"), "id", "text")
    df = cut(df)
    told = lambda of: sorted((r["of"], *r["spans"]) for r in of.collect())
    want = told(substrings.repeats(df, id="id"))
    assert len(want) > 50
    for fan, most in ((4, 500), (2, 60), (64, 300)):
        assert told(substrings.repeats(df, id="id", bucket=4000, fan=fan, most=most)) == want


def test_a_run_in_circles_is_dealt_again():
    texts = [b"ab" * 400, b"ab" * 90, b"x" * 300 + b"ab" * 200]
    of = np.arange(3)
    dealt = substrings._blobs(of, of, np.zeros(3, np.int64), texts, lambda t, o: (*substrings._all_runs(t, 50)[:3], np.zeros(len(substrings._all_runs(t, 50)[0]), np.int64)), 1024, 50)
    table = pa.Table.from_batches([dealt])
    table = table.append_column("parts", pa.array([3] * table.num_rows))
    want, got = [], []
    for rows_, out in ((table, want), (pa.Table.from_batches(list(substrings._deal_again(50, 1024, substrings._B)(iter(table.to_batches())))), got)):
        for r in rows_.to_pylist():
            if r["kind"] == 0:
                id_, row, start, size, whole = substrings._unpack(r["numbers"], 5)
                out += [(int(d), int(a) + p) for d, a, s, w in zip(row, start, size, whole, strict=True) for p in range(max(s, w) - 49)]
            else:
                row, start, size = substrings._unpack(r["numbers"], 3)
                out += [(int(d), int(a) + p) for d, a, s in zip(row, start, size, strict=True) for p in range(s - 49)]
    assert sorted(got) == sorted(want)


def test_what_is_sent_does_not_grow_with_the_buckets():
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(2, 9))) for _ in range(5000)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(3000)) for _ in range(800)]
    batch = pa.record_batch([pa.array(range(800)), pa.array(range(800)), pa.array(texts)], names=["r", "id", "text"])
    sent = []
    for buckets in (512, substrings.FAN):
        out = list(substrings._deal(buckets, 50, 1024, {})(iter([batch])))
        sent.append(sum(len(x or b"") + 40 for o in out for c in ("numbers", "bytes") for x in o[c].to_pylist()))
    assert sent[1] < 1.15 * sent[0]


def test_ids_of_text(spark):
    rows = [("b", "z" * 60), ("a", "z" * 55), (None, "z" * 51), ("c", "short")]
    out = {r["id"]: r["n_removed"] for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert out == {"b": 60, "a": 0, None: 51, "c": 0}
