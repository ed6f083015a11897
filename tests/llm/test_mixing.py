import random

import pytest
from pyspark.sql import functions as F

from tests.llm.oracle import same
from tributary.llm import mixing


def brute_targets(sizes, weights, cap=3.0):
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        w = sum(x for i, x in enumerate(weights) if i not in capped)
        level = rest / w if w else 0
        new = {i for i, x in enumerate(weights) if i not in capped and x * level > cap * sizes[i]}
        if not new:
            return [cap * sizes[i] if i in capped else x * level for i, x in enumerate(weights)]
        capped |= new


def words(text):
    return len((text or "").encode().split())


def data():
    rnd = random.Random(4)
    out = []
    for i in range(900):
        s = rnd.choice(["big"] * 20 + ["A", "b", "é", "\U0001f600", "zz", None, ""])
        out.append((i, s, None if i % 50 == 0 else " ".join(["w\x85x"] * rnd.choice([0, 1, 5, 40]) + ["é"] * rnd.choice([0, 900 if i == 77 else 3]))))
    return out + [(7, "big", "same row"), (7, "big", "same row"), (None, None, "no id")]


def test_targets_and_words_taken(spark):
    rows = data()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, size int, target int")
    got = mixing.mix(df, bucket=16).collect()
    assert len(got) == len(rows)
    names = sorted({s for _, s, _ in rows if s is not None}) + [None]
    sizes = [sum(words(t) for _, s, t in rows if s == n) for n in names]
    want = brute_targets(sizes, [1 + i % 3 for i in range(len(names))])
    for n, size, target in zip(names, sizes, want, strict=True):
        own = [r for r in got if r.source == n]
        assert all(r.source_size == size and r.target == pytest.approx(target) for r in own)
        assert all(0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.copies * r["size"] for r in own) - target) <= max(r["size"] for r in own)
    assert sorted((str(r.id), str(r.source), r["size"]) for r in got) == sorted((str(i), str(s), words(t)) for i, s, t in rows)


def test_reruns_and_other_partitions_agree(spark):
    df = spark.createDataFrame(data(), "doc_id long, source string, text string")
    pick = lambda x: sorted(map(str, mixing.mix(x, bucket=16).select("id", "source", "size", "copies").collect()))
    assert pick(df) == pick(df.repartition(7)) == pick(df.orderBy("text"))


def test_rows_of_the_mix(spark):
    df = spark.createDataFrame(data(), "doc_id long, source string, text string")
    out = mixing.mixed(df)
    assert out.columns == df.columns
    copies = mixing.mix(df).agg(F.sum("copies")).first()[0]
    assert out.count() == copies


def test_given_weights(spark):
    df = spark.createDataFrame([(1, "a", "x " * 10), (2, "b", "x " * 100), (3, "c", "x")], "doc_id long, source string, text string")
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "source string, weight double")
    got = {r.source: r.target for r in mixing.mix(df, w).collect()}
    assert got == {"a": pytest.approx(30), "b": pytest.approx(81), "c": 0}


def test_empty_table_and_wordless_source(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, source string, text string")).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, "a", ""), (2, "b", "x y")], "doc_id long, source string, text string")).collect()
    assert sorted((r.id, r.target, r.copies) for r in got) == [(1, 0.0, 0), (2, 2.0, 1)]


def test_sf_against_sql(spark):
    same(spark, mixing.op5_mixing, mixing.SQL)


def test_null_ids_and_a_hot_row(spark):
    """A third of the rows without an id, a third one and the same row: as many are taken as the targets ask for."""
    rows = [(None, "a", f"w{i} " * (i % 7)) for i in range(3000)] + [(5, "a", "one and the same")] * 3000 + [(i, "b", "x y z") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(6).cache()
    got = mixing.mix(df, bucket=64).collect()
    targets = brute_targets([sum(words(t) for _, s, t in rows if s == x) for x in "ab"], [1, 2])
    for source, target in zip("ab", targets, strict=True):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in own) - target) <= 7
        assert max(r.copies for r in own) - min(r.copies for r in own) == 1
    pick = lambda x: sorted(map(str, mixing.mix(x, bucket=64).select("id", "source", "size", "copies").collect()))
    assert pick(df) == pick(df.coalesce(2))
    # Which of equal rows are taken is told within their partitions: no task sees them all.
    hot = spark.createDataFrame([(1, "a", "x y")] * 4000 + [(2, "b", "x y")] * 999, "doc_id long, source string, text string").repartition(8).cache()
    taken = mixing.mix(hot).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("t")).collect()
    assert len(taken) == 2 and all(abs(r.n - r.t) <= 2 for r in taken)
