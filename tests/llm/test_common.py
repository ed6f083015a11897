import pytest

from tributary.llm.common import by_batches, cut, keep, ordered_ids, scope


def there(df):
    p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tributary_path)
    return p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(p)


def test_tables_go_with_their_scope(spark):
    outside = cut(spark.range(3))
    with scope():
        kept, gone = cut(spark.range(4)), None
        with scope():
            gone, up = cut(spark.range(5)), keep(cut(spark.range(6)))
        assert not there(gone) and there(up)
        keep(kept)
    assert there(outside) and there(kept) and not there(up)
    with pytest.raises(ZeroDivisionError), scope():
        lost = cut(spark.range(2))
        1 / 0
    assert not there(lost)


def test_the_sessions_batches_stay_as_they_are(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    sizes = by_batches(spark.range(5000, numPartitions=1), lambda batches: batches, "id long", 300)
    assert cut(sizes).count() == 5000 and spark.conf.get(key) == was
    spark.conf.set(key, "77")
    try:
        cut(spark.range(3))
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, was)


def test_ids_of_any_type_sort_alike(spark):
    rows = [("b",), (None,), ("a",), ("ä",), ("b",), ("",)]
    got = {r.id: r.order for r in ordered_ids(spark.createDataFrame(rows, "id string"), parts=3).collect()}
    assert got[None] is None and sorted((x for x in got if x is not None), key=got.get) == ["", "a", "b", "ä"]
