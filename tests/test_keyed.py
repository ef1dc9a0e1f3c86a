import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from casework.sources.keyed import rows_of_keys, store_by_key


def numbered(spark, n):
    return spark.range(n).selectExpr("concat('K', id) AS k", "id AS v", "repeat('x', 200) AS wide")


def bytes_read(spark, run):
    """Bytes of input that the tasks of ``run`` report, by the status store of the session."""
    store, none = spark._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList()

    def total():
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(none, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), none)
        return sum(stages.apply(i).inputBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_keys_find_their_rows(spark, tmp_path):
    table = numbered(spark, 1000).union(spark.sql("SELECT cast(NULL AS string), 5000L, 'n'"))
    kept = store_by_key(table, "k", str(tmp_path / "t"), 50)
    keys = spark.createDataFrame([("K1",), ("K1",), ("K999",), ("none",), (None,)], "some string")
    assert kept.buckets == 21 and kept.rows.count() == 1001
    for stored in (kept, table):
        assert rows_of(rows_of_keys(stored, "k", keys), "k", "v") == [("K1", 1), ("K999", 999)]
    assert kept.of(keys).columns == table.columns
    with pytest.raises(ValueError, match="stored by k, asked by v"):
        rows_of_keys(kept, "v", keys)


def test_no_keys_and_no_rows(spark, tmp_path):
    none = spark.createDataFrame([], "k string")
    assert store_by_key(numbered(spark, 30), "k", str(tmp_path / "t"), 10).of(none).isEmpty()
    empty = store_by_key(numbered(spark, 0), "k", str(tmp_path / "e"))
    assert empty.of(spark.createDataFrame([("K1",)], "k string")).isEmpty()


def test_what_a_batch_reads_does_not_grow_with_the_table(spark, tmp_path):
    keys = spark.createDataFrame([("K7",), ("K77",), ("K477",)], "k string").coalesce(1)
    read, size = {}, {}
    for n in (2000, 40000):
        kept = store_by_key(numbered(spark, n), "k", str(tmp_path / str(n)), 100)
        files = [f for _, _, names in os.walk(tmp_path / str(n)) for f in names if f.endswith(".parquet")]
        assert len(files) <= 2 * kept.buckets
        read[n] = bytes_read(spark, lambda: kept.of(keys).collect())
        size[n] = bytes_read(spark, lambda: kept.rows.write.format("noop").mode("overwrite").save())
    assert 0 < read[40000] < 2 * read[2000] and size[40000] > 10 * size[2000]


def test_a_hot_key_is_written_by_several_tasks(spark, tmp_path, settings):
    settings(spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
             spark__sql__adaptive__coalescePartitions__initialPartitionNum="8")
    hot = spark.range(0, 60000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'HOT', concat('K', id)) AS k", "id AS v", "sha2(cast(id AS string), 256) AS wide")
    kept = store_by_key(hot, "k", str(tmp_path / "t"), 10000)
    assert kept.of(spark.createDataFrame([("HOT",)], "k string")).count() == 20000
    files = kept.rows.where("k = 'HOT'").select(F.input_file_name()).distinct()
    assert files.count() > 1
