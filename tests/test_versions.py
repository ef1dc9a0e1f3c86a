import datetime as dt
import os

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from casework.sources import tables, versions
from casework.sources.versions import create_table, open_table, publish_batch, read_batches

OLD, NOW = dt.datetime(2026, 1, 1), dt.datetime(2026, 2, 1)
SCHEMA = "k string, a string, created_at timestamp, updated_at timestamp"


def held(spark, n):
    return spark.range(n).select(F.concat(F.lit("K"), F.col("id")).alias("k"), F.lit("old").alias("a"),
                                 F.lit(OLD).alias("created_at"), F.lit(OLD).alias("updated_at"))


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "seq int, k string, a string")


def files(folder):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns
            for at, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def test_merge_equals_the_upsert_of_the_whole_table(spark, tmp_path):
    table = create_table(held(spark, 500), "k", str(tmp_path / "t"), 20)
    assert table.buckets == 25
    changes = [batch(spark, (1, "K3", "x"), (2, "K3", None), (3, "new", "y")),
               batch(spark, (1, "new", "z"), (2, None, "n"), (3, "K499", "w"), (4, "K499", "w"))]
    whole = held(spark, 500)
    for i, change in enumerate(changes):
        whole = tables.upsert(whole, change, "k", "seq", F.lit(NOW))
        assert table.merge(change, "seq", F.lit(NOW)) == i + 1
        assert rows_of(table.rows()) == rows_of(whole)
    assert rows_of(table.rows(0)) == rows_of(held(spark, 500))
    again = open_table(spark, str(tmp_path / "t"))
    assert (again.key, again.buckets, again.schema) == ("k", 25, table.schema)
    asked = spark.createDataFrame([("new",), ("K3",), ("none",), (None,)], "some string")
    assert rows_of(again.of(asked), "k", "a") == [("K3", None), ("new", "z")]


def test_keys_of_another_type_find_their_bucket(spark, tmp_path):
    numbers = held(spark, 200).withColumn("k", F.regexp_extract("k", "[0-9]+", 0))
    table = create_table(numbers, "k", str(tmp_path / "t"), 10)
    change = spark.createDataFrame([(1, 7, "x"), (2, 150, "y")], "seq int, k long, a string")
    table.merge(change, "seq", F.lit(NOW))
    assert table.rows().count() == 200
    assert rows_of(table.of(change.select("k")), "k", "a") == [("150", "y"), ("7", "x")]


def test_a_merge_leaves_other_buckets_alone(spark, tmp_path):
    table = create_table(held(spark, 4000), "k", str(tmp_path / "t"), 40)
    before = files(tmp_path / "t" / "data")
    change = batch(spark, *[(i, f"K{i * 7}", "x") for i in range(5)])
    table.merge(change, "seq", F.lit(NOW))
    after = files(tmp_path / "t" / "data")
    assert before.items() <= after.items()
    written = {p.split("_bucket=")[1].split("/")[0] for p in after.keys() - before.keys()}
    assert 0 < len(written) <= 5
    assert table.rows().where("a = 'x'").count() == 5 and table.rows().count() == 4000


@pytest.mark.parametrize("at", ["_publish", "_mark", "_write"])
def test_a_failed_merge_changes_nothing_and_is_done_again(spark, tmp_path, monkeypatch, at):
    table = create_table(held(spark, 100), "k", str(tmp_path / "t"), 10)
    change = batch(spark, (1, "K1", "x"), (2, "K200", "y"))

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions if at == "_mark" else versions.Versioned, at, lost)
        with pytest.raises(RuntimeError, match="lost"):
            table.merge(change, "seq", F.lit(NOW))
    assert table.versions() == [0] and rows_of(table.rows()) == rows_of(held(spark, 100))
    table.merge(change, "seq", F.lit(NOW))
    assert rows_of(table.rows()) == rows_of(tables.upsert(held(spark, 100), change, "k", "seq", F.lit(NOW)))


def test_a_reader_keeps_its_version_and_old_ones_can_go(spark, tmp_path):
    table = create_table(held(spark, 100), "k", str(tmp_path / "t"), 10)
    reader = table.rows()
    for i in range(3):
        table.merge(batch(spark, (1, "K1", f"v{i}")), "seq", F.lit(NOW))
    assert rows_of(reader) == rows_of(held(spark, 100))
    last, size = rows_of(table.rows()), len(files(tmp_path / "t" / "data"))
    table.drop_old(keep=2)
    assert table.versions() == [2, 3] and rows_of(table.rows()) == last
    assert rows_of(table.rows(2).where("k = 'K1'"), "a") == [("v1",)]
    assert len(files(tmp_path / "t" / "data")) < size


def test_two_writers_of_one_version(spark, tmp_path):
    table = create_table(held(spark, 20), "k", str(tmp_path / "t"), 10)
    places = table._places(0)
    table._publish(places, 1)
    with pytest.raises(Exception, match="[Ee]xist"):
        versions._mark(spark, f"{table.path}/published/1")
    with pytest.raises(ValueError, match="there is a table"):
        create_table(held(spark, 20), "k", str(tmp_path / "t"))


def test_empty_table_and_empty_batch(spark, tmp_path):
    empty = create_table(spark.createDataFrame([], SCHEMA), "k", str(tmp_path / "t"))
    assert empty.rows().isEmpty() and empty.merge(batch(spark), "seq", F.lit(NOW)) == 0
    empty.merge(batch(spark, (1, "a", "b")), "seq", F.lit(NOW))
    assert rows_of(empty.rows()) == [("a", "b", NOW, NOW)]
    with pytest.raises(ValueError, match="no table"):
        open_table(spark, str(tmp_path / "none"))


def test_a_replayed_batch_is_never_half_seen(spark, tmp_path):
    path, schema = str(tmp_path / "log"), held(spark, 0).schema
    assert read_batches(spark, path, schema).isEmpty()
    publish_batch(held(spark, 5), path, 0)
    publish_batch(held(spark, 9), path, 1)
    reader = read_batches(spark, path, schema)
    broken = held(spark, 9).withColumn("a", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        publish_batch(broken, path, 1)
    assert read_batches(spark, path, schema).count() == 14
    publish_batch(held(spark, 7), path, 1)
    assert reader.count() == 14
    assert read_batches(spark, path, schema).count() == 12
    for n in (6, 8):
        publish_batch(held(spark, n), path, 1)
    assert read_batches(spark, path, schema).count() == 13
    assert sorted(n for n in os.listdir(tmp_path / "log" / "data") if n[0] != ".") == ["0-0", "1-2", "1-3"]
