import pytest
from conftest import rows_of

from casework.operators import reports
from casework.streaming import rates

SCHEMA = "request_id string, error string, escalate boolean, needs_agent boolean, day string, plan string, seq long"
BY = ["day", "plan"]
FIRST = [("r1", None, False, False, "d1", "Growth", 1), ("r1", None, True, False, "d1", "Growth", 0),
         ("r2", None, True, False, "d1", None, 0), ("r3", "boom", None, None, "d2", "Growth", 0),
         (None, None, False, False, "d1", "Growth", 0)]
SECOND = [("r2", None, False, False, "d1", None, 0), ("r1", None, False, True, "d3", "Growth", 0),
          ("r4", None, False, False, "d1", "Growth", 0)]
LAST = [FIRST[3], *SECOND]  # what counts in the end


def run(spark, tmp_path, step, counted):
    spark.createDataFrame(step, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    arriving = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    rates.stream_resolution(arriving, BY, "seq", counted, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()


def expected(spark, rows):
    return rows_of(reports.resolution_rate(spark.createDataFrame(rows, SCHEMA), BY))


def test_later_batches_correct_earlier_ones(spark, tmp_path):
    counted = rates.create_counted(spark, str(tmp_path / "counted"), BY, 100)
    run(spark, tmp_path, FIRST, counted)
    assert rows_of(rates.read_rates(spark, str(tmp_path / "log"), BY)) == expected(spark, [FIRST[0], FIRST[2], FIRST[3]])
    run(spark, tmp_path, SECOND, counted)
    assert rows_of(rates.read_rates(spark, str(tmp_path / "log"), BY)) == expected(spark, LAST)


@pytest.mark.parametrize("lost", ["merge", "publish_batch"])
def test_a_batch_that_fails_counts_once(spark, tmp_path, monkeypatch, lost):
    """Fails before the merge, or between the merge and the counts, and runs again."""
    counted = rates.create_counted(spark, str(tmp_path / "counted"), BY, 100)
    run(spark, tmp_path, FIRST, counted)

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(rates.Versioned if lost == "merge" else rates, lost, fail)
        with pytest.raises(Exception, match="lost"):
            run(spark, tmp_path, SECOND, counted)
    assert rows_of(rates.read_rates(spark, str(tmp_path / "log"), BY)) == expected(spark, [FIRST[0], FIRST[2], FIRST[3]])
    arriving = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    rates.stream_resolution(arriving, BY, "seq", counted, str(tmp_path / "log"), str(tmp_path / "check")).awaitTermination()
    assert rows_of(rates.read_rates(spark, str(tmp_path / "log"), BY)) == expected(spark, LAST)


def test_nothing_published(spark, tmp_path):
    assert rates.read_rates(spark, str(tmp_path / "none"), BY).isEmpty()
