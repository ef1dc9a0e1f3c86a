import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from casework.operators import actions as act
from casework.operators.confirm import confirmation_outcomes, match_confirmations
from casework.operators.decide import evaluate_requests, gate
from casework.operators.vectors import hash_embedding
from casework.plans import fixtures as fx
from casework.sources.keyed import store_by_key
from casework.streaming import flows, replies

SF_DIR = "/root/testdata/sf0.001"
T0 = dt.datetime(2026, 8, 16, 12)


def test_actions_in_batches_equal_one_sequence(spark, tmp_path):
    """Two files, one per micro-batch, with a restart between them; then a replay of the last."""
    actions = fx.actions(spark, SF_DIR)
    sides = (fx.shipments(spark, SF_DIR), fx.tickets(spark, SF_DIR), fx.escalations0(spark, SF_DIR), fx.credits0(spark, SF_DIR))
    folder, log, mark = (str(tmp_path / n) for n in ("in", "log", "mark"))

    def run(checkpoint=mark):
        incoming = flows.table_stream(spark, folder, actions.schema, files_per_trigger=1)
        flows.stream_apply(incoming, *sides, log, checkpoint).awaitTermination()

    actions.where("seq < 500").coalesce(1).write.mode("append").parquet(folder)
    run()
    actions.where("seq >= 500").coalesce(1).write.mode("append").parquet(folder)
    run()
    expected = act.apply_action_sequence(actions, *sides).select(*flows.OUTCOMES.fieldNames())
    assert rows_of(flows.read_outcomes(spark, log)) == rows_of(expected)
    assert flows.logged_audit(spark, log).count() == expected.where("outcome = 'executed'").count()

    state = flows.applied_state(flows.read_outcomes(spark, log), sides[0], sides[2], sides[3])
    replay = act.apply_action_sequence(actions, state[0], sides[1], state[1], state[2])
    assert replay.where("outcome = 'executed'").isEmpty()

    run(str(tmp_path / "lost"))
    assert rows_of(flows.read_outcomes(spark, log)) == rows_of(expected)


def stored(spark, folder, bucket_rows, **tables):
    return [store_by_key(rows, key, str(folder / name), bucket_rows) for name, (rows, key) in tables.items()]


def test_actions_on_stored_tables_equal_one_sequence(spark, tmp_path):
    """Five batches; only the segments that the next batch reads are left of the merged ones."""
    actions = fx.actions(spark, SF_DIR)
    sides = (fx.shipments(spark, SF_DIR), fx.tickets(spark, SF_DIR), fx.escalations0(spark, SF_DIR), fx.credits0(spark, SF_DIR))
    keyed = stored(spark, tmp_path, 100, orders=(sides[0], "order_id"), tickets=(sides[1], "ticket_id"),
                   escalations=(sides[2], "ticket_id"), credits=(sides[3], "order_id"))
    assert keyed[0].buckets > 5
    folder, log = str(tmp_path / "in"), str(tmp_path / "log")
    for i in range(5):
        actions.where(f"floor(seq / 200) % 5 = {i}").coalesce(1).write.mode("append").parquet(folder)
    incoming = flows.table_stream(spark, folder, actions.schema, files_per_trigger=1)
    flows.stream_apply(incoming, *keyed, log, str(tmp_path / "mark")).awaitTermination()
    order = F.expr("floor(seq / 200) % 5 * 100000000 + seq")
    expected = act.apply_action_sequence(actions.withColumn("seq", order), *sides)
    columns = [c for c in flows.OUTCOMES.fieldNames() if c != "seq"]
    assert rows_of(flows.read_outcomes(spark, log), *columns) == rows_of(expected, *columns)
    left = {str(f.relative_to(log)) for f in (tmp_path / "log" / "state").glob("*/*")}
    assert left == {"state/from=0/to=4", "state/from=4/to=5"}


@pytest.mark.parametrize("by_key", [False, True])
def test_requests_in_batches_equal_one_run(spark, tmp_path, by_key):
    requests, accounts, orders, tickets, evidence = (
        f(spark, SF_DIR) for f in (fx.requests, fx.accounts, fx.shipments, fx.tickets, fx.evidence))
    if by_key:
        accounts, orders, tickets = stored(
            spark, tmp_path, 100, accounts=(accounts, "account_id"), orders=(orders, "order_id"),
            tickets=(tickets, "account_id"))
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    requests.repartition(3, "request_id").write.parquet(folder)
    incoming = flows.table_stream(spark, folder, requests.schema, files_per_trigger=1)
    flows.stream_evaluate(incoming, accounts, orders, tickets,
                          lambda batch: evidence.join(batch.select("request_id"), "request_id", "left_semi"),
                          sink, str(tmp_path / "mark")).awaitTermination()
    whole = (t.rows.drop("_bucket") if by_key else t for t in (accounts, orders, tickets))
    expected = gate(evaluate_requests(requests, *whole, evidence))
    assert rows_of(spark.read.parquet(sink).select(*expected.columns)) == rows_of(expected)


def test_embedding_drains_the_backlog(spark, tmp_path):
    chunks = fx.chunk_vectors(spark, SF_DIR)
    folder, sink = str(tmp_path / "in"), str(tmp_path / "out")
    chunks.repartition(3, "chunk_id").write.parquet(folder)
    incoming = flows.table_stream(spark, folder, chunks.schema, files_per_trigger=1)
    flows.stream_embed(incoming, sink, str(tmp_path / "mark"), "hash", 16).awaitTermination()
    waiting = chunks.where("embedding IS NULL").drop("embedding")
    expected = hash_embedding(waiting, "content", 16)
    assert rows_of(spark.read.parquet(sink), "chunk_id", "embedding") == rows_of(expected, "chunk_id", "embedding")


PROPOSALS = "confirmation_id string, created_at timestamp, action_type string, target_id string, reason string"
ANSWERS = "confirmation_id string, seq long, answered_at timestamp, confirm boolean"


def confirm_in_pieces(spark, tmp_path, pieces, minutes_late):
    """Each piece is (proposals, answers) written as a file and run, with a restart in between."""
    sink, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for name in ("p", "a"):
        (tmp_path / name).mkdir()
    end = T0 + dt.timedelta(days=3)
    closing = ([("END", end, "x", "x", "x")], [("END", 99, end, True)])
    for proposals, answers in (*pieces, closing):
        spark.createDataFrame(proposals, PROPOSALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        spark.createDataFrame(answers, ANSWERS).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        left = spark.readStream.schema(PROPOSALS).parquet(str(tmp_path / "p"))
        right = spark.readStream.schema(ANSWERS).parquet(str(tmp_path / "a"))
        out = flows.confirmation_stream(left, right, lateness_minutes=minutes_late)
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark).trigger(
            availableNow=True).start().awaitTermination()
    found = spark.read.schema(out.schema).parquet(sink).where("confirmation_id <> 'END'")
    proposals = spark.createDataFrame([p for piece in pieces for p in piece[0]], PROPOSALS)
    answers = spark.createDataFrame([a for piece in pieces for a in piece[1]], ANSWERS)
    return found, confirmation_outcomes(proposals, answers)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def proposal(c, minutes):
    return (c, at(minutes), "CANCEL_ORDER", f"O{c}", "r")


def test_confirmations_across_a_restart(spark, tmp_path):
    """Batch outcomes minus answers in time that came second, whatever arrives first."""
    pieces = [
        ([proposal(c, 0) for c in "ABCDE"], [("A", 1, at(10), True), ("B", 5, at(3), True), ("Z", 3, at(2), True), ("F", 8, at(3), False)]),
        ([proposal("F", 1)], [("A", 4, at(10), True), ("B", 2, at(1), False), ("C", 6, at(11), True), ("D", 7, at(5), True),
                              ("F", 9, at(0), True), ("Z", 10, at(4), True)]),
    ]
    found, batch = confirm_in_pieces(spark, tmp_path, pieces, 60)
    shown = ("seq", "status", "error", "action_type", "target_id")
    answered = found.where("seq IS NOT NULL").withColumns(
        {c: F.when(F.col("status") == "executed", F.col(c)) for c in shown[3:]})
    lost = (4, 5)  # in time, but after another
    assert rows_of(answered, *shown) == rows_of(batch.where(~F.col("seq").isin(*lost)), *shown)
    assert rows_of(found.where("seq IS NULL"), "confirmation_id", "status") == [("C", "expired"), ("E", "expired")]


def test_an_earlier_rejection_beats_a_confirmation_that_arrives_first(spark, tmp_path):
    ids = [f"P{i}" for i in range(50)]
    answers = [(c, 2 * i, at(5), True) for i, c in enumerate(ids)] + [(c, 2 * i + 1, at(1), False) for i, c in enumerate(ids)]
    found, _ = confirm_in_pieces(spark, tmp_path, [([proposal(c, 0) for c in ids], answers)], 10)
    assert found.groupBy("status").count().collect() == [("rejected", 50)]


def reply_in_pieces(spark, tmp_path, pieces, lateness, checkpoint="mark"):
    """Each piece is (proposals, answers), one micro-batch with a restart before the next."""
    sink = str(tmp_path / "sink")
    for name in ("p", "a"):
        (tmp_path / name).mkdir(exist_ok=True)
    for proposals, answers in pieces:
        spark.createDataFrame(proposals, PROPOSALS).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        spark.createDataFrame(answers, ANSWERS).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        left = spark.readStream.schema(PROPOSALS).parquet(str(tmp_path / "p"))
        right = spark.readStream.schema(ANSWERS).parquet(str(tmp_path / "a"))
        replies.stream_replies(left, right, sink, str(tmp_path / checkpoint), lateness).awaitTermination()
    return sink


def test_every_answer_has_a_reply(spark, tmp_path):
    """Second, early, late and strange answers, before and after their proposals, over restarts."""
    pieces = [
        ([proposal(c, 0) for c in "ABCDE"], [("A", 1, at(10), True), ("B", 5, at(3), True), ("Z", 3, at(2), True), ("F", 8, at(3), False)]),
        ([proposal("F", 1)], [("A", 4, at(10), True), ("B", 2, at(1), False), ("C", 6, at(11), True), ("D", 7, at(5), True),
                              ("F", 9, at(0), True), ("Z", 10, at(4), True), ("D", 11, at(5), False)]),
        ([proposal("G", 200)], [("A", 12, at(190), True), ("G", 13, at(201), True)]),
        ([proposal("END", 5000)], []),
    ]
    sink = reply_in_pieces(spark, tmp_path, pieces, 60)
    given = [spark.createDataFrame([r for piece in pieces for r in piece[i]], s) for i, s in ((0, PROPOSALS), (1, ANSWERS))]
    expected = confirmation_outcomes(*given)
    found = replies.read_replies(spark, sink)
    assert rows_of(found) == rows_of(expected) and found.count() == 13
    ended = replies.read_replies(spark, sink, "proposals")
    assert rows_of(ended) == rows_of(match_confirmations(*given).where("confirmation_id <> 'END'"))
    assert rows_of(replies.read_replies(spark, sink, "late")) == []


def test_late_rows_are_shown_and_answered(spark, tmp_path):
    pieces = [([proposal("A", 0), proposal("B", 100)], []),
              ([proposal("C", 3)], [("A", 1, at(5), True), ("B", 2, at(101), True), (None, 3, None, True)]),
              ([proposal("END", 5000)], [])]
    sink = reply_in_pieces(spark, tmp_path, pieces, 20)
    found = replies.read_replies(spark, sink)
    assert rows_of(found, "seq", "status", "error") == sorted(
        [(1, None, replies.NOT_FOUND), (2, "executed", None), (3, None, replies.NOT_FOUND)], key=repr)
    late = replies.read_replies(spark, sink, "late")
    assert rows_of(late, "confirmation_id", "kind") == sorted([("A", "answer"), ("C", "proposal"), (None, "answer")], key=repr)
    assert rows_of(replies.read_replies(spark, sink, "proposals"), "confirmation_id", "state") == [("A", "expired"), ("B", "confirmed")]


def test_open_rows_stay_within_the_interval(spark, tmp_path):
    """A proposal and its answer each minute: what is open never goes beyond interval and lateness."""
    pieces = [([proposal(f"P{m}", m) for m in range(b * 60, b * 60 + 60)],
               [(f"P{m}", m, at(m), True) for m in range(b * 60, b * 60 + 60)]) for b in range(4)]
    for i in range(len(pieces)):
        sink = reply_in_pieces(spark, tmp_path, pieces[i : i + 1], 5)
        latest = spark.read.parquet(f"{sink}/open/batch={i}")
        assert latest.count() == 2 * (10 + 5 + 1)
    assert replies.read_replies(spark, sink).where("status = 'executed'").count() == 240 - 16
    assert len(list((tmp_path / "sink" / "open").glob("batch=*"))) == 2
