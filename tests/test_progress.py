"""Progress that ends: no state is left, late listeners see nothing, and a query stops with its jobs."""

from weftline.streaming import state

SCHEMA = "job_id long, seq long, status string, done int, total int"


def send(spark, path, rows, mode="append"):
    state.to_messages(spark.createDataFrame(rows, SCHEMA)).coalesce(1).write.mode(mode).text(path)


def drive(spark, path, checkpoint):
    """One run over what is new: what it gave, and the rows of state that it left."""
    out = []
    stream = state.live_progress(spark.readStream.text(path))
    q = stream.writeStream.foreachBatch(lambda b, _: out.extend(b.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r.job_id, r.seq, r.status, r.done, r.ended) for r in out}, q.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_ended_jobs_leave_no_state(spark, tmp_path):
    path, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    send(spark, path, [(1, 0, "running", 0, 3), (1, 2, "running", 2, 3), (2, 0, "running", 0, 1), (2, 1, "failed", 0, 1), (2, 2, "running", 1, 1), (3, 1, "running", 1, 9)])
    spark.createDataFrame([("no json",), ('{"job_id": 4}',), (None,)], "value string").coalesce(1).write.mode("append").text(path)
    assert drive(spark, path, checkpoint) == ({(1, 2, "running", 2, False), (2, 1, "failed", 0, True), (3, 1, "running", 1, False)}, 2)
    send(spark, path, [(1, 1, "running", 1, 3), (1, 3, "done", 3, 3), (1, 4, "done", 3, 3), (3, 1, "running", 1, 9), (3, 0, "done", 0, 9)])
    assert drive(spark, path, checkpoint) == ({(1, 3, "done", 3, True)}, 1)
    send(spark, path, [(3, 2, "needs_review", 9, 9)])
    assert drive(spark, path, checkpoint) == ({(3, 2, "needs_review", 9, True)}, 0)


def test_a_listener_stops_with_its_jobs(spark, tmp_path):
    path, before = str(tmp_path / "in"), set(q.id for q in spark.streams.active)
    send(spark, path, [(1, 0, "running", 0, 1), (2, 5, "running", 0, 1), (3, 0, "running", 0, 1)])
    seen = []

    def each(row):
        seen.append((row.job_id, row.seq, row.ended))
        if len(seen) == 2:
            send(spark, path, [(1, 1, "done", 1, 1), (2, 6, "failed", 0, 1), (3, 1, "running", 1, 1)])

    assert state.follow(spark.readStream.text(path), [1, 2], each, str(tmp_path / "cp"), 60) == set()
    assert sorted(seen) == [(1, 0, False), (1, 1, True), (2, 5, False), (2, 6, True)]
    assert set(q.id for q in spark.streams.active) == before
    assert state.follow(spark.readStream.text(path), [3], seen.append, str(tmp_path / "cp"), 3) == {3}
    assert set(q.id for q in spark.streams.active) == before
