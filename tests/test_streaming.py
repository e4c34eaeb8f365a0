"""Streams over several batches: late rows, replays, closed gates."""

import datetime as dt
import os

from pyspark.sql import functions as F

from amberline.operators import gates
from amberline.streaming import conduct


def day(n, hour=1):
    return dt.datetime(2024, 1, n, hour)


def write(spark, folder, name, rows):
    spark.createDataFrame([(i, t, u, "x", v, "") for i, t, u, v in rows], conduct.EVENT_SCHEMA).coalesce(1).write.parquet(os.path.join(folder, name))


def test_late_rows_are_dropped_and_alerts_come_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, "b1", [(1, day(1), 7, 1.0), (2, day(2), 7, 1.0), (3, day(5), 7, 1.0)])
    write(spark, src, "b2", [(4, day(1, 2), 7, 99.0), (5, day(9), 7, 1.0)])
    totals = []

    def sink(batch, batch_id):
        totals.extend((r.account_id, r.day.day, r.total) for r in batch.collect())
        bands(batch.select("account_id", "day", (F.col("total") / 2).alias("score")), batch_id)

    bands = conduct.BandSink(out, 0.3, 0.4)
    for run in ("b1", "b2"):
        stream = conduct.daily_conduct(conduct.read_events(spark, os.path.join(src, "b[12]") if run == "b2" else os.path.join(src, "b1")))
        conduct.run_batch(stream, sink, str(tmp_path / "checkpoint"))
    assert sorted(totals) == [(7, 1, 1.0), (7, 2, 1.0), (7, 5, 1.0)]
    alerts = spark.read.parquet(os.path.join(out, "alerts"))
    assert [(r.was, r.band) for r in alerts.collect()] == [(None, "red")]


def test_a_replayed_batch_ends_in_the_same_state(spark, tmp_path):
    sink = conduct.BandSink(str(tmp_path), 0.3, 0.6)
    for batch, score in ((0, 0.2), (1, 1.0), (1, 1.0)):
        sink(spark.createDataFrame([("a", dt.date(2024, 1, batch + 1), score)], "account_id string, day date, score double"), batch)
    got = spark.read.parquet(sink._path("state", 1)).first()
    assert (got.decision_score, got.band, len(got.recent)) == (0.6, "red", 2)


def test_published_batches_add_up_and_a_closed_gate_adds_nothing(spark, tmp_path):
    def gate(batch):
        return gates.verdict(batch.select(F.when(F.col("v") >= 0, "pass").otherwise("fail").alias("status")))

    publish = conduct.GatedPublisher(str(tmp_path), gate)
    assert publish.current(spark, str(tmp_path)) is None
    for batch_id, values in enumerate(([1], [-1], [2, 3], [])):
        publish(spark.createDataFrame([(v,) for v in values], "v int"), batch_id)
    publish(spark.createDataFrame([(2,), (3,)], "v int"), 2)  # the same batch again
    assert sorted(r.v for r in publish.current(spark, str(tmp_path)).collect()) == [1, 2, 3]


def test_a_batch_writes_its_own_accounts_and_a_restart_goes_on(spark, tmp_path):
    batches = [[("a", 1, 1.0), ("b", 1, 0.0), ("c", 1, 0.5)], [("a", 2, 0.0)], [("b", 2, 1.0)], [("a", 3, 0.5)]]
    for batch_id, rows in enumerate(batches):  # a new sink each time: nothing lives outside the folder
        sink = conduct.BandSink(str(tmp_path), 0.3, 0.6, compact=2)
        scores = spark.createDataFrame([(i, dt.date(2024, 1, d), s) for i, d, s in rows], "account_id string, day date, score double")
        for _ in range(1 + batch_id % 2):  # every other batch is run again
            sink(scores, batch_id)
        assert spark.read.parquet(sink._path("state", batch_id)).count() == len(rows)
    got = {r.account_id: (r.decision_score, r.band, len(r.recent), r.changed) for r in conduct.BandSink.current(spark, str(tmp_path)).collect()}
    assert got == {"a": (0.5, "amber", 3, 3), "b": (0.5, "amber", 2, 2), "c": (0.5, "amber", 1, 0)}
    assert conduct.BandSink._batches(spark, str(tmp_path), "base") == [1, 3]
    early = {r.account_id: r.decision_score for r in conduct.BandSink.current(spark, str(tmp_path), before=2).collect()}
    assert early == {"a": 0.5, "b": 0.0, "c": 0.5}
