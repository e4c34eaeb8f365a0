"""Streaming queries: each drains the event files through a real stream, then reads the sink."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from amberline.operators import gates, quality
from amberline.plans.registry import Tables, query
from amberline.session import work_dir
from amberline.streaming import conduct


def _events(t: Tables):
    return conduct.read_events(t.spark, os.path.join(t.sf_dir, "events*.parquet"))


def _folder(t: Tables, name: str) -> str:
    return os.path.join(work_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


@query("ss01_incremental_ingest", "SELECT event_id, user_id, event_type, value, dayofmonth(ts)::INT AS day FROM events")
def incremental_ingest(t: Tables):
    """Two runs over the same files: the second finds nothing new."""
    target, checkpoint = _folder(t, "ingest"), _folder(t, "ingest-checkpoint")
    for _ in range(2):
        conduct.ingest(_events(t), target, checkpoint).awaitTermination()
    return t.spark.read.parquet(target).select("event_id", "user_id", "event_type", "value", F.dayofmonth("day").alias("day"))


@query("ss02_without_reposts", "SELECT event_id, user_id, value FROM events")
def without_reposts(t: Tables):
    """Every tenth event arrives twice."""
    events = _events(t)
    twice = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    posted = events.withColumn("copy", F.explode(twice))
    target = _folder(t, "unique")
    unique = conduct.without_reposts(posted).select("event_id", "user_id", "value")
    (unique.writeStream.format("parquet").option("path", target).option("checkpointLocation", _folder(t, "unique-checkpoint"))
     .trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(target)


CLOSED_SQL = """dd AS (SELECT user_id AS account_id, date_trunc('day', ts)::DATE AS day, count(*) AS n, sum(value) AS total, max(value) AS largest FROM events GROUP BY 1, 2),
closed AS (SELECT * FROM dd WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 DAY FROM events))"""


@query("ss03_daily_conduct", f"WITH {CLOSED_SQL} SELECT account_id, day, n, round(total, 2) AS total, largest FROM closed")
def daily_conduct(t: Tables):
    """Days the watermark has passed; later ones stay open in the state."""
    target = _folder(t, "daily")
    (conduct.daily_conduct(_events(t)).writeStream.format("parquet").option("path", target)
     .option("checkpointLocation", _folder(t, "daily-checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination())
    return t.spark.read.parquet(target).withColumn("total", F.round("total", 2))


def _day_scores(t: Tables):
    return conduct.daily_conduct(_events(t)).select("account_id", "day", (F.col("n") / (F.col("n") + 4.0)).alias("score"))


@query("ss04_running_bands", f"""
WITH {CLOSED_SQL}, r AS (SELECT account_id, n / (n + 4.0::DOUBLE) AS s, row_number() OVER (PARTITION BY account_id ORDER BY day DESC) AS rn FROM closed),
b AS (SELECT account_id, round(avg(s), 6) AS decision_score, count(*)::INT AS points FROM r WHERE rn <= 4 GROUP BY 1)
SELECT *, CASE WHEN decision_score >= 0.4 THEN 'red' WHEN decision_score >= 0.3 THEN 'amber' ELSE 'green' END AS band FROM b""")
def running_bands(t: Tables):
    folder = _folder(t, "bands")
    conduct.run_batch(_day_scores(t), conduct.BandSink(folder, 0.3, 0.4), _folder(t, "bands-checkpoint"))
    return conduct.BandSink.current(t.spark, folder).select("account_id", "decision_score", F.size("recent").alias("points"), "band")


FILES = 8  # files of one arrival


@query("ss05_gated_publish", f"WITH {CLOSED_SQL} SELECT account_id, day, n FROM closed")
def gated_publish(t: Tables):
    """Days become visible batch by batch as their checks pass; a batch is what arrived in one stretch of time, in several files."""
    def gate(batch):
        rules = {"negative_total": F.col("total") < 0, "no_account": F.col("account_id").isNull()}
        checks = quality.count_violations(batch, rules).withColumn("status", F.when(F.col("violations") == 0, "pass").otherwise("fail"))
        return gates.verdict(checks)

    folder = _folder(t, "publish")
    parts = _folder(t, "event-files")
    # written one after the other by time, as they would arrive, so that no event is late
    at = F.unix_timestamp("ts")
    low, high = t.read("events").agg(F.min(at), F.max(at)).first()
    step = ((high or 0) - (low or 0)) // 4 + 1
    for part in range(4):
        t.read("events").where(F.floor((at - low) / step) == part).repartition(FILES).write.parquet(os.path.join(parts, f"arrived-{part}"))
    events = conduct.read_events(t.spark, os.path.join(parts, "*"), files_per_batch=FILES)
    conduct.run_batch(conduct.daily_conduct(events), conduct.GatedPublisher(folder, gate), _folder(t, "publish-checkpoint"))
    return conduct.GatedPublisher.current(t.spark, folder).select("account_id", "day", "n")
