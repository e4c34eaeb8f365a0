"""Conduct events as a stream: ingest, dedupe, daily aggregates, running bands, gated publishing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from amberline.functions.bands import rag_band

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
LAST_SCORES = 4


def read_events(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """File stream of conduct events. ``path`` is a folder or glob of Parquet files."""
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def ingest(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what is new since the last run and stop; the file sink commits each batch once."""
    return (events.withColumn("day", F.to_date("ts")).writeStream.format("parquet").partitionBy("day")
            .option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def without_reposts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Drop events posted again; ids are remembered for the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_conduct(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Per-account daily totals; a day is final once the watermark has passed it.

    The state holds one row per account and open day. Values are combined
    before the shuffle, so a busy account is a few partial rows per batch.
    """
    return (events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), F.col("user_id").alias("account_id"))
            .agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("largest"))
            .select("account_id", F.to_date("window.start").alias("day"), "n", "total", "largest"))


def update_bands(state: DataFrame | None, day_scores: DataFrame, amber: float, red: float) -> tuple[DataFrame, DataFrame]:
    """One batch of the running band: the new state and the accounts whose band changed.

    ``day_scores`` has (account_id, day, score), at most one row per account and
    day; the state keeps an account's last four of them.
    """
    new = day_scores.groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct("day", "score"))).alias("fresh"))
    if state is None:
        merged = new.select("account_id", F.col("fresh").alias("points"), F.lit(None).cast("string").alias("was"))
    else:
        merged = state.join(new, "account_id", "full").select(
            "account_id", F.array_sort(F.concat(F.coalesce("recent", F.array().cast(_POINTS)), F.coalesce("fresh", F.array().cast(_POINTS)))).alias("points"),
            F.col("band").alias("was"))
    points = F.slice("points", F.greatest(F.size("points") - LAST_SCORES + 1, F.lit(1)), LAST_SCORES)
    rows = merged.withColumn("recent", points)
    mean = F.aggregate("recent", F.lit(0.0), lambda a, p: a + p["score"]) / F.size("recent")
    rows = rows.withColumn("decision_score", F.round(mean, 6))
    rows = rows.withColumn("band", rag_band(F.col("decision_score"), amber, red))
    alerts = rows.where(~F.col("band").eqNullSafe(F.col("was"))).select("account_id", "was", "band", "decision_score")
    return rows.select("account_id", "recent", "decision_score", "band"), alerts


_POINTS = "array<struct<day:date,score:double>>"


class BandSink:
    """``foreachBatch`` target that keeps the running bands as a log of changes.

    A batch writes the accounts it saw, a row each, under its batch id, and reads what
    was known of those accounts only. Every ``compact`` batches the log is folded into
    one table, so a read looks at that table and the few changes after it. A batch that
    is run again after a failure starts from the changes before it and ends the same.
    """

    def __init__(self, folder: str, amber: float, red: float, compact: int = 20):
        self.folder, self.amber, self.red, self.compact = folder, amber, red, compact

    def _path(self, kind: str, batch: int) -> str:
        return os.path.join(self.folder, kind, f"batch={batch:012d}")

    @staticmethod
    def _batches(spark: SparkSession, folder: str, kind: str) -> list[int]:
        path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(folder, kind))
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        done = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName().split("=")[1]) for s in files.listStatus(path) if done(s.getPath())) if files.exists(path) else []

    @classmethod
    def current(cls, spark: SparkSession, folder: str, before: int | None = None, accounts: DataFrame | None = None) -> DataFrame | None:
        """The state after all batches, or after those ``before`` one; of some ``accounts`` only. None where there is none."""
        known = lambda kind: [b for b in cls._batches(spark, folder, kind) if before is None or b < before]
        base = known("base")[-1:]
        paths = [os.path.join(folder, "base", f"batch={b:012d}") for b in base]
        paths += [os.path.join(folder, "state", f"batch={b:012d}") for b in known("state") if not base or b > base[0]]
        if not paths:
            return None
        rows = spark.read.parquet(*paths)
        if accounts is not None:
            rows = rows.join(accounts.select("account_id").distinct(), "account_id", "left_semi")
        last = F.max_by(F.struct("recent", "decision_score", "band"), "changed").alias("s")
        return rows.groupBy("account_id").agg(last, F.max("changed").alias("changed")).select("account_id", "s.*", "changed")

    def __call__(self, day_scores: DataFrame, batch_id: int) -> None:
        spark = day_scores.sparkSession
        previous = self.current(spark, self.folder, batch_id, day_scores)
        state, alerts = update_bands(previous.drop("changed") if previous is not None else None, day_scores, self.amber, self.red)
        state.withColumn("changed", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(self._path("state", batch_id))
        alerts.write.mode("overwrite").parquet(self._path("alerts", batch_id))
        if (batch_id + 1) % self.compact == 0:
            self.current(spark, self.folder, batch_id + 1).write.mode("overwrite").parquet(self._path("base", batch_id))


class GatedPublisher:
    """``foreachBatch`` target that publishes a batch only when its gate passes.

    The batch is written next to the published ones and only then named in the
    pointer table. What is published is every named batch together: batches of
    closed days add to each other. A failing or broken gate and a batch without rows
    leave the pointers as they were; a batch that runs again replaces its own.
    """

    def __init__(self, folder: str, gate: Callable[[DataFrame], DataFrame]):
        self.folder, self.gate = folder, gate

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"batch={batch_id:012d}"
        staged = os.path.join(self.folder, "versions", name)
        batch.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(batch.schema).parquet(staged)
        if rows.isEmpty():
            return
        verdict = self.gate(rows).first()
        if verdict is None or verdict[0] != "PASS":
            return
        pointer = spark.range(1).select(F.lit(batch_id).cast("bigint").alias("batch_id"), F.lit(staged).alias("path"))
        pointer.write.mode("overwrite").parquet(os.path.join(self.folder, "published", name))

    @staticmethod
    def current(spark: SparkSession, folder: str) -> DataFrame | None:
        """All published batches, or None before the first one."""
        root = os.path.join(folder, "published")
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        pointers = spark.read.option("recursiveFileLookup", True).schema("batch_id bigint, path string").parquet(root)
        # one name a published batch: the driver lists their folders anyway when it plans the read
        return spark.read.parquet(*[r.path for r in pointers.collect()])


def run_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process everything available through a ``foreachBatch`` sink and stop."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


__all__ = ["BandSink", "GatedPublisher", "daily_conduct", "ingest", "read_events", "run_batch", "update_bands", "without_reposts"]
