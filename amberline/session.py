"""Session defaults and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the operators rely on: AQE picks broadcast sides by measured size,
# splits skewed join partitions and coalesces small shuffle partitions.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "amberline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    On a cluster this is the shared folder named in ``spark.checkpoint.dir``.
    Where that is unset (tests, a laptop) the session gets its own folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="amberline-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def spread(df: DataFrame, rows: int, *keys: str, most: int = 1_000_000) -> DataFrame:
    """``df`` dealt (by ``keys``) to tasks of about ``most`` of the ``rows`` it has or grows to.

    A table that the cores take at once with fewer rows each stays as it is. Spark's own
    numbers of partitions are fixed or go by bytes before rows multiply, so that a task's
    memory would grow with the input.
    """
    parts = -(-rows // most)
    return df.repartition(parts, *keys) if parts > df.sparkSession.sparkContext.defaultParallelism else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared work folder and read it back.

    Cuts the lineage before iterative work (model fits, calibrations), so a
    lost executor re-reads files rather than replaying the whole plan.
    """
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
