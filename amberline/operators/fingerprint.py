"""Distribution fingerprint of a table and comparison of two fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.operators.quantiles import exact_quantiles

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def table_fingerprint(df: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...] = (),
                      quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Rows (column, stat, value): mean, sd, quantiles of numbers and shares of levels."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numeric])).alias("c")).select("c.*") \
        .where(F.col("value").isNotNull())
    moments = long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    moments = moments.unpivot("column", ["mean", "sd"], "stat", "value")
    points = exact_quantiles(long, "value", quantiles, ("column",)).select(
        "column", F.concat(F.lit("q"), F.col("prob").cast("string")).alias("stat"), "value")
    out = moments.unionByName(points)
    if categorical:
        levels = df.select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in categorical])).alias("c")).select("c.*")
        total = levels.groupBy("column").agg(F.count("level").alias("_n"))
        shares = levels.where(F.col("level").isNotNull()).groupBy("column", "level").agg(F.count("*").alias("n")).join(total, "column")
        out = out.unionByName(shares.select("column", F.concat(F.lit("share:"), "level").alias("stat"),
                                            (F.col("n") / F.col("_n")).alias("value")))
    return out


def compare_fingerprints(left: DataFrame, right: DataFrame, tolerance: float) -> DataFrame:
    """Statistics of both tables side by side; a missing one never matches."""
    joined = left.withColumnRenamed("value", "left").join(
        right.withColumnRenamed("value", "right"), ["column", "stat"], "full")
    gap = F.abs(F.col("left") - F.col("right"))
    limit = tolerance * F.greatest(F.abs("left"), F.lit(1.0))
    return joined.withColumn("passed", F.coalesce(gap <= limit, F.lit(False)))
