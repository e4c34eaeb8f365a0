"""Hazard by months on book, slippage and sensitivity to the NPA rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vintage_hazard(accounts: DataFrame, periods: int) -> DataFrame:
    """Events and exposure by age, from one row per account.

    Needs ``vintage_0`` and ``npa_period`` (-1 or NULL for never). Each account
    adds +1 at its first age and -1 after its last; the running sum over ages
    is the exposure. The window runs over ages, of which there are a few hundred.
    """
    last_age = F.col("vintage_0") + periods - 1
    npa_age = F.when(F.col("npa_period") >= 0, F.col("vintage_0") + F.col("npa_period"))
    inside = npa_age.isNotNull() & (npa_age <= last_age)
    end = F.when(inside, npa_age).otherwise(last_age)
    steps = F.array(
        F.struct(F.col("vintage_0").alias("age"), F.lit(1).alias("step"), F.lit(0).alias("event")),
        F.struct((end + 1).alias("age"), F.lit(-1).alias("step"), F.lit(0).alias("event")),
        F.struct(end.alias("age"), F.lit(0).alias("step"), inside.cast("int").alias("event")))
    per_age = accounts.select(F.explode(steps).alias("s")).groupBy("s.age").agg(
        F.sum("s.step").alias("step"), F.sum("s.event").alias("events"))
    exposure = F.sum("step").over(W.partitionBy(F.lit(0)).orderBy("age"))
    return per_age.withColumn("exposure", exposure).where(F.col("exposure") > 0).select(
        "age", "events", "exposure", (F.col("events") / F.col("exposure")).alias("hazard"))


def hazard_hump(hazard: DataFrame, young=(0, 12), hump=(18, 30), old=(90, 120), fallback=(60, 90),
                min_exposure: int = 500) -> DataFrame:
    """Exposure-weighted hazard in three windows and whether the middle one stands out."""
    def exposed(w):
        return F.coalesce(F.sum(F.when(F.col("age").between(*w), F.col("exposure"))), F.lit(0))

    def mean(w):
        return F.try_divide(F.sum(F.when(F.col("age").between(*w), F.col("events"))), exposed(w))

    use_old = exposed(old) >= min_exposure
    cells = hazard.agg(
        mean(young).alias("young"), mean(hump).alias("hump"),
        F.when(use_old, mean(old)).otherwise(mean(fallback)).alias("old"))
    stands_out = (F.col("hump") > 1.3 * F.col("young")) & (F.col("hump") > 1.15 * F.col("old"))
    return cells.withColumn("passed", F.coalesce(stands_out, F.lit(False)))


def slippage_ratio(accounts: DataFrame, periods: int, horizon: int = 12) -> DataFrame:
    """Mean over disjoint windows of fresh NPA / standard accounts at the window's start."""
    npa = F.when(F.col("npa_period") >= 0, F.col("npa_period"))
    starts = [s for s in range(0, periods, horizon) if s + horizon <= periods]
    counts = accounts.agg(*[
        F.struct(
            F.count(F.when(npa.isNull() | (npa >= s), 1)).alias("standard"),
            F.count(F.when(npa.between(s, s + horizon - 1), 1)).alias("fresh")).alias(f"w{s}") for s in starts])
    windows = F.filter(F.array(*[F.col(f"w{s}") for s in starts]), lambda w: w["standard"] > 0)
    ratios = F.transform(windows, lambda w: w["fresh"] / w["standard"])
    total = F.aggregate(ratios, F.lit(0.0), lambda a, x: a + x)
    return counts.select(F.size(windows).alias("windows"), F.try_divide(total, F.size(windows)).alias("slippage_ratio"))


def rates_by_rule(df: DataFrame, rule: str) -> DataFrame:
    """Label rate and median distance to NPA per portfolio, tagged with the rule's name."""
    return df.groupBy("portfolio").agg(
        F.lit(rule).alias("rule"), F.count("*").alias("n"), F.avg("went_bad").alias("rate"),
        F.median(F.when(F.col("to_npa") > 0, F.col("to_npa"))).alias("median_to_npa"))
