"""The score histogram: sufficient statistics for ranking and calibration.

Scores lie in [0, 1] and are kept to six decimals, so a histogram has at most
1,000,001 rows per group whatever the number of accounts. The panel is read
once and combined map-side; everything downstream works on the histogram.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.config import SCORE_DECIMALS
from amberline.session import materialise


def score_histogram(df: DataFrame, score: str = "decision_score", outcome: str = "went_bad",
                    groups: tuple[str, ...] = (), weight: Column | None = None, **sums: Column) -> DataFrame:
    """Rows, failures and any extra sums per (group, score)."""
    w = F.lit(1) if weight is None else weight
    rows = df.where(F.col(score).isNotNull())
    return rows.groupBy(*groups, F.round(score, SCORE_DECIMALS).alias("score")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col(outcome)).alias("bad"),
        *[F.sum(c).alias(name) for name, c in sums.items()])


def stored_histogram(df: DataFrame, *args, **kw) -> DataFrame:
    """:func:`score_histogram` written to the work folder, for measures that need several passes."""
    return materialise(score_histogram(df, *args, **kw), "histogram")


def cumulative(hist: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Add rows and failures below each score, and the group totals."""
    keys = [F.col(g) for g in groups] or [F.lit(0)]
    below, whole = W.partitionBy(*keys).orderBy("score"), W.partitionBy(*keys)
    return hist.withColumns({
        "n_below": F.sum("n").over(below) - F.col("n"), "bad_below": F.sum("bad").over(below) - F.col("bad"),
        "n_all": F.sum("n").over(whole), "bad_all": F.sum("bad").over(whole)})


def rank_metrics(hist: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """AUC (ties averaged), KS and average precision per group; NULL for a single class."""
    c = cumulative(hist, groups)
    good, good_below = F.col("n") - F.col("bad"), F.col("n_below") - F.col("bad_below")
    good_all = F.col("n_all") - F.col("bad_all")
    n_up, bad_up = F.col("n_all") - F.col("n_below"), F.col("bad_all") - F.col("bad_below")
    pairs = F.col("bad").cast("double") * (good_below + good / 2)
    gap = F.try_divide(bad_up, F.col("bad_all")) - F.try_divide(n_up - bad_up, good_all)
    out = c.groupBy(*groups).agg(
        F.max("n_all").alias("n"), F.max("bad_all").alias("n_bad"), F.max(good_all).alias("_good"),
        F.sum(pairs).alias("_pairs"), F.max(gap).alias("_gap"),
        F.sum(F.col("bad") * F.try_divide(bad_up, n_up)).alias("_precision"))
    two = (F.col("n_bad") > 0) & (F.col("_good") > 0)
    return out.select(
        *groups, "n", "n_bad",
        F.when(two, F.col("_pairs") / (F.col("n_bad").cast("double") * F.col("_good"))).alias("auc"),
        F.when(two, F.greatest(F.col("_gap"), F.lit(0.0))).alias("ks"),
        F.try_divide("_precision", "n_bad").alias("average_precision"))


def two_grains(df: DataFrame, by: str = "portfolio", pooled: str = "__pooled__") -> DataFrame:
    """Each row once under its group and once under the pooled label."""
    return df.withColumn(by, F.explode(F.array(F.lit(pooled), F.col(by))))
