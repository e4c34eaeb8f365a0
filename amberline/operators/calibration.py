"""Calibration measures computed from score histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.functions.numeric import clip, clipped_logit
from amberline.operators.aggregates import with_interval
from amberline.operators.histogram import cumulative, stored_histogram
from amberline.operators.quantiles import edges_scalar, left_closed_bin, quantiles_of_ranked, right_closed_bin
from amberline.session import materialise


def _gap(bins: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    """Population-weighted |predicted - observed| over bins (n, bad, s)."""
    total = F.sum("n")
    return bins.groupBy(*groups).agg(F.coalesce(F.try_divide(
        F.sum(F.col("n") * F.abs(F.col("s") / F.col("n") - F.col("bad") / F.col("n"))), total), F.lit(0.0)).alias("ece"))


def ece_equal_width(hist: DataFrame, bins: int = 10, groups: tuple[str, ...] = ()) -> DataFrame:
    """Expected calibration error over equal-width, right-closed bins of [0, 1]."""
    edges = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    binned = hist.groupBy(*groups, right_closed_bin(F.col("score"), edges).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("score")).alias("s"))
    return _gap(binned, groups)


def equal_count_edges(hist: DataFrame, bins: int = 10) -> Column:
    """Distinct quantile edges of the scores in a histogram, as one array."""
    ranked = cumulative(hist).select("score", "n", F.col("n_below").alias("before"), F.col("n_all").alias("total"))
    return edges_scalar(quantiles_of_ranked(ranked, "score", tuple(i / bins for i in range(bins + 1))))


def equal_count_bins(hist: DataFrame, bins: int = 10) -> DataFrame:
    """Rows, failures and score sum per equal-count, left-closed bin (1-based)."""
    rows = hist.withColumn("_edges", equal_count_edges(hist, bins))
    return rows.groupBy((left_closed_bin(F.col("score"), F.col("_edges")) + 1).alias("bin")).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("score")).alias("s"))


def ece_equal_count(hist: DataFrame, bins: int = 10) -> DataFrame:
    return _gap(equal_count_bins(hist, bins))


def reliability_table(hist: DataFrame, bins: int = 10, informative_n: int = 30) -> DataFrame:
    """Predicted against observed per equal-count bin, with interval and a small-cell flag."""
    cells = equal_count_bins(hist, bins).select(
        "bin", "n", F.col("bad").alias("k"), (F.col("s") / F.col("n")).alias("predicted"))
    return with_interval(cells).withColumn("informative", F.col("n") >= informative_n)


def brier(hist: DataFrame, groups: tuple[str, ...] = ()) -> DataFrame:
    s = F.col("score")
    square = F.sum(F.col("n") * s * s - 2 * s * F.col("bad") + F.col("bad"))
    return hist.groupBy(*groups).agg(F.coalesce(F.try_divide(square, F.sum("n")), F.lit(0.0)).alias("brier"))


def apply_map(score: Column, boundaries: Column, predictions: Column) -> Column:
    """Piecewise-linear calibration map, clipped at both ends.

    ``boundaries`` and ``predictions`` are equally long ascending arrays.
    """
    upper = F.size(F.filter(boundaries, lambda b: b < score)) + 1
    i = F.least(F.greatest(upper, F.lit(2)), F.size(boundaries))
    x0, x1 = F.element_at(boundaries, i - 1), F.element_at(boundaries, i)
    y0, y1 = F.element_at(predictions, i - 1), F.element_at(predictions, i)
    inside = y0 + (y1 - y0) * (score - x0) / (x1 - x0)
    return (F.when(score <= F.element_at(boundaries, 1), F.element_at(predictions, 1))
            .when(score >= F.element_at(boundaries, -1), F.element_at(predictions, -1)).otherwise(inside))


def apply_map_table(scores: DataFrame, points: DataFrame, score: str = "score", name: str = "calibrated") -> DataFrame:
    """``scores`` with a piecewise-linear map of any number of points, clipped at both ends.

    ``points`` holds (boundary, prediction). Scores and points are range-partitioned
    together; a score takes the points at or below and at or above it in its part, else
    those of the nearest part that has any. NULL scores, and an empty map, give NULL.
    """
    parts = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = scores.withColumns({"_x": F.col(score).cast("double"), "_y": F.lit(None).cast("double"), "_own": F.lit(True)}).unionByName(
        points.select(F.col("boundary").alias("_x"), F.col("prediction").alias("_y"), F.lit(False).alias("_own")), allowMissingColumns=True)
    placed = materialise(both.repartitionByRange(parts, "_x").withColumn("_part", F.spark_partition_id()), "map-parts")
    point = F.when(F.col("_y").isNotNull(), F.struct("_x", "_y"))
    ends = placed.groupBy("_part").agg(F.max(point).alias("_top"), F.min(point).alias("_bottom"))
    by_part = W.partitionBy(F.lit(0)).orderBy("_part")  # a row a part
    ends = ends.select("_part", F.last("_top", True).over(by_part.rowsBetween(W.unboundedPreceding, -1)).alias("_before"),
                       F.first("_bottom", True).over(by_part.rowsBetween(1, W.unboundedFollowing)).alias("_after"))
    # the points above are those before in falling order: a frame that only grows
    order, falling = (W.partitionBy("_part").orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow) for o in (F.asc("_x"), F.desc("_x")))
    found = placed.withColumns({
        "_lo": F.last(point, True).over(order), "_hi": F.last(point, True).over(falling)}).where("_own").join(materialise(ends, "map-ends"), "_part", "left")
    lo, hi = F.coalesce("_lo", "_before"), F.coalesce("_hi", "_after")
    between = lo["_y"] + (hi["_y"] - lo["_y"]) * F.try_divide(F.col("_x") - lo["_x"], hi["_x"] - lo["_x"])
    value = F.when(F.col("_x").isNull(), None).when(lo.isNull(), hi["_y"]).when(hi.isNull(), lo["_y"]).otherwise(F.coalesce(between, lo["_y"]))
    return found.select(*scores.columns, value.alias(name))


def served_calibration(df: DataFrame, raw: str, calibrated: str, outcome: str = "went_bad") -> DataFrame:
    """Brier score and equal-count ECE of the raw and the calibrated score, one row each."""
    parts = []
    for name in (raw, calibrated):
        hist = stored_histogram(df, name, outcome)
        both = brier(hist).select(F.lit(name).alias("score"), "brier")
        parts.append(both.withColumn("ece", ece_equal_count(hist).select("ece").scalar()))
    return parts[0].unionByName(parts[1])


MIN_INFORMATIVE = 30  # fixed value: rows of a cell worth reading


def high_risk_cell(df: DataFrame, band: str = "red", reference: int | None = None, action: int = 8, informative: int = MIN_INFORMATIVE) -> DataFrame:
    """The band's own calibration point over all rows and at the reference period.

    The pooled row counts the label, the snapshot row those that reach NPA within the
    ``action`` window. Both rows are always there, with n = 0 and no prediction for an
    empty cell; a cell of fewer than ``informative`` rows is flagged.
    """
    at = F.col("period") == reference if reference is not None else F.lit(False)
    scopes = F.array(F.struct(F.lit("pooled").alias("scope"), F.lit(True).alias("holds"), F.col("went_bad").alias("bad")),
                     F.struct(F.lit("snapshot").alias("scope"), at.alias("holds"), F.col("to_npa").between(1, action).cast("int").alias("bad")))
    rows = df.where(F.col("band") == band).select("decision_score", F.explode(scopes).alias("s")).where("s.holds")
    found = rows.groupBy("s.scope").agg(F.count("*").alias("n"), F.sum("s.bad").alias("k"), F.avg("decision_score").alias("predicted"))
    both = df.sparkSession.createDataFrame([("pooled",), ("snapshot",)], "scope string").join(found, "scope", "left")
    both = both.withColumns({"n": F.coalesce("n", F.lit(0)), "k": F.coalesce("k", F.lit(0))})
    return with_interval(both).withColumn("informative", F.col("n") >= informative)


def cox_calibration(df: DataFrame, score: str = "decision_score", outcome: str = "went_bad",
                    cluster: str = "account_id", steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """Logistic recalibration outcome ~ a + b * logit(score), intervals clustered by account.

    Newton steps run on the score histogram (written once), so each step is one
    small aggregate; the driver sees five numbers per step. The cluster term
    sums residuals per account on the rows. One row; NULLs when it cannot be fitted.
    """
    hist = stored_histogram(df, score, outcome)
    x = clipped_logit(F.col("score"))
    a = b = 0.0
    inverse = None
    for _ in range(steps):
        mu = 1.0 / (1.0 + F.exp(-(F.lit(a) + F.lit(b) * x)))
        w = F.greatest(mu * (1.0 - mu), F.lit(1e-10)) * F.col("n")
        r = F.col("bad") - F.col("n") * mu
        s = hist.agg(F.sum(w), F.sum(w * x), F.sum(w * x * x), F.sum(r), F.sum(r * x)).first()
        if s[0] is None:
            break
        det = s[0] * s[2] - s[1] * s[1]
        if abs(det) < 1e-12:
            inverse = None
            break
        inverse = (s[2] / det, -s[1] / det, s[0] / det)
        da, db = inverse[0] * s[3] + inverse[1] * s[4], inverse[1] * s[3] + inverse[2] * s[4]
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < tolerance or not math.isfinite(a + b):
            break
    spark = df.sparkSession
    schema = ("slope double, slope_lo double, slope_hi double, intercept double, intercept_lo double, "
              "intercept_hi double, n_clusters bigint, reading string")
    if inverse is None or not math.isfinite(a + b):
        return spark.createDataFrame([(None,) * 8], schema)
    xs = clipped_logit(clip(F.round(score, 6), 0.0, 1.0))
    residual = F.col(outcome) - 1.0 / (1.0 + F.exp(-(F.lit(a) + F.lit(b) * xs)))
    per = df.where(F.col(score).isNotNull()).groupBy(cluster).agg(
        F.sum(residual).alias("u"), F.sum(residual * xs).alias("v"))
    m = per.agg(F.sum(F.col("u") * F.col("u")), F.sum(F.col("u") * F.col("v")), F.sum(F.col("v") * F.col("v")), F.count("*")).first()
    p, q, r_ = inverse
    var_a = p * p * m[0] + 2 * p * q * m[1] + q * q * m[2]
    var_b = q * q * m[0] + 2 * q * r_ * m[1] + r_ * r_ * m[2]
    se_a, se_b = math.sqrt(max(var_a, 0.0)), math.sqrt(max(var_b, 0.0))
    lo, hi = b - 1.96 * se_b, b + 1.96 * se_b
    reading = "spread too wide" if hi < 1 else "spread too narrow" if lo > 1 else "slope 1 not excluded"
    return spark.createDataFrame([(b, lo, hi, a, a - 1.96 * se_a, a + 1.96 * se_a, m[3], reading)], schema)
