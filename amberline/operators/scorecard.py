"""One-line summaries of a scored panel, and comparison of several panels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.operators.aggregates import honest_metrics, with_interval
from amberline.operators.calibration import brier
from amberline.operators.histogram import rank_metrics
from amberline.operators.ranking import recall_at_budgets
from amberline.operators.thresholds import cost_histogram, evaluate, priced


def snapshot_scorecard(book: DataFrame, amber: float, red: float) -> DataFrame:
    """Ranking, calibration, precision, misses and cost of one banded book, from one histogram."""
    hist = cost_histogram(book)
    pooled = hist.groupBy("score").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    pair = evaluate(priced(hist), amber, red)
    return pair.select(
        "n", rank_metrics(pooled).select("auc").scalar().alias("auc"), brier(pooled).select("brier").scalar().alias("brier"),
        "red_precision", "missed_share", "flagged_share", "cost_per_account")


def honest_block(book: DataFrame, horizon: int, long_horizon: int, keys: tuple[str, ...], budget: float = 0.10) -> DataFrame:
    """The headline precision, what must be read beside it, and the recall of a review budget."""
    outcome = F.col("to_npa").between(1, horizon).cast("int")
    recall = recall_at_budgets(book.withColumn("_bad", outcome), (budget,), keys, book_grain=True, outcome="_bad")
    counts = honest_metrics(book, horizon, long_horizon).select("metric", "k", "n").unionByName(
        recall.select(F.lit("recall_at_budget").alias("metric"), F.col("n_caught").alias("k"), F.col("n_bad").alias("n")))
    return with_interval(counts)


def regime_delta(results: DataFrame, metric: str, controls: tuple[str, ...]) -> DataFrame:
    """Each regime against the middle and the range of the control runs."""
    control = results.where(F.col("regime").isin(*controls))
    span = control.agg(F.struct(F.min(metric).alias("lo"), F.max(metric).alias("hi"))).scalar()
    rows = results.where(~F.col("regime").isin(*controls)).withColumn("_c", span)
    value = F.col(metric)
    return rows.select("regime", (value - (F.col("_c.lo") + F.col("_c.hi")) / 2).alias("delta"),
                       ((value < F.col("_c.lo")) | (value > F.col("_c.hi"))).alias("outside"))
