"""Outcome labels and the row filters that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.config import LABEL_HORIZON_MONTHS, NPA_DPD, SMA2_DPD, SMA2_HORIZON_MONTHS
from amberline.operators.windows import by_account, by_period


def with_first_npa(df: DataFrame, npa_dpd: float = NPA_DPD) -> DataFrame:
    """Add ``npa_period``: the first period at or past the NPA threshold."""
    return df.withColumn("npa_period", F.min(F.when(F.col("dpd") >= npa_dpd, F.col("period"))).over(by_account()))


def to_npa(npa_period: Column, period: Column) -> Column:
    """Periods until NPA; -1 for accounts that never get there."""
    return F.coalesce(npa_period - period, F.lit(-1))


def bad_within(to_npa_: Column, horizon: int = LABEL_HORIZON_MONTHS) -> Column:
    return F.when(to_npa_.between(1, horizon), 1).otherwise(0)


def sma2_within(horizon: int = SMA2_HORIZON_MONTHS, threshold: float = SMA2_DPD) -> Column:
    """1 when DPD reaches the SMA-2 threshold in the next ``horizon`` rows.

    Must be computed before post-NPA rows are dropped: it looks through them.
    """
    ahead = F.max("dpd").over(by_period().rowsBetween(1, horizon))
    return F.when(ahead >= threshold, 1).otherwise(0)


def with_labelable(df: DataFrame, horizon: int = LABEL_HORIZON_MONTHS) -> DataFrame:
    """1 where the whole forward window lies inside the panel."""
    last = df.agg(F.max("period")).scalar()
    return df.withColumn("labelable", (F.col("period") <= last - horizon).cast("int"))


def shift_recognition(npa_period: Column, lag: Column, periods: int) -> Column:
    """NPA period moved by a recognition lag; past the window means never (-1)."""
    moved = npa_period + F.coalesce(lag, F.lit(0))
    return F.when((npa_period >= 0) & (moved < periods), moved).otherwise(F.lit(-1))


def standard_rows(df: DataFrame, npa_dpd: float = NPA_DPD) -> DataFrame:
    before = F.col("npa_period").isNull() | (F.col("period") < F.col("npa_period"))
    return df.where(before & (F.col("dpd") < npa_dpd))


def eligible_rows(df: DataFrame) -> DataFrame:
    """Rows with a complete forward window; every row when the panel has no such column."""
    if "labelable" not in df.columns:
        return df
    return df.where(F.coalesce(F.col("labelable"), F.lit(0)) == 1)


def snapshot(df: DataFrame, reference: int) -> DataFrame:
    """Rows of the reference period, or of the latest eligible one when it is absent."""
    eligible = eligible_rows(df)
    # max(..) of the periods up to the reference; a scalar subquery, run once
    chosen = eligible.agg(F.coalesce(
        F.max(F.when(F.col("period") == reference, F.col("period"))), F.max("period"))).scalar()
    return df.where(F.col("period") == chosen)


def lead_bucket(df: DataFrame, lo: int, hi: int) -> DataFrame:
    return df.where((F.col("went_bad") == 1) & F.col("to_npa").between(lo, hi))
