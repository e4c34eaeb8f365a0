"""Banding expressions. A NULL input always bands to NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: band edges and labels ---
VINTAGE_BAND = ((6, 12, 18, 30, 48), ("0-6", "7-12", "13-18", "19-30", "31-48", "49+"))
VINTAGE_CUT = ((12, 18, 30, 48), ("[0,12)", "[12,18)", "[18,30)", "[30,48)", "[48,inf)"))
SEGMENT = ((1e6, 1e7), ("Micro", "Small", "Medium"))
TICKET_BAND = ((1e6, 5e6, 2e7), ("lt10L", "10Lto50L", "50Lto2Cr", "gt2Cr"))
DPD_BAND = ((0, 30, 60, 90), ("0", "1-30", "31-60", "61-90", "90+"))
ELAPSED_BANDS = {"months_since_moratorium_end": ((-1, 6), ("in moratorium", "0-6", "7+"))}


def right_closed(value: Column, edges: tuple, labels: tuple) -> Column:
    """Band whose upper edges are inclusive: value <= edge."""
    band = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        band = band.when(value <= edge, F.lit(label))
    return band.otherwise(F.lit(labels[-1]))


def left_closed(value: Column, edges: tuple, labels: tuple) -> Column:
    """Band whose upper edges are exclusive: value < edge."""
    band = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        band = band.when(value < edge, F.lit(label))
    return band.otherwise(F.lit(labels[-1]))


def vintage_band(months: Column) -> Column:
    return right_closed(months, *VINTAGE_BAND)


def vintage_cut(months: Column) -> Column:
    """The validation cut: left-closed, NULL below zero."""
    return F.when(months >= 0, left_closed(months, *VINTAGE_CUT))


def segment(sanctioned: Column) -> Column:
    return right_closed(sanctioned, *SEGMENT)


def ticket_band(sanctioned: Column) -> Column:
    return left_closed(sanctioned, *TICKET_BAND)


def dpd_band(dpd: Column) -> Column:
    return right_closed(dpd, *DPD_BAND)


def elapsed_time_bands(df: DataFrame) -> DataFrame:
    """Add ``<col>_band`` for each registered counter that is present and unbanded."""
    for col, (edges, labels) in ELAPSED_BANDS.items():
        if col in df.columns and f"{col}_band" not in df.columns:
            df = df.withColumn(f"{col}_band", right_closed(F.col(col), edges, labels))
    return df


def rag_band(score: Column, amber: Column | float, red: Column | float) -> Column:
    """Red/amber/green with inclusive lower bounds."""
    amber = amber if isinstance(amber, Column) else F.lit(amber)
    red = red if isinstance(red, Column) else F.lit(red)
    known = score.isNotNull() & amber.isNotNull() & red.isNotNull()
    return F.when(known & (score >= red), "red").when(known & (score >= amber), "amber").when(known, "green")


def decision_column(df: DataFrame) -> Column:
    """The score a band may be derived from, best source first."""
    present = [F.col(c) for c in ("decision_score", "pd_smooth", "pd") if c in df.columns]
    return F.coalesce(*present)
