"""Blanking cells a lender cannot observe. Absent is NULL, never zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.config import CHANNEL_COLUMNS, STATEMENT_COLUMNS


def _blank(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """NULL each column where its rule is TRUE."""
    return df.withColumns({c: F.when(~F.coalesce(rule, F.lit(False)), F.col(c)) for c, rule in rules.items()})


def mask_by_portfolio(df: DataFrame, absent: dict[str, tuple[str, ...]]) -> DataFrame:
    """NULL every column of a channel in the portfolios listed as lacking it.

    ``absent`` maps a portfolio to the channels it does not carry.
    """
    lacking: dict[str, list[str]] = {}
    for portfolio, channels in absent.items():
        for channel in channels:
            for column in CHANNEL_COLUMNS[channel]:
                lacking.setdefault(column, []).append(portfolio)
    return _blank(df, {c: F.col("portfolio").isin(p) for c, p in lacking.items() if c in df.columns})


def mask_by_borrower(df: DataFrame, without_gst=("Individual",), salaried: str = "Salaried") -> DataFrame:
    """No GST returns from individuals, no salary credits for the self-employed."""
    rules = {c: F.col("constitution").isin(*without_gst) for c in CHANNEL_COLUMNS["gst"]}
    rules |= {c: F.col("sector") != salaried for c in CHANNEL_COLUMNS["salary"]}
    return _blank(df, {c: rule for c, rule in rules.items() if c in df.columns})


def mask_statement_gaps(df: DataFrame, gaps: DataFrame) -> DataFrame:
    """NULL the statement-fed columns in the periods a gap covers.

    ``gaps`` has (account_id, start, length). Gaps are spread over their periods
    first, which turns the interval test into an equality join.
    """
    covered = gaps.select("account_id", F.explode(
        F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("period")).distinct()
    marked = df.join(covered.withColumn("_gap", F.lit(True)), ["account_id", "period"], "left")
    return _blank(marked, {c: F.col("_gap") for c in STATEMENT_COLUMNS if c in df.columns}).drop("_gap")
