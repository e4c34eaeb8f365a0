"""The scored book as nested documents, and its timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.operators.book import timelines
from amberline.sources.panel import null_nan


def account_documents(book: DataFrame) -> DataFrame:
    """One nested document per account: scores, reasons and sources. No NaN or infinity survives."""
    clean = null_nan(book)
    return clean.select(
        "account_id", "portfolio", "band",
        F.struct(F.col("pd"), F.col("decision_score")).alias("scores"),
        F.struct("dpd", "sanctioned").alias("exposure"), "reasons",
        F.create_map(F.lit("identity"), F.col("identity_source"), F.lit("model"), F.col("model_source")).alias("provenance"))


def write_scored_book(book: DataFrame, path: str, fmt: str = "json") -> None:
    account_documents(book).write.mode("overwrite").format(fmt).save(path)


def write_timelines(panel: DataFrame, book: DataFrame, path: str, points: tuple[str, ...], fmt: str = "json") -> None:
    timelines(panel, book, points).write.mode("overwrite").format(fmt).save(path)
