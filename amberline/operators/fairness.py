"""Flag rates and hit rates by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.operators.aggregates import stack_levels, with_interval


def group_table(df: DataFrame, flagged: Column, attributes: dict[str, Column], outcome: str = "went_bad",
                min_n: int = 500) -> DataFrame:
    """Flag rate and hit rate per (attribute, level), one scan for all attributes.

    Groups under ``min_n`` rows stay listed but are marked as not compared.
    """
    long = stack_levels(df.withColumn("_flag", flagged.cast("int")), attributes, "_flag", outcome)
    cells = long.where(F.col("level").isNotNull()).groupBy("cut", "level").agg(
        F.count("*").alias("n"), F.sum("_flag").alias("k"), F.sum(outcome).alias("n_pos"),
        F.sum(F.col("_flag") * F.col(outcome)).alias("k_pos"))
    out = with_interval(with_interval(cells, prefix="flag_"), "k_pos", "n_pos", "tpr_")
    return out.withColumn("tpr_rate", F.when(F.col("n_pos") > 0, F.col("tpr_rate"))).withColumn(
        "compared", F.col("n") >= min_n)


def adverse_impact_ratio(table: DataFrame) -> DataFrame:
    """Least over most flagged group, per attribute with at least two compared groups."""
    return table.where("compared").groupBy("cut").agg(
        F.when(F.count("*") >= 2, F.try_divide(F.min("flag_rate"), F.max("flag_rate"))).alias("ratio"), F.sum("n").alias("n"))


def tpr_gap(table: DataFrame) -> DataFrame:
    """Largest minus smallest hit rate among failures, per attribute."""
    return table.where(F.col("compared") & F.col("tpr_rate").isNotNull()).groupBy("cut").agg(
        F.when(F.count("*") >= 2, F.max("tpr_rate") - F.min("tpr_rate")).alias("gap"), F.sum("n_pos").alias("n"))
