"""Pre-registered acceptance bands: criteria joined to results and graded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.config import STATUS_RANK


def check(op: Column, value: Column, lo: Column, hi: Column, series: Column) -> Column:
    """TRUE/FALSE of a band, NULL where nothing is compared.

    ``lo`` is the threshold of one-sided operators; ``series`` is the array a
    ``monotone_increasing`` criterion looks at.
    """
    rising = F.forall(F.sequence(F.lit(2), F.size(series)), lambda i: F.element_at(series, (i - 1).cast("int")) < F.element_at(series, i.cast("int")))
    rising = F.when(F.size(series) < 2, F.lit(True)).otherwise(rising)
    return (F.when(op == "report", F.lit(None).cast("boolean")).when(op == "monotone_increasing", rising)
            .when(op == "exists", F.when(value.isNotNull(), value != 0))
            .when(op == "ge", value >= lo).when(op == "le", value <= lo).when(op == "gt", value > lo).when(op == "lt", value < lo)
            .when(op == "eq", value == lo).when(op == "ne", value != lo).when(op == "between", value.between(lo, hi)))


def criteria_with_results(criteria: DataFrame, results: DataFrame) -> DataFrame:
    """Full join: a criterion without a result is pending, a result without a criterion is an error."""
    c = criteria.withColumn("_c", F.lit(1))
    r = results.withColumn("_r", F.lit(1))
    joined = c.join(r, "criterion_id", "full")
    preset = F.when(F.col("_c").isNull(), "error").when(F.col("_r").isNull(), "pending")
    return joined.withColumn("preset", preset).drop("_c", "_r")


def grade_cells(joined: DataFrame) -> DataFrame:
    """Status of every cell: too few rows first, then the band, then the severity."""
    passed = check(F.col("op"), F.col("value"), F.col("lo"), F.col("hi"), F.col("series"))
    thin = F.col("n").isNotNull() & (F.coalesce(F.col("min_n"), F.lit(0)) > 0) & (F.col("n") < F.col("min_n"))
    status = (F.when(F.col("preset").isNotNull(), F.col("preset")).when(thin, "skipped_low_n").when(passed.isNull(), "report")
              .when(F.col("severity") == "report", "report").when(passed, "pass").otherwise(F.col("severity")))
    return joined.withColumn("status", status)


def severity(status: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STATUS_RANK]), status) - 1


def worst_of(cells: DataFrame) -> DataFrame:
    """Worst status per criterion and the first cell that has it (none when all pass)."""
    order = F.struct(severity(F.col("status")).alias("s"), (-F.coalesce(F.col("cell"), F.lit(0))).alias("c"))
    worst = cells.groupBy("criterion_id").agg(F.max_by(F.struct("status", "level", "value", "n"), order).alias("w"))
    binding = F.col("w.status") != "pass"
    return worst.select("criterion_id", "w.status", F.when(binding, F.col("w.level")).alias("level"),
                        F.when(binding, F.col("w.value")).alias("value"), F.when(binding, F.col("w.n")).alias("n"))


def verdict(graded: DataFrame, strict: bool = False) -> DataFrame:
    """FAIL when any status fails; warnings and pending fail too when strict."""
    failing = ("fail", "error", "warn", "pending") if strict else ("fail", "error")
    one = graded.agg(F.coalesce(F.max(F.col("status").isin(*failing)), F.lit(False)).alias("bad"),
                     F.coalesce(F.max(F.col("status") == "pending"), F.lit(False)).alias("pending"))
    return one.select(F.when(F.col("bad"), "FAIL").when(F.col("pending"), "PASS_PENDING").otherwise("PASS").alias("verdict"))


def summarise_breakdown(cells: DataFrame) -> DataFrame:
    """Per criterion: the smallest value of a floor, the largest of a ceiling, and the pass count."""
    numeric = F.count("value") == F.count("*")
    return cells.groupBy("criterion_id", "op").agg(
        F.when(numeric & (F.first("op") == "ge"), F.min("value")).when(numeric & (F.first("op") == "le"), F.max("value")).alias("binding_value"),
        F.count(F.when(F.col("status") == "pass", 1)).alias("n_pass"), F.count("*").alias("n_cells"))
