"""Joins of the book, its overlays and its history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.config import OVERLAY_FIELDS
from amberline.operators.windows import by_period


def with_static(book: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add the account attributes the book does not carry itself."""
    extra = [c for c in accounts.columns if c not in book.columns]
    return book.join(accounts.select("account_id", *extra), "account_id")


def overlay_identity(book: DataFrame, overlay: DataFrame, fields=OVERLAY_FIELDS) -> DataFrame:
    """Replace identity fields by the overlay's non-null values; nothing else is touched."""
    use = [c for c in fields if c in overlay.columns]
    over = overlay.select("account_id", *[F.col(c).alias(f"_o_{c}") for c in use])
    joined = book.join(over, "account_id", "left")
    merged = {c: F.coalesce(F.col(f"_o_{c}"), F.col(c)) if c in book.columns else F.col(f"_o_{c}") for c in use}
    return joined.withColumns(merged).drop(*[f"_o_{c}" for c in use])


def id_bijection(panel: DataFrame, accounts: DataFrame) -> DataFrame:
    """Ids present on one side only, tagged with the side."""
    left, right = panel.select("account_id").distinct(), accounts.select("account_id").distinct()
    return (left.join(right, "account_id", "left_anti").withColumn("only_in", F.lit("panel"))
            .unionByName(right.join(left, "account_id", "left_anti").withColumn("only_in", F.lit("accounts"))))


def vintage_mismatches(panel: DataFrame, accounts: DataFrame, step: int = 1) -> DataFrame:
    """Rows whose age is not the starting age plus the elapsed periods."""
    joined = panel.select("account_id", "period", "vintage_months").join(
        accounts.select("account_id", "vintage_0"), "account_id", "left")
    expected = F.col("vintage_0") + step * F.col("period")
    return joined.where(~F.col("vintage_months").eqNullSafe(expected))


def levels_missing_from(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """Levels of a categorical column with training rows and no test row."""
    return train.select(column).distinct().join(test.select(column).distinct(), column, "left_anti")


def hold_between_refreshes(df: DataFrame, value: str, refreshed: Column, name: str | None = None) -> DataFrame:
    """Value as of the account's last refresh (as-of join within the account); its first value before any."""
    now = F.struct(F.col(value).alias("v"))
    held = F.coalesce(F.last(F.when(refreshed, now), ignorenulls=True).over(by_period()), F.first(now).over(by_period()))
    return df.withColumn(name or value, held["v"])


def reported_with_lag(df: DataFrame, value: str, lag: Column, name: str) -> DataFrame:
    """Value as of period - lag; the first value before that.

    The lag may differ by row. Each row is joined to the source row on an equal
    (account, period) key, so no range condition is needed.
    """
    first = F.first(value).over(by_period())
    rows = df.withColumn("_first", first).withColumn("_at", F.col("period") - lag)
    source = df.select("account_id", F.col("period").alias("_at"), F.col(value).alias("_then"))
    joined = rows.join(source, ["account_id", "_at"], "left")
    return joined.withColumn(name, F.coalesce("_then", "_first")).drop("_at", "_first", "_then")


def cut_index(score: Column, cuts: Column) -> Column:
    """How many of the ascending cut-offs a score reaches (0 = below all)."""
    return F.size(F.filter(cuts, lambda c: c <= score))
