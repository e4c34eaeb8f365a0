"""How early a warning comes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.operators.windows import by_account


@dataclass(frozen=True)
class Rule:
    """A signal rule: ``lt``/``gt`` a level, or ``rel_lt``/``rel_gt`` a multiple of the account's baseline."""

    column: str
    kind: str
    threshold: float

    def fires(self, value: Column, baseline: Column | None = None) -> Column:
        level = F.lit(self.threshold) * baseline if self.kind.startswith("rel") else F.lit(self.threshold)
        hit = value < level if self.kind.endswith("lt") else value > level
        return F.coalesce(hit, F.lit(False))


def sustained_lead(df: DataFrame, flagged: Column, horizon: int = 12) -> DataFrame:
    """Longest unbroken flagged run that reaches up to NPA, inside the horizon.

    The run breaks at the smallest ``to_npa`` of an unflagged row; the lead is
    the largest ``to_npa`` below that.
    """
    on = F.coalesce(flagged, F.lit(False))
    broken = F.min(F.when(~F.col("_on") & (F.col("to_npa") <= horizon), F.col("to_npa"))).over(by_account())
    inside = F.col("to_npa").between(1, horizon) & (F.col("to_npa") < F.coalesce(F.col("_break"), F.lit(horizon + 1)))
    return df.withColumn("_on", on).withColumn("_break", broken).groupBy("account_id").agg(
        F.coalesce(F.max(F.when(inside, F.col("to_npa"))), F.lit(0)).alias("lead"))


def lead_before_delinquency(df: DataFrame, flagged: Column, horizon: int = 12) -> DataFrame:
    """First period in arrears minus first flagged period, per account that reaches NPA."""
    per = df.groupBy("account_id").agg(
        F.min(F.when(F.col("dpd") > 0, F.col("period"))).alias("first_late"),
        F.min(F.when(flagged, F.col("period"))).alias("first_flag"),
        F.max(F.col("to_npa").between(1, horizon)).alias("_bad"))
    return per.where("_bad").select("account_id", "first_late", "first_flag",
                                    (F.col("first_late") - F.col("first_flag")).alias("lead"))


def account_baseline(df: DataFrame, column: str, slide: int = 18, early: int = 3) -> DataFrame:
    """Median before the slide can have begun, else the median of the first periods.

    As in the source definition, accounts without early rows have no baseline.
    """
    per = df.groupBy("account_id").agg(
        F.median(F.when(F.col("to_npa") > slide, F.col(column))).alias("_healthy"),
        F.median(F.when(F.col("period") < early, F.col(column))).alias("_early"),
        F.max(F.col("period") < early).alias("_seen"))
    return per.where("_seen").select("account_id", F.coalesce("_healthy", "_early").alias("baseline"))


def _window_rows(df: DataFrame, rule: Rule, slide: int) -> DataFrame:
    rows = df.where(F.col("to_npa").between(1, slide))
    if not rule.kind.startswith("rel"):
        return rows.withColumn("_fired", rule.fires(F.col(rule.column)))
    base = account_baseline(df, rule.column, slide)
    return rows.join(base, "account_id", "left").withColumn(
        "_fired", rule.fires(F.col(rule.column), F.col("baseline")))


def signal_leads(df: DataFrame, rule: Rule, slide: int = 18) -> DataFrame:
    """Earliest firing of a rule, in periods before NPA, per account; 0 for never."""
    return _window_rows(df, rule, slide).groupBy("account_id").agg(
        F.coalesce(F.max(F.when(F.col("_fired"), F.col("to_npa"))), F.lit(0)).alias("lead"))


def sustained_signal_leads(df: DataFrame, rule: Rule, slide: int = 18, sustain: int = 3) -> DataFrame:
    """As :func:`signal_leads`, but the rule must hold for ``sustain`` consecutive offsets.

    Offsets are the distances to NPA seen anywhere in the data (at most
    ``slide`` of them); at the edge nearest NPA a shorter run is accepted.
    """
    rows = _window_rows(df, rule, slide)
    offsets = rows.agg(F.array_sort(F.collect_set("to_npa"))).scalar()
    fired = F.col("_fired")
    by_pos = W.partitionBy("account_id").orderBy("_pos")
    # positions minus the fired rows so far is constant inside an unbroken run
    rows = rows.withColumn("_pos", F.array_position(offsets, F.col("to_npa"))).withColumn(
        "_island", F.when(fired, F.col("_pos") - F.sum(fired.cast("int")).over(by_pos)))
    run = F.row_number().over(W.partitionBy("account_id", "_island").orderBy("_pos"))
    held = fired & (F.col("_run") >= F.least(F.col("_pos"), F.lit(sustain)))
    return rows.withColumn("_run", run).groupBy("account_id").agg(
        F.coalesce(F.max(F.when(held, F.col("to_npa"))), F.lit(0)).alias("lead"))


def first_warning(df: DataFrame, rules: list[Rule], slide: int = 18, sustain: int = 3) -> DataFrame:
    """Per account, the earliest sustained warning over several rules."""
    parts = [sustained_signal_leads(df.where(F.col(r.column).isNotNull()), r, slide, sustain) for r in rules]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("account_id").agg(F.max("lead").alias("lead"))


def lead_summary(leads: DataFrame) -> DataFrame:
    """Median lead of the accounts that were warned, and the share that was."""
    hit = F.when(F.col("lead") > 0, F.col("lead"))
    return leads.agg(
        F.coalesce(F.median(hit), F.lit(0.0)).alias("median_lead"),
        F.coalesce(F.avg((F.col("lead") > 0).cast("int")), F.lit(0.0)).alias("coverage"))


def warning_census(leads: DataFrame, early: int = 6) -> DataFrame:
    """Median and mean lead over all failing accounts, shares early and never."""
    return leads.agg(
        F.count("*").alias("n"), F.median("lead").alias("median_lead"), F.avg("lead").alias("mean_lead"),
        F.avg((F.col("lead") >= early).cast("int")).alias("share_early"),
        F.avg((F.col("lead") == 0).cast("int")).alias("share_never"))


def leads_by_bucket(leads: DataFrame, buckets: list[tuple[int, int]]) -> DataFrame:
    """Count and share of accounts whose lead falls in each bucket, empty ones included."""
    counted = leads.agg(F.count("*").alias("n_all"), *[
        F.count(F.when(F.col("lead").between(lo, hi), 1)).alias(f"b{i}") for i, (lo, hi) in enumerate(buckets)])
    rows = F.array(*[F.struct(F.lit(f"{lo}-{hi}").alias("bucket"), F.col(f"b{i}").alias("n"))
                     for i, (lo, hi) in enumerate(buckets)])
    cells = counted.select("n_all", F.explode(rows).alias("r"))
    return cells.select("r.bucket", "r.n", F.try_divide("r.n", "n_all").alias("share"))
