"""Grouped summaries of the panel and the book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.config import BANDS, RUPEES_PER_CRORE, SMA2_HORIZON_MONTHS, CostParams
from amberline.functions import costs
from amberline.functions.numeric import rate, wilson_high, wilson_low

POOLED = "__pooled__"


def at_two_grains(df: DataFrame, *aggs: Column, by: str = "portfolio", keys: tuple[str, ...] = ()) -> DataFrame:
    """Aggregate once pooled and once per group; the pooled rows carry ``__pooled__``."""
    level = F.when(F.grouping(by) == 1, F.lit(POOLED)).otherwise(F.col(by))
    sets = [[F.col(k) for k in keys], [F.col(k) for k in keys] + [F.col(by)]]
    cols = [F.col(k) for k in keys] + [F.col(by)]
    out = df.groupingSets(sets, *cols).agg(level.alias("_level"), *aggs)
    return out.withColumn(by, F.col("_level")).drop("_level")


def with_interval(df: DataFrame, k: str = "k", n: str = "n", prefix: str = "") -> DataFrame:
    """Add the rate of k in n and its 95 % Wilson interval."""
    kc, nc = F.col(k), F.col(n)
    return df.withColumns({f"{prefix}rate": rate(kc, nc), f"{prefix}ci_lo": wilson_low(kc, nc),
                           f"{prefix}ci_hi": wilson_high(kc, nc)})


def base_rates(df: DataFrame) -> DataFrame:
    """Label rate, SMA-2 rate and their ratio per unit of time, pooled and per portfolio."""
    rows = df.where(F.col("labelable") == 1)
    out = at_two_grains(rows, F.count("*").alias("n"), F.avg("went_bad").alias("bad_rate"), F.avg("sma2").alias("sma2_rate"))
    ratio = F.coalesce(F.try_divide("sma2_rate", "bad_rate"), F.lit(0.0))
    return out.withColumn("sma2_to_npa", ratio).withColumn(
        "sma2_to_npa_events", ratio * (12.0 / SMA2_HORIZON_MONTHS))


def inside_bands(rates: DataFrame, limits: DataFrame, key: str, value: str) -> DataFrame:
    """Join each rate to its allowed [lo, hi] and say whether it is inside."""
    return rates.join(limits, key).select(
        key, value, "lo", "hi", F.col(value).between(F.col("lo"), F.col("hi")).alias("passed"))


def rates_by_band(df: DataFrame, outcome: Column, by: str = "portfolio") -> DataFrame:
    """Count, failures and Wilson interval per band at two grains, absent bands zero-filled."""
    cells = at_two_grains(
        df, *[F.count(F.when(F.col("band") == b, 1)).alias(f"n_{b}") for b in BANDS],
        *[F.count(F.when((F.col("band") == b) & outcome, 1)).alias(f"k_{b}") for b in BANDS], by=by)
    rows = F.explode(F.array(*[F.struct(
        F.lit(i).alias("ord"), F.lit(b).alias("band"), F.col(f"k_{b}").alias("k"), F.col(f"n_{b}").alias("n"))
        for i, b in enumerate(BANDS)])).alias("c")
    return with_interval(cells.select(by, rows).select(by, "c.*"))


def red_precision(df: DataFrame, horizon: int) -> DataFrame:
    """Share of Red accounts that reach NPA within the horizon, pooled and per portfolio."""
    bad, red = F.col("to_npa").between(1, horizon), F.col("band") == "red"
    cells = at_two_grains(df, F.count(F.when(red, 1)).alias("n"), F.count(F.when(red & bad, 1)).alias("k"),
                          F.count(F.when(bad, 1)).alias("n_bad_book"))
    return with_interval(cells)


def honest_metrics(df: DataFrame, horizon: int, long_horizon: int) -> DataFrame:
    """Headline precision and the numbers to read beside it, one row per metric."""
    bad, long_bad = F.col("to_npa").between(1, horizon), F.col("to_npa").between(1, long_horizon)
    red, green = F.col("band") == "red", F.col("band") == "green"

    def count(c: Column) -> Column:
        return F.count(F.when(c, 1))

    one = df.agg(
        F.count("*").alias("n"), count(bad).alias("bad"), count(long_bad).alias("long_bad"), count(red).alias("red"),
        count(red & bad).alias("red_bad"), count(red == bad).alias("correct"), count(green & bad).alias("missed"),
        count(~green).alias("flagged"))
    metrics = {
        "red_precision": ("red_bad", "red"), "raw_accuracy": ("correct", "n"), "base_rate": ("bad", "n"),
        "base_rate_long": ("long_bad", "n"), "missed_share": ("missed", "bad"), "flagged_share": ("flagged", "n"),
    }
    cells = [F.struct(F.lit(m).alias("metric"), F.col(k).alias("k"), F.col(n).alias("n"))
             for m, (k, n) in metrics.items()]
    cells.append(F.struct(F.lit("flag_nobody").alias("metric"), (F.col("n") - F.col("bad")).alias("k"), F.col("n").alias("n")))
    return with_interval(one.select(F.explode(F.array(*cells)).alias("c")).select("c.*"))


def portfolio_summary(book: DataFrame) -> DataFrame:
    """Accounts per band and the sanctioned amount in Red."""
    return book.agg(F.count("*").alias("n"), *[F.count(F.when(F.col("band") == b, 1)).alias(f"n_{b}") for b in BANDS],
                    F.coalesce(F.sum(F.when(F.col("band") == "red", F.col("sanctioned"))), F.lit(0.0)).alias("exposure_at_risk"))


def concentration(book: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Amounts by band for several groupings in one pass, largest flagged amount first."""
    amount = F.coalesce(F.col("sanctioned"), F.lit(0.0))

    def total(b: str) -> Column:
        return F.sum(F.when(F.col("band") == b, amount).otherwise(0.0))

    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("level")) for k in keys]))
    cells = book.select("band", "sanctioned", levels.alias("l")).where(F.col("l.level").isNotNull()).groupBy(
        F.col("l.key").alias("key"), F.col("l.level").alias("level")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("band") != "green", 1)).alias("n_flagged"),
        F.sum(amount).alias("total"), total("red").alias("red"), total("amber").alias("amber"))
    return cells.withColumn("pct_flagged", F.coalesce(F.try_divide(F.col("red") + F.col("amber"), F.col("total")), F.lit(0.0))) \
        .orderBy("key", F.desc(F.col("red") + F.col("amber")))


def act_first(book: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` flagged accounts with the largest expected loss (a top-k report)."""
    at_risk = F.col("decision_score") * F.coalesce(F.col("sanctioned"), F.lit(0.0))
    return book.where(F.col("band") != "green").select("account_id", "band", at_risk.alias("at_risk")) \
        .orderBy(F.desc("at_risk"), "account_id").limit(k)


def provision_what_if(book: DataFrame, cure: float, provision: float, book_crore: float) -> DataFrame:
    """Expected NPA of the flagged accounts and what early action would save."""
    flagged = F.col("band") != "green"
    loss = F.col("decision_score") * F.col("sanctioned")
    one = book.agg(F.sum(F.when(flagged, loss)).alias("expected_npa"),
                   F.sum(F.when(flagged, F.col("sanctioned"))).alias("flagged_exposure"),
                   (F.sum("sanctioned") / RUPEES_PER_CRORE).alias("sample_crore"))
    return one.withColumns({
        "scale": F.coalesce(F.try_divide(F.lit(book_crore), F.col("sample_crore")), F.lit(0.0)),
        "provision_saved": F.col("expected_npa") * provision * cure,
        "exposure_protected": F.col("expected_npa") * cure})


def stack_levels(df: DataFrame, cuts: dict[str, Column], *keep: str) -> DataFrame:
    """One row per (row, cut): long form of several categorical cuts."""
    cells = F.array(*[F.struct(F.lit(c).alias("cut"), v.cast("string").alias("level")) for c, v in cuts.items()])
    return df.select(*keep, F.explode(cells).alias("_c")).select(*keep, "_c.cut", "_c.level")


def level_order(df: DataFrame) -> DataFrame:
    """Add ``level_rank``: numeric order inside a cut when every level parses as a number."""
    cut = W.partitionBy("cut")
    as_number = F.col("level").try_cast("double")
    numeric = F.min(as_number.isNotNull()).over(cut)
    return df.withColumn("_num", F.when(numeric, as_number)).withColumn(
        "level_rank", F.row_number().over(cut.orderBy("_num", "level"))).drop("_num")


def level_mix(df: DataFrame, column: str) -> DataFrame:
    """Rows and share per level. Levels are few, the window sees aggregated rows only."""
    cells = df.groupBy(column).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def weighted_mean(df: DataFrame, value: str, weight: str) -> DataFrame:
    known = F.col(value).isNotNull()
    return df.agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(known, F.col(weight)))).alias("weighted_mean"))


def cost_mix(book: DataFrame, p: CostParams) -> DataFrame:
    """Mean exposure, loss given default and expected loss per portfolio."""
    lgd = costs.lgd(F.col("secured"), p)
    return book.groupBy("portfolio").agg(
        F.count("*").alias("n"), F.avg("secured").alias("secured_share"), F.avg(lgd).alias("lgd_mean"),
        F.avg("ead").alias("ead_mean"), F.avg(costs.expected_loss(F.col("ead"), lgd, p)).alias("loss_mean"))


def census(df: DataFrame, column: str, levels: tuple[str, ...]) -> DataFrame:
    """Rows per listed level, absent ones as 0."""
    one = df.agg(*[F.count(F.when(F.col(column) == v, 1)).alias(f"l{i}") for i, v in enumerate(levels)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(v).alias(column), F.col(f"l{i}").alias("n"))
                                          for i, v in enumerate(levels)])).alias("c")).select("c.*")
