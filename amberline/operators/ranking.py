"""Order statistics of the scored book: budgets, deciles and rank-order exhibits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.config import DECILE_FLOOR, SCORE_DECIMALS
from amberline.functions.hashing import key_hash
from amberline.operators.aggregates import rates_by_band, with_interval
from amberline.operators.histogram import cumulative, score_histogram, two_grains
from amberline.operators.quantiles import quantiles_of_ranked
from amberline.operators.scalars import one_value
from amberline.session import materialise

TIE_HEX = 4  # 65,536 tie buckets inside one score


def slice_totals(df: DataFrame, slice_of: Callable[[Column, Column], Column], keys: tuple[str, ...],
                 score: str = "decision_score", outcome: str = "went_bad", groups: tuple[str, ...] = (),
                 descending: bool = False) -> DataFrame:
    """Totals per rank slice, without ranking the rows.

    ``slice_of(rank, total)`` gives the slice of a 1-based rank and must be
    monotone. Rows are ordered by score, then by a hash of their ``keys``.
    A score that falls into one slice is counted whole from the histogram. The
    few scores on a slice boundary are split by tie bucket in the same way, and
    only the buckets still on a boundary have their rows numbered. A score held
    by a third of the book is therefore never sorted in one task.
    """
    g = list(groups)
    rows = df.where(F.col(score).isNotNull()).select(
        *g, F.round(score, SCORE_DECIMALS).alias("score"), F.col(outcome).alias("_y"),
        key_hash(*[F.col(k) for k in keys]).alias("_tie")).withColumn("_bucket", F.substring("_tie", 1, TIE_HEX))
    order = F.desc if descending else F.asc

    def placed(cells: DataFrame, window_keys: list[str], by: Column, offset: Column) -> DataFrame:
        before = offset + F.sum("n").over(W.partitionBy(*(window_keys or [F.lit(0)])).orderBy(by)) - F.col("n")
        cells = cells.withColumn("_before", before)
        return cells.withColumns({"_first": slice_of(F.col("_before") + 1, F.col("_total")),
                                  "_last": slice_of(F.col("_before") + F.col("n"), F.col("_total"))})

    scores = rows.groupBy(*g, "score").agg(F.count("*").alias("n"), F.sum("_y").alias("bad"))
    scores = scores.withColumn("_total", F.sum("n").over(W.partitionBy(*(g or [F.lit(0)]))))
    # the histogram and the boundary cells are small tables of known size: Spark
    # broadcasts them by their file size instead of shuffling the rows
    scores = materialise(placed(scores, g, order("score"), F.lit(0)), "score-cells")
    split = materialise(scores.where(F.col("_first") != F.col("_last")).select(
        *g, "score", F.col("_before").alias("_offset"), "_total"), "split-scores")

    tied = rows.join(split, [*g, "score"])
    buckets = tied.groupBy(*g, "score", "_bucket", "_offset", "_total").agg(
        F.count("*").alias("n"), F.sum("_y").alias("bad"))
    buckets = materialise(placed(buckets, [*g, "score"], F.col("_bucket"), F.col("_offset")), "tie-cells")
    open_buckets = materialise(buckets.where(F.col("_first") != F.col("_last")).select(
        *g, "score", "_bucket", F.col("_before").alias("_at"), "_total"), "split-ties")

    numbered = rows.join(open_buckets, [*g, "score", "_bucket"]).withColumn(
        "_rank", F.col("_at") + F.row_number().over(W.partitionBy(*g, "score", "_bucket").orderBy("_tie")))
    parts = [
        cells.where(F.col("_first") == F.col("_last")).select(*g, F.col("_first").alias("slice"), "score", "n", "bad", "_total")
        for cells in (scores, buckets)]
    parts.append(numbered.select(*g, slice_of(F.col("_rank"), F.col("_total")).alias("slice"), "score",
                                 F.lit(1).cast("bigint").alias("n"), F.col("_y").alias("bad"), "_total"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy(*g, "slice").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.min("score").alias("score_lo"),
        F.max("score").alias("score_hi"), F.max("_total").alias("total"))


def recall_at_budgets(df: DataFrame, budgets: tuple[float, ...], keys: tuple[str, ...], book_grain: bool = False,
                      **kw) -> DataFrame:
    """Share of failures inside the top share of scores, one row per budget.

    Row grain takes floor(n * budget) rows; book grain rounds, at least one.
    """
    ordered = sorted(budgets)

    def size(b: float, total: Column) -> Column:
        if book_grain:
            return F.greatest(F.bround(total * F.lit(b)), F.lit(1.0))
        return F.floor(total * F.lit(b))

    def slice_of(rank: Column, total: Column) -> Column:
        outside = F.lit(0)
        for b in ordered:
            outside = outside + (rank > size(b, total)).cast("int")
        return outside

    slices = slice_totals(df, slice_of, keys, descending=True, **kw)
    one = slices.agg(F.max("total").alias("total"), F.sum("bad").alias("n_bad"), *[
        F.coalesce(F.sum(F.when(F.col("slice") <= i, F.col(c))), F.lit(0)).alias(f"{c}{i}")
        for i in range(len(ordered)) for c in ("n", "bad")])
    rows = F.array(*[F.struct(F.lit(b).alias("budget"), F.col(f"n{i}").alias("n_reviewed"), F.col(f"bad{i}").alias("n_caught"),
                              F.col("n_bad")) for i, b in enumerate(ordered)])
    out = one.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("recall", F.coalesce(F.try_divide("n_caught", "n_bad"), F.lit(0.0)))


def recall_by_lead_bucket(df: DataFrame, buckets: list[tuple[int, int]], share: float = 0.9,
                          score: str = "decision_score") -> DataFrame:
    """Per lead bucket, the share of failing rows at or above a score percentile."""
    hist = cumulative(score_histogram(df, score)).select("score", "n", F.col("n_below").alias("before"), F.col("n_all").alias("total"))
    cut = one_value(quantiles_of_ranked(hist, "score", (share,)), F.max("value"))
    caught = F.round(score, SCORE_DECIMALS) >= cut
    hits = df.where(F.col("went_bad") == 1).withColumn("_caught", caught).agg(*[
        F.struct(F.count(F.when(F.col("to_npa").between(lo, hi), 1)).alias("n"),
                 F.count(F.when(F.col("to_npa").between(lo, hi) & F.col("_caught"), 1)).alias("k")).alias(f"b{lo}")
        for lo, hi in buckets])
    rows = F.array(*[F.struct(F.lit(f"{lo}-{hi}").alias("bucket"), F.col(f"b{lo}.n").alias("n"), F.col(f"b{lo}.k").alias("caught"))
                     for lo, hi in buckets])
    out = hits.select(F.explode(rows).alias("r")).select("r.*")
    return out.withColumn("recall", F.try_divide("caught", "n"))


def deciles(df: DataFrame, keys: tuple[str, ...], groups: tuple[str, ...] = (), **kw) -> DataFrame:
    """Ascending score deciles [floor(i*n/10), floor((i+1)*n/10)) with rate and interval."""
    cells = slice_totals(df, lambda rank, total: F.ceil(10 * rank / total).cast("int"), keys, groups=groups, **kw)
    out = cells.select(*groups, F.col("slice").alias("decile"), "score_lo", "score_hi", F.col("bad").alias("k"), "n")
    return with_interval(out)


def bands_monotone(cells: DataFrame, by: str = "portfolio") -> DataFrame:
    """Whether green < amber < red strictly, from :func:`rates_by_band` cells."""
    def at(band: str) -> Column:
        return F.max(F.when(F.col("band") == band, F.round("rate", 4)))

    rates = cells.groupBy(by).agg(at("green").alias("green"), at("amber").alias("amber"), at("red").alias("red"))
    return rates.withColumn("monotone", (F.col("green") < F.col("amber")) & (F.col("amber") < F.col("red")))


def decile_steps(decile_rows: DataFrame, groups: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """Non-decreasing steps over ten deciles, literally and by disjoint intervals."""
    order = W.partitionBy(*(groups or [F.lit(0)])).orderBy("decile")
    rate, lo, hi = (F.round(c, digits) for c in ("rate", "ci_lo", "ci_hi"))
    steps = decile_rows.withColumns({
        "_up": rate >= F.lag(rate).over(order), "_ci_up": hi >= F.lag(lo).over(order)})
    out = steps.groupBy(*groups).agg(
        F.count("_up").alias("steps"), F.count(F.when(F.col("_up"), 1)).alias("steps_ok"),
        F.count(F.when(F.col("_up") | F.col("_ci_up"), 1)).alias("steps_ok_ci"))
    return out.withColumn("fraction_ok", F.coalesce(F.try_divide("steps_ok", "steps"), F.lit(0.0)))


def rank_order_violations(df: DataFrame, keys: tuple[str, ...], outcome: str = "went_bad",
                          floor: float = DECILE_FLOOR, by: str = "portfolio") -> DataFrame:
    """Rank-order verdicts per group and pooled: bands strictly increasing, decile steps above the floor."""
    bands = bands_monotone(rates_by_band(df, F.col(outcome) == 1, by), by)
    steps = decile_steps(deciles(two_grains(df, by), keys, (by,), outcome=outcome), (by,))
    both = bands.join(steps, by)
    return both.withColumn("passed", F.col("monotone") & (F.col("fraction_ok") >= floor))


def precision_decomposition(df: DataFrame, new_red: float, old_red: float, old_precision: float,
                            score: str = "decision_score", outcome: str = "went_bad") -> DataFrame:
    """Change of Red precision split into a model effect and a cut-off effect, in points."""
    def precision(cut: float) -> Column:
        return F.coalesce(F.avg(F.when(F.col(score) >= cut, F.col(outcome))), F.lit(0.0))

    one = df.agg(precision(old_red).alias("at_old"), precision(new_red).alias("at_new"),
                 F.count(F.when(F.col(score) >= old_red, 1)).alias("n_old"),
                 F.count(F.when(F.col(score) >= new_red, 1)).alias("n_new"))
    return one.withColumns({"model_effect_pp": (F.col("at_old") - old_precision) * 100,
                            "cutoff_effect_pp": (F.col("at_new") - F.col("at_old")) * 100})
