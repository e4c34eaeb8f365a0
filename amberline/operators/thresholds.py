"""Cost-minimising Amber and Red cut-offs.

The book is reduced to a histogram of (portfolio, security class, score) that
holds counts and exposures. Costs are linear in those sums, so any number of
candidate pairs or cost parameters is priced from the histogram. At most 96
candidate cut-offs exist, so the pair grid is bounded by 96 x 95 / 2 rows per
portfolio whatever the size of the book.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.config import RUPEES_PER_CRORE, SCORE_DECIMALS, CostParams, candidate_fractions
from amberline.functions.costs import band_costs, lgd
from amberline.functions.numeric import rate
from amberline.operators.aggregates import POOLED
from amberline.operators.histogram import cumulative
from amberline.operators.joins import cut_index
from amberline.operators.quantiles import quantiles_of_ranked
from amberline.session import materialise

LEVELS = ("all_constraints", "portfolio_monotone", "pooled_monotone", "non_empty")
SUMS = ("n", "bad", "green", "amber", "red", "ead")
SWEPT = ("cure_share_red", "review_cost_red_inr", "lgd_unsecured", "friction_share_red", "income_reversal_months")


def cost_histogram(book: DataFrame, score: str = "decision_score", outcome: str = "went_bad") -> DataFrame:
    """Counts and exposures per (portfolio, secured, score); ``secured`` may be NULL (unknown).

    The book is read once: the histogram is written to the work folder and the
    whole search runs on it.
    """
    hist = book.where(F.col(score).isNotNull()).groupBy(
        "portfolio", F.col("secured").cast("int").alias("secured"), F.round(score, SCORE_DECIMALS).alias("score")).agg(
        F.count("*").alias("n"), F.sum(outcome).alias("bad"), F.sum("ead").alias("ead"),
        F.sum(F.col("ead") * F.col(outcome)).alias("ead_bad"))
    return materialise(hist, "cost-histogram")


def priced(hist: DataFrame, p=None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Histogram with the cost of each cell in each band, one row per (keys, portfolio, score)."""
    p = p or CostParams()
    by_band = band_costs(F.col("n"), F.col("ead"), F.col("ead_bad"), lgd(F.col("secured"), p), p)
    return hist.withColumns(by_band).groupBy(*keys, "portfolio", "score").agg(*[F.sum(c).alias(c) for c in SUMS])


def candidate_cuts(hist: DataFrame) -> Column:
    """Ascending array of candidate cut-offs (scalar subquery).

    Quantiles of the scores at 1 - share for each candidate share, rounded
    before anything is counted. A cut-off must flag some but not all accounts;
    of cut-offs flagging the same accounts the highest is kept.
    """
    pooled = hist.groupBy("score").agg(F.sum("n").alias("n"))
    ranked = cumulative(pooled.withColumn("bad", F.lit(0))).select(
        "score", "n", F.col("n_below").alias("before"), F.col("n_all").alias("total"))
    probs = tuple(1.0 - f for f in candidate_fractions())
    points = quantiles_of_ranked(ranked, "score", probs).agg(
        F.array_sort(F.array_distinct(F.collect_list(F.round("value", SCORE_DECIMALS))))).scalar()
    counted = pooled.withColumn("_cuts", points).select("n", "_cuts", cut_index(F.col("score"), F.col("_cuts")).alias("bin"))
    per_bin = counted.groupBy("bin").agg(F.sum("n").alias("n"), F.first("_cuts").alias("_cuts"))
    flagged = per_bin.where(F.col("bin") > 0).withColumn("j", F.explode(F.sequence(F.lit(1), F.col("bin")))).groupBy("j").agg(
        F.sum("n").alias("k"), F.first("_cuts").alias("_cuts"))
    total = pooled.agg(F.sum("n")).scalar()
    valid = flagged.where((F.col("k") >= 1) & (F.col("k") < total)).groupBy("k").agg(
        F.max(F.element_at("_cuts", F.col("j"))).alias("cut"))
    return valid.agg(F.array_sort(F.collect_list("cut"))).scalar()


def cut_table(hist: DataFrame, cells: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums flagged at each candidate cut-off, per portfolio and pooled, with the totals.

    One row per (keys, portfolio, cut): ``j`` is the ascending position of the
    cut-off, ``n``, ``bad`` and the costs are the sums at or above it, ``all_*``
    the totals. At most 96 rows per portfolio, written to the work folder.
    """
    cells = priced(hist) if cells is None else cells
    binned = cells.withColumn("_cuts", candidate_cuts(hist)).select(
        *keys, F.explode(F.array(F.lit(POOLED), F.col("portfolio"))).alias("portfolio"), "_cuts",
        cut_index(F.col("score"), F.col("_cuts")).alias("bin"), *SUMS)
    per_bin = binned.groupBy(*keys, "portfolio", "bin").agg(
        *[F.sum(c).alias(c) for c in SUMS], F.first("_cuts").alias("_cuts"))
    # a bin counts for every cut-off up to its own; j = 0 collects the totals
    spread = per_bin.withColumn("j", F.explode(F.sequence(F.lit(0), F.size("_cuts"))))
    reached = F.col("bin") >= F.col("j")
    sums = spread.groupBy(*keys, "portfolio", "j").agg(
        F.first("_cuts").alias("_cuts"), *[F.coalesce(F.sum(F.when(reached, F.col(c))), F.lit(0)).alias(c) for c in SUMS])
    whole = W.partitionBy(*keys, "portfolio")
    totals = {f"all_{c}": F.max(F.when(F.col("j") == 0, F.col(c))).over(whole) for c in SUMS}
    rows = sums.withColumns(totals).where(F.col("j") > 0).withColumn("cut", F.element_at("_cuts", F.col("j")))
    return materialise(rows.drop("_cuts"), "cut-table")


def cost_grid(table: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every (amber, red) pair with its cost and the strictest rung it satisfies (1 = strictest).

    The join pairs the at most 96 cut-offs of a portfolio with the higher ones.
    """
    on = [*keys, "portfolio"]
    a = table.select(*on, *[F.col(c).alias(f"a_{c}") for c in ("j", "cut", *SUMS)], *[f"all_{c}" for c in SUMS])
    r = table.select(*on, *[F.col(c).alias(f"r_{c}") for c in ("j", "cut", *SUMS)])
    pairs = a.join(r, on).where(F.col("r_j") > F.col("a_j"))
    c = F.col
    cost = c("r_red") + (c("a_amber") - c("r_amber")) + (c("all_green") - c("a_green"))
    red = rate(c("r_bad"), c("r_n"))
    amber = rate(c("a_bad") - c("r_bad"), c("a_n") - c("r_n"))
    green = rate(c("all_bad") - c("a_bad"), c("all_n") - c("a_n"))
    rows = pairs.select(
        *on, c("a_cut").alias("amber"), c("r_cut").alias("red"), cost.alias("cost"), c("a_n").alias("n_flagged"), c("r_n").alias("n_red"),
        c("a_bad").alias("bad_flagged"), c("r_bad").alias("bad_red"), c("all_bad").alias("bad_all"),
        ((green < amber) & (amber < red)).alias("monotone"), (c("r_n") >= 1).alias("has_red"))
    pooled = F.col("portfolio") == POOLED

    def of_pooled(name: str) -> Column:
        return F.max(F.when(pooled, F.col(name))).alias(name)

    per_pair = rows.groupBy(*keys, "amber", "red").agg(
        *[of_pooled(name) for name in ("cost", "n_flagged", "n_red", "bad_flagged", "bad_red", "bad_all")],
        F.max(pooled & F.col("monotone")).alias("_pooled"), F.min("monotone").alias("_everywhere"), F.min("has_red").alias("_red"))
    rung = (F.when(F.col("_everywhere") & F.col("_red"), 1).when(F.col("_everywhere"), 2)
            .when(F.col("_pooled"), 3).otherwise(4))
    return per_pair.withColumn("rung", rung).drop("_pooled", "_everywhere", "_red")


def pick(grid: DataFrame, keys: tuple[str, ...] = (), rung: Column | None = None) -> DataFrame:
    """Cheapest pair at the strictest rung that has one, or at a given rung.

    Ties go to the higher amber, then the higher red cut-off. No row when the
    grid is empty.
    """
    rows = grid if rung is None else grid.where(F.col("rung") <= rung)
    first = F.lit(1) if rung is not None else F.col("rung")
    order = F.struct(first, F.col("cost"), -F.col("amber"), -F.col("red"))
    best = rows.groupBy(*keys).agg(F.min_by(F.struct("amber", "red", "rung", "cost", "n_flagged", "n_red"), order).alias("p"))
    return best.where(F.col("p").isNotNull()).select(*keys, "p.*")


def feasible_counts(grid: DataFrame) -> DataFrame:
    """How many pairs satisfy each rung of the ladder."""
    one = grid.agg(*[F.count(F.when(F.col("rung") <= i + 1, 1)).alias(level) for i, level in enumerate(LEVELS)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.col(level).alias("pairs"))
                                          for level in LEVELS])).alias("c")).select("c.*")


def evaluate(cells: DataFrame, amber: Column | float, red: Column | float) -> DataFrame:
    """Everything one pair implies: cost, band rates, precision, misses, exposure and rung."""
    pair = cells.withColumns({"_amber": amber if isinstance(amber, Column) else F.lit(float(amber)),
                              "_red": red if isinstance(red, Column) else F.lit(float(red))})
    is_red = F.col("score") >= F.col("_red")
    is_amber = ~is_red & (F.col("score") >= F.col("_amber"))
    is_green = ~is_red & ~is_amber
    where = {"green": is_green, "amber": is_amber, "red": is_red}

    def total(c: str, cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))

    per = pair.groupBy("portfolio").agg(
        F.max("_amber").alias("amber"), F.max("_red").alias("red"),
        *[total(c, where[b]).alias(f"{c}_{b}") for b in where for c in ("n", "bad", b, "ead")])
    mono = _increasing(*[rate(F.col(f"bad_{b}"), F.col(f"n_{b}")) for b in ("green", "amber", "red")])
    summed = [c for c in per.columns if c not in ("portfolio", "amber", "red")]
    one = per.groupBy("amber", "red").agg(
        *[F.sum(c).alias(c) for c in summed], F.min(mono).alias("_each"), F.min(F.col("n_red") >= 1).alias("_red"))
    pooled = _increasing(*[rate(F.col(f"bad_{b}"), F.col(f"n_{b}")) for b in ("green", "amber", "red")])
    n = F.col("n_green") + F.col("n_amber") + F.col("n_red")
    bad = F.col("bad_green") + F.col("bad_amber") + F.col("bad_red")
    full = (F.col("n_green") > 0) & (F.col("n_amber") > 0) & (F.col("n_red") > 0)
    rung = F.when(full, F.when(pooled & F.col("_each") & F.col("_red"), 1).when(pooled & F.col("_each"), 2)
                  .when(pooled, 3).otherwise(4))
    cost = F.col("green_green") + F.col("amber_amber") + F.col("red_red")
    return one.select(
        "amber", "red", rung.alias("rung"), cost.alias("cost"), (cost / n).alias("cost_per_account"),
        n.alias("n"), bad.alias("n_bad"), "n_green", "n_amber", "n_red",
        rate(F.col("bad_red"), F.col("n_red")).alias("red_precision"), rate(F.col("bad_amber"), F.col("n_amber")).alias("amber_precision"),
        rate(F.col("bad_green"), bad).alias("missed_share"), rate(F.col("n_amber") + F.col("n_red"), n).alias("flagged_share"),
        rate(F.col("bad_red"), bad).alias("recall_red"), rate(F.col("bad_amber") + F.col("bad_red"), bad).alias("recall_flagged"),
        (F.col("ead_amber") + F.col("ead_red")).alias("exposure_flagged"))


def _increasing(a: Column, b: Column, c: Column) -> Column:
    return (a < b) & (b < c)


def alternatives(grid: DataFrame, rung: Column, k: int = 6) -> DataFrame:
    """The ``k`` cheapest pairs at a rung, distinct to four decimals."""
    at = grid.where(F.col("rung") <= rung).withColumns({"amber4": F.round("amber", 4), "red4": F.round("red", 4)})
    return at.groupBy("amber4", "red4").agg(
        F.min_by(F.struct("cost", "n_red", "n_flagged"), F.struct(F.col("cost"), -F.col("amber"), -F.col("red"))).alias("p")).select(
        F.col("amber4").alias("amber"), F.col("red4").alias("red"), "p.*").orderBy("cost", F.desc("amber"), F.desc("red")).limit(k)


def cost_curve(grid: DataFrame, chosen: DataFrame) -> DataFrame:
    """Cost along the red cut-off at the chosen amber and along amber at the chosen red."""
    a, r = chosen.select("amber").scalar(), chosen.select("red").scalar()
    sweep = F.explode(F.array_compact(F.array(
        F.when(F.col("amber") == F.col("_a"), F.struct(F.lit("red").alias("sweep"), F.col("red").alias("cut"), F.col("n_red").alias("n"), F.col("bad_red").alias("bad"))),
        F.when(F.col("red") == F.col("_r"), F.struct(F.lit("amber").alias("sweep"), F.col("amber").alias("cut"), F.col("n_flagged").alias("n"), F.col("bad_flagged").alias("bad"))))))
    rows = grid.withColumns({"_a": a, "_r": r}).select("cost", "bad_all", sweep.alias("s"))
    return rows.select("s.sweep", "s.cut", "cost", "s.n", "s.bad", (F.col("bad_all") - F.col("s.bad")).alias("bad_outside"),
                       (F.col("s.n") - F.col("s.bad")).alias("false_positives"))


def scenario_params(p: CostParams | None = None) -> list[dict]:
    """Ten scenarios: five parameters moved by half in both directions, shares capped at 0.95."""
    p = p or CostParams()
    out = []
    for name in SWEPT:
        for label, factor in (("x0.5", 0.5), ("x1.5", 1.5)):
            value = getattr(p, name) * factor
            if name.startswith(("cure_share", "friction_share")):
                value = min(value, 0.95)
            out.append({**p.__dict__, name: value, "param": name, "change": label, "value": value})
    return out


def sensitivity(hist: DataFrame, rung: Column | None = None) -> DataFrame:
    """The chosen pair under each scenario at the given rung; the histogram is priced ten times, the book never.

    Without a rung it is the strictest that has a pair. Rungs count accounts and never
    cost, so that is the same one in every scenario and in the unmoved case.
    """
    scenarios = scenario_params()
    fields = list(scenarios[0])
    rows = F.explode(F.array(*[F.struct(*[F.lit(s[f]).alias(f) for f in fields]) for s in scenarios]))
    spread = hist.withColumn("s", rows)
    params = SimpleNamespace(**{f: F.col(f"s.{f}") for f in CostParams.__dataclass_fields__})
    keyed = spread.withColumns({k: F.col(f"s.{k}") for k in ("param", "change", "value")})
    keys = ("param", "change", "value")
    by_band = band_costs(F.col("n"), F.col("ead"), F.col("ead_bad"), lgd(F.col("secured"), params), params)
    cells = keyed.withColumns(by_band).groupBy(*keys, "portfolio", "score").agg(*[F.sum(c).alias(c) for c in SUMS])
    grid = cost_grid(cut_table(hist, cells, keys), keys)
    return pick(grid, keys, rung).select(*keys, "amber", "red")


def choose(hist: DataFrame, current: tuple[float, float]) -> DataFrame:
    """The operating point: chosen, unconstrained and current pair with the differences.

    Falls back to the current pair when no candidate pair bands the book.
    """
    cells = priced(hist)
    grid = cost_grid(cut_table(hist, cells))
    best, free = pick(grid), pick(grid, rung=F.lit(len(LEVELS)))
    amber = F.coalesce(best.select("amber").scalar(), F.lit(current[0]))
    red = F.coalesce(best.select("red").scalar(), F.lit(current[1]))
    chosen = evaluate(cells, amber, red).withColumn("role", F.lit("chosen"))
    now = evaluate(cells, *current).withColumn("role", F.lit("current"))
    unbound = evaluate(cells, free.select("amber").scalar(), free.select("red").scalar()).where(
        F.col("amber").isNotNull()).withColumn("role", F.lit("unconstrained"))
    return chosen.unionByName(now).unionByName(unbound)


def choice_deltas(roles: DataFrame) -> DataFrame:
    """What the choice saves against the current pair and what the constraints cost."""
    def at(role: str, c: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(c)))

    saved = at("current", "cost") - at("chosen", "cost")
    return roles.agg(
        saved.alias("cost_saved"), F.coalesce(F.try_divide(saved, at("current", "cost")), F.lit(0.0)).alias("cost_saved_share"),
        (at("chosen", "missed_share") - at("current", "missed_share")).alias("missed_share_change"),
        (at("chosen", "red_precision") - at("current", "red_precision")).alias("red_precision_change"),
        (at("chosen", "cost") - at("unconstrained", "cost")).alias("constraint_cost"))


def fold_cost_in_crore(roles: DataFrame) -> DataFrame:
    """Expected cost of the chosen and the current pair on the same fold, in crore."""
    def at(role: str, c: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col(c)))

    return roles.agg(at("chosen", "n").alias("n_accounts"), (at("chosen", "cost") / RUPEES_PER_CRORE).alias("chosen_crore"),
                     (at("current", "cost") / RUPEES_PER_CRORE).alias("current_crore"))


def error_costs(mix: DataFrame, p: CostParams | None = None) -> DataFrame:
    """Account-weighted cost of a missed NPA, of a false Red, and their ratio, from :func:`cost_mix`."""
    p = p or CostParams()
    weight = F.sum("n")
    missed = F.sum(F.col("loss_mean") * F.col("n")) / weight
    exposure = F.sum(F.col("ead_mean") * F.col("n")) / weight
    false_red = p.review_cost_red_inr + exposure * p.effective_rate_pa / 100.0 * p.friction_share_red
    return mix.agg(missed.alias("missed_cost"), false_red.alias("false_positive_cost"), F.try_divide(missed, false_red).alias("ratio"))


def operating_pair(best: DataFrame, current: tuple[float, float], keep_legacy: bool = False) -> DataFrame:
    """The pair that goes live and why: cost, fallback or legacy."""
    found = best.agg(F.max("amber").alias("a"), F.max("red").alias("r"))
    if keep_legacy:
        return found.select(F.lit(current[0]).alias("amber"), F.lit(current[1]).alias("red"), F.lit("legacy").alias("applied"))
    ok = F.col("a").isNotNull()
    return found.select(F.coalesce("a", F.lit(current[0])).alias("amber"), F.coalesce("r", F.lit(current[1])).alias("red"),
                        F.when(ok, "cost_minimising").otherwise("legacy_fallback").alias("applied"))
