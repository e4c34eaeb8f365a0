"""Cut-off search, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from amberline.config import CostParams, candidate_fractions
from amberline.operators import aggregates, splits, thresholds
from amberline.operators.labels import snapshot
from amberline.plans.registry import Tables, query
from amberline.plans.summaries import _rounded

CURRENT = (0.04, 0.40)
PROBS = "[" + ", ".join(repr(1.0 - f) for f in candidate_fractions()) + "]"


def _book(t: Tables):
    """The policy book: the reference quarter, one account in eleven with an unknown security flag."""
    secured = F.when(F.col("account_id") % 11 != 0, F.col("secured"))
    return t.book().withColumn("ead", F.col("sanctioned")).withColumn("secured", secured)


def grid_sql(lgd_unsecured=0.75, months=6.0, cure_red=0.35, review_red=18000.0, friction_red=0.15, name="") -> str:
    """Brute-force pricing of every pair on the policy book (score = fine_score)."""
    p = name
    return f"""{p}bk AS (SELECT portfolio, fine_score AS s, went_bad::DOUBLE AS y, sanctioned AS ead,
 sanctioned * (CASE WHEN account_id % 11 = 0 THEN (0.4 + {lgd_unsecured}) / 2 WHEN secured > 0.5 THEN 0.4::DOUBLE ELSE {lgd_unsecured} END + 14.75 / 100 * {months} / 12) AS el FROM book),
{p}co AS (SELECT portfolio, s, y, ead, y * el AS g, 1500 + (1 - y) * 0.02 * 0.1275 * ead + y * el * 0.9 AS a,
 {review_red} + (1 - y) * {friction_red} * 0.1275 * ead + y * el * (1 - {cure_red}) AS r FROM {p}bk),
{p}q AS (SELECT DISTINCT round(t, 6) AS t FROM (SELECT unnest(quantile_cont(s, {PROBS})) AS t FROM {p}co)),
{p}k AS (SELECT t, count(*) FILTER (s >= t) AS k, count(*) AS n FROM {p}q, {p}co GROUP BY t),
{p}cut AS (SELECT max(t) AS t, k FROM {p}k WHERE k >= 1 AND k < n GROUP BY k),
{p}pl AS (SELECT DISTINCT portfolio AS pf FROM {p}co UNION ALL SELECT '__pooled__'),
{p}pc AS (SELECT pf, t, max(k) AS k, count(*) FILTER (s >= t)::DOUBLE AS n, sum(y) FILTER (s >= t) AS bad, sum(g) FILTER (s >= t) AS g, sum(a) FILTER (s >= t) AS a, sum(r) FILTER (s >= t) AS r,
 count(*)::DOUBLE AS nn, sum(y) AS bb, sum(g) AS gg FROM {p}pl JOIN {p}co ON pf = '__pooled__' OR pf = portfolio CROSS JOIN {p}cut GROUP BY 1, 2),
{p}z AS (SELECT pf, t, k, n, coalesce(bad, 0) AS bad, coalesce(g, 0) AS g, coalesce(a, 0) AS a, coalesce(r, 0) AS r, nn, bb, gg FROM {p}pc),
{p}pr AS (SELECT x.pf, x.t AS amber, v.t AS red, v.r + (x.a - v.a) + (x.gg - x.g) AS cost, x.n AS n_flagged, v.n AS n_red, x.bad AS bad_flagged, v.bad AS bad_red, x.bb AS bad_all,
 CASE WHEN x.nn > x.n THEN (x.bb - x.bad) / (x.nn - x.n) ELSE 0 END AS rg, CASE WHEN x.n > v.n THEN (x.bad - v.bad) / (x.n - v.n) ELSE 0 END AS ra,
 CASE WHEN v.n > 0 THEN v.bad / v.n ELSE 0 END AS rr FROM {p}z x JOIN {p}z v ON x.pf = v.pf AND x.t < v.t),
{p}cg AS (SELECT amber, red, max(cost) FILTER (pf = '__pooled__') AS cost, max(n_flagged) FILTER (pf = '__pooled__') AS n_flagged, max(n_red) FILTER (pf = '__pooled__') AS n_red,
 max(bad_flagged) FILTER (pf = '__pooled__') AS bad_flagged, max(bad_red) FILTER (pf = '__pooled__') AS bad_red, max(bad_all) FILTER (pf = '__pooled__') AS bad_all,
 CASE WHEN bool_and(rg < ra AND ra < rr) AND bool_and(n_red >= 1) THEN 1 WHEN bool_and(rg < ra AND ra < rr) THEN 2
 WHEN bool_or(pf = '__pooled__' AND rg < ra AND ra < rr) THEN 3 ELSE 4 END AS rung FROM {p}pr GROUP BY 1, 2)"""


GRID_SQL = grid_sql()
PICK_SQL = f"""{GRID_SQL}, best AS (SELECT * FROM cg ORDER BY rung, cost, amber DESC, red DESC LIMIT 1),
free AS (SELECT * FROM cg ORDER BY cost, amber DESC, red DESC LIMIT 1)"""


def _hist(t: Tables):
    return thresholds.cost_histogram(_book(t), "fine_score")


def _grid(t: Tables):
    return thresholds.cost_grid(thresholds.cut_table(_hist(t)))


@query("th01_candidate_cuts", f"WITH {GRID_SQL} SELECT t AS cut FROM cut")
def candidate_cuts(t: Tables):
    hist = _hist(t)
    return hist.groupBy().agg(F.first(thresholds.candidate_cuts(hist)).alias("c")).select(F.explode("c").alias("cut"))


@query("th02_cost_grid", f"WITH {GRID_SQL} SELECT amber, red, round(cost, 0) AS cost, n_flagged::BIGINT AS n_flagged, n_red::BIGINT AS n_red, bad_flagged::BIGINT AS bad_flagged, bad_red::BIGINT AS bad_red, bad_all::BIGINT AS bad_all, rung FROM cg")
def cost_grid(t: Tables):
    return _rounded(_grid(t), 0, "cost")


@query("jn16_pairs_of_cuts", f"WITH {GRID_SQL} SELECT a.t AS amber, r.t AS red FROM cut a JOIN cut r ON a.k > r.k")
def pairs_of_cuts(t: Tables):
    return _grid(t).select("amber", "red")


@query("th03_feasibility_ladder", f"""
WITH {GRID_SQL} SELECT l AS level, count(*) FILTER (rung <= o) AS pairs FROM cg, (VALUES ('all_constraints', 1), ('portfolio_monotone', 2), ('pooled_monotone', 3), ('non_empty', 4)) v(l, o) GROUP BY 1""")
def feasibility_ladder(t: Tables):
    return thresholds.feasible_counts(_grid(t))


@query("th04_pick", f"WITH {PICK_SQL} SELECT amber, red, rung, round(cost, 0) AS cost, n_flagged::BIGINT AS n_flagged, n_red::BIGINT AS n_red FROM best")
def pick(t: Tables):
    return _rounded(thresholds.pick(_grid(t)), 0, "cost")


def _evaluate_sql(pairs: str) -> str:
    """CTE ``ev``: everything each (role, amber, red) pair implies on the policy book."""
    mono = "coalesce(bg / nullif(ng, 0), 0) < coalesce(ba / nullif(na, 0), 0) AND coalesce(ba / nullif(na, 0), 0) < coalesce(br / nullif(nr, 0), 0)"
    return f"""prs AS ({pairs}),
pf AS (SELECT role, amber, red, portfolio, count(*) FILTER (s < amber) AS ng, count(*) FILTER (s >= amber AND s < red) AS na, count(*) FILTER (s >= red) AS nr,
 coalesce(sum(y) FILTER (s < amber), 0) AS bg, coalesce(sum(y) FILTER (s >= amber AND s < red), 0) AS ba, coalesce(sum(y) FILTER (s >= red), 0) AS br,
 sum(CASE WHEN s >= red THEN r WHEN s >= amber THEN a ELSE g END) AS c, coalesce(sum(ead) FILTER (s >= amber), 0) AS ex FROM prs, co GROUP BY 1, 2, 3, 4),
tt AS (SELECT role, amber, red, sum(ng) AS ng, sum(na) AS na, sum(nr) AS nr, sum(bg) AS bg, sum(ba) AS ba, sum(br) AS br, sum(c) AS c, sum(ex) AS ex, bool_and({mono}) AS each, bool_and(nr >= 1) AS reds FROM pf GROUP BY 1, 2, 3),
ev AS (SELECT role, amber, red, CASE WHEN ng > 0 AND na > 0 AND nr > 0 THEN CASE WHEN {mono} AND each AND reds THEN 1 WHEN {mono} AND each THEN 2 WHEN {mono} THEN 3 ELSE 4 END END AS rung,
 round(c, 0) AS cost, round(c / (ng + na + nr), 2) AS cost_per_account, (ng + na + nr)::BIGINT AS n, (bg + ba + br)::BIGINT AS n_bad, ng::BIGINT AS n_green, na::BIGINT AS n_amber, nr::BIGINT AS n_red,
 round(coalesce(br / nullif(nr, 0), 0), 6) AS red_precision, round(coalesce(ba / nullif(na, 0), 0), 6) AS amber_precision, round(bg / (bg + ba + br), 6) AS missed_share,
 round((na + nr) / (ng + na + nr), 6) AS flagged_share, round(br / (bg + ba + br), 6) AS recall_red, round((ba + br) / (bg + ba + br), 6) AS recall_flagged, round(ex, 1) AS exposure_flagged FROM tt)"""


def _evaluated(df):
    df = _rounded(df, 6, "red_precision", "amber_precision", "missed_share", "flagged_share", "recall_red", "recall_flagged")
    return _rounded(_rounded(_rounded(df, 0, "cost"), 2, "cost_per_account"), 1, "exposure_flagged")


@query("th05_evaluate", f"WITH {GRID_SQL}, {_evaluate_sql('SELECT 1 AS role, 0.3::DOUBLE AS amber, 0.5::DOUBLE AS red')} SELECT * EXCLUDE (role) FROM ev")
def evaluate(t: Tables):
    return _evaluated(thresholds.evaluate(thresholds.priced(_hist(t)), 0.3, 0.5))


@query("th06_alternatives", f"""
WITH {PICK_SQL}, d AS (SELECT round(g.amber, 4) AS amber, round(g.red, 4) AS red, min(g.cost) AS cost, arg_min(g.n_red, g.cost) AS n_red, arg_min(g.n_flagged, g.cost) AS n_flagged
 FROM cg g, best WHERE g.rung <= best.rung GROUP BY 1, 2)
SELECT amber, red, round(cost, 0) AS cost, n_red::BIGINT AS n_red, n_flagged::BIGINT AS n_flagged FROM d ORDER BY d.cost, amber DESC, red DESC LIMIT 6""")
def alternatives(t: Tables):
    grid = _grid(t)
    rung = thresholds.pick(grid).select("rung").scalar()
    return _rounded(thresholds.alternatives(grid, rung), 0, "cost")


@query("th06b_cost_curve", f"""
WITH {PICK_SQL}, s AS (SELECT 'red' AS sweep, g.red AS cut, g.cost, g.n_red AS n, g.bad_red AS bad, g.bad_all FROM cg g, best WHERE g.amber = best.amber
 UNION ALL SELECT 'amber', g.amber, g.cost, g.n_flagged, g.bad_flagged, g.bad_all FROM cg g, best WHERE g.red = best.red)
SELECT sweep, cut, round(cost, 0) AS cost, n::BIGINT AS n, bad::BIGINT AS bad, (bad_all - bad)::BIGINT AS bad_outside, (n - bad)::BIGINT AS false_positives FROM s""")
def cost_curve(t: Tables):
    grid = _grid(t)
    return _rounded(thresholds.cost_curve(grid, thresholds.pick(grid)), 0, "cost")


SWEEPS = (("cure_share_red", dict(cure_red=0.175), dict(cure_red=0.525)), ("review_cost_red_inr", dict(review_red=9000.0), dict(review_red=27000.0)),
          ("lgd_unsecured", dict(lgd_unsecured=0.375), dict(lgd_unsecured=1.125)), ("friction_share_red", dict(friction_red=0.075), dict(friction_red=0.225)),
          ("income_reversal_months", dict(months=3.0), dict(months=9.0)))
SENSITIVITY_SQL = ", ".join(grid_sql(**kw, name=f"s{i}{j}") for i, (_, *both) in enumerate(SWEEPS) for j, kw in enumerate(both))
SENSITIVITY_PICKS = " UNION ALL ".join(
    f"(SELECT '{name}' AS param, '{'x0.5' if j == 0 else 'x1.5'}' AS change, {list(kw.values())[0]}::DOUBLE AS value, s{i}{j}cg.amber, s{i}{j}cg.red FROM s{i}{j}cg, best "
    f"WHERE s{i}{j}cg.rung <= best.rung ORDER BY s{i}{j}cg.cost, s{i}{j}cg.amber DESC, s{i}{j}cg.red DESC LIMIT 1)"
    for i, (name, *both) in enumerate(SWEEPS) for j, kw in enumerate(both))


@query("th07_sensitivity", f"WITH {PICK_SQL}, {SENSITIVITY_SQL} {SENSITIVITY_PICKS}")
def sensitivity(t: Tables):
    return _rounded(thresholds.sensitivity(_hist(t)), 4, "value")


ROLES_SQL = f"""{PICK_SQL}, {_evaluate_sql("SELECT 'chosen' AS role, amber, red FROM best UNION ALL SELECT 'unconstrained', amber, red FROM free UNION ALL SELECT 'current', 0.04, 0.40")},
roles AS (SELECT * FROM ev)"""


@query("th08_choose", f"WITH {ROLES_SQL} SELECT * FROM roles")
def choose(t: Tables):
    return _evaluated(thresholds.choose(_hist(t), CURRENT))


@query("th08b_choice_deltas", f"""
WITH {ROLES_SQL}, c AS (SELECT max(cost) FILTER (role = 'current') AS n, max(cost) FILTER (role = 'chosen') AS c, max(cost) FILTER (role = 'unconstrained') AS u,
 max(missed_share) FILTER (role = 'chosen') - max(missed_share) FILTER (role = 'current') AS m, max(red_precision) FILTER (role = 'chosen') - max(red_precision) FILTER (role = 'current') AS p FROM roles)
SELECT n - c AS cost_saved, round((n - c) / n, 6) AS cost_saved_share, round(m, 5) AS missed_share_change, round(p, 5) AS red_precision_change, c - u AS constraint_cost FROM c""")
def choice_deltas(t: Tables):
    roles = _evaluated(thresholds.choose(_hist(t), CURRENT))
    return _rounded(_rounded(thresholds.choice_deltas(roles), 6, "cost_saved_share"), 5, "missed_share_change", "red_precision_change")


@query("th09_fold_cost", f"""
WITH {ROLES_SQL} SELECT max(n) FILTER (role = 'chosen') AS n_accounts, round(max(cost) FILTER (role = 'chosen') / 1e7, 4) AS chosen_crore,
 round(max(cost) FILTER (role = 'current') / 1e7, 4) AS current_crore FROM roles""")
def fold_cost(t: Tables):
    return _rounded(thresholds.fold_cost_in_crore(_evaluated(thresholds.choose(_hist(t), CURRENT))), 4, "chosen_crore", "current_crore")


@query("th09b_error_costs", """
WITH b AS (SELECT sanctioned AS e, sanctioned * (CASE WHEN account_id % 11 = 0 THEN 0.575 WHEN secured > 0.5 THEN 0.4::DOUBLE ELSE 0.75 END + 0.07375) AS l FROM book)
SELECT round(avg(l), 1) AS missed_cost, round(18000 + avg(e) * 0.1275 * 0.15, 1) AS false_positive_cost, round(avg(l) / (18000 + avg(e) * 0.1275 * 0.15), 6) AS ratio FROM b""")
def error_costs(t: Tables):
    out = thresholds.error_costs(aggregates.cost_mix(_book(t), CostParams()))
    return _rounded(_rounded(out, 1, "missed_cost", "false_positive_cost"), 6, "ratio")


POLICY = "('0x' || substr(md5(account_id::VARCHAR || 'policy'), 1, 8))::BIGINT % 1000"
TEST = "('0x' || substr(md5(account_id::VARCHAR), 1, 8))::BIGINT % 1000"
FOLD_SQL = f"CASE WHEN {TEST} < 300 THEN 'test' WHEN {POLICY} < 300 THEN 'policy' ELSE 'fit' END"


@query("th10_operating_thresholds", f"""
WITH {PICK_SQL.replace("FROM book)", f"FROM book WHERE {FOLD_SQL} = 'policy')", 1)} SELECT amber, red, 'cost_minimising' AS applied FROM best""")
def operating_thresholds(t: Tables):
    policy = _book(t).where(splits.three_way_split(F.col("account_id")) == "policy")
    hist = thresholds.cost_histogram(policy, "fine_score")
    return thresholds.operating_pair(thresholds.pick(thresholds.cost_grid(thresholds.cut_table(hist))), CURRENT)


# ---- splits and samples ----------------------------------------------------

@query("sp01_group_split", f"SELECT account_id, CASE WHEN {TEST} < 300 THEN 'test' ELSE 'train' END AS side FROM acc")
def group_split(t: Tables):
    return t.accounts().select("account_id", splits.group_split(F.col("account_id")).alias("side"))


@query("sp02_three_way_split", f"SELECT account_id, {FOLD_SQL} AS fold FROM acc")
def three_way_split(t: Tables):
    return t.accounts().select("account_id", splits.three_way_split(F.col("account_id")).alias("fold"))


@query("sp03_out_of_time_split", """
SELECT account_id, period, CASE WHEN period >= cut THEN 'test' ELSE 'train' END AS side FROM eligible, (SELECT periods - 8 AS cut FROM bounds) WHERE period >= cut OR period + 4 <= cut""")
def out_of_time_split(t: Tables):
    return splits.out_of_time(t.eligible(), t.quarters().periods, 4).select("account_id", "period", "side")


@query("sp03b_out_of_time_fixed_cut", """
SELECT side, count(*) AS n, sum(went_bad)::BIGINT AS bad FROM (SELECT went_bad, CASE WHEN period >= 12 THEN 'test' WHEN period + 4 <= 12 THEN 'train' END AS side FROM eligible) WHERE side IS NOT NULL GROUP BY 1""")
def out_of_time_fixed_cut(t: Tables):
    return splits.out_of_time(t.eligible(), t.quarters().periods, 4, cut=12).groupBy("side").agg(F.count("*").alias("n"), F.sum("went_bad").alias("bad"))


SAMPLE_HASH = "md5(account_id::VARCHAR || '|sample')"


@query("sp05_stratified_sample", f"""
WITH c AS (SELECT portfolio, band, count(*) AS n FROM book GROUP BY 1, 2), e AS (SELECT *, n * 300 / (SELECT sum(n) FROM c) AS x FROM c),
b AS (SELECT *, floor(x) AS base, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, portfolio, band) AS rk FROM e),
a AS (SELECT portfolio, band, least(base + CASE WHEN rk <= 300 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END, n) AS take FROM b),
r AS (SELECT account_id, portfolio, band, row_number() OVER (PARTITION BY portfolio, band ORDER BY {SAMPLE_HASH}) AS rn FROM book)
SELECT account_id, r.portfolio, r.band FROM r JOIN a USING (portfolio, band) WHERE rn <= take OR account_id % 100 = 7""")
def stratified_sample(t: Tables):
    book = t.stored(t.book(), "account_id", "portfolio", "band")
    return splits.stratified_sample(book, 300, ("portfolio", "band"), book.where(F.col("account_id") % 100 == 7))


@query("sp06_replenish", """
WITH lv AS (SELECT account_id, period, vintage_months // 12 AS lv FROM panel), w AS (SELECT lv, count(*) / sum(count(*)) OVER () AS s FROM lv WHERE period < 8 GROUP BY 1),
h AS (SELECT lv, count(*) AS have FROM lv WHERE period BETWEEN 10 AND 15 GROUP BY 1), m AS (SELECT lv, s, have, min(have / s) OVER () AS scale FROM w JOIN h USING (lv)),
tk AS (SELECT lv, least(round_even(s * scale, 0), have) AS take FROM m),
r AS (SELECT account_id, period, lv, row_number() OVER (PARTITION BY lv ORDER BY md5(account_id::VARCHAR || '|' || period::VARCHAR || '|replenish')) AS rn FROM lv WHERE period BETWEEN 10 AND 15)
SELECT account_id, period, lv AS age_year FROM r JOIN tk USING (lv) WHERE rn <= take""")
def replenish(t: Tables):
    rows = t.panel().withColumn("age_year", F.floor(F.col("vintage_months") / 12))
    rows = t.stored(rows, "account_id", "period", "age_year")
    return splits.replenish(rows.where(F.col("period") < 8), rows.where(F.col("period").between(10, 15)), "age_year", ("account_id", "period")) \
        .select("account_id", "period", "age_year")


@query("sp07_account_sample", """
SELECT account_id, period FROM panel WHERE account_id IN (SELECT account_id FROM acc ORDER BY md5(account_id::VARCHAR || '|accounts') LIMIT 200)""")
def account_sample(t: Tables):
    return splits.account_sample(t.panel(), 200).select("account_id", "period")


@query("sp08_oversample_positives", """
SELECT account_id, period, went_bad, unnest(CASE WHEN went_bad = 1 THEN [1, 2, 3] ELSE [1] END) AS copy FROM eligible""")
def oversample_positives(t: Tables):
    return splits.oversample_positives(t.eligible(), 3).select("account_id", "period", "went_bad", "copy")


@query("sp09_permute_labels", """
WITH l AS (SELECT went_bad, row_number() OVER (ORDER BY md5(account_id::VARCHAR || '|' || period::VARCHAR || '|permute')) AS rn FROM eligible),
r AS (SELECT account_id, period, row_number() OVER (ORDER BY md5(account_id::VARCHAR || '|' || period::VARCHAR || '|permute-rows')) AS rn FROM eligible)
SELECT account_id, period, went_bad FROM r JOIN l USING (rn)""")
def permute_labels(t: Tables):
    rows = t.eligible().select("account_id", "period", "went_bad")
    return splits.permute_labels(rows, ("account_id", "period"))


@query("fl03b_snapshot_at_reference", "SELECT account_id, period FROM panel WHERE period = 16")
def snapshot_at_reference(t: Tables):
    return snapshot(t.panel(), 16).select("account_id", "period")
