"""Evaluation measures against brute force, with heavy ties and hot groups."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from amberline.config import BANDS, CostParams, candidate_fractions
from amberline.operators import bootstrap, calibration, drift, gates, graph, histogram, model, provenance, quantiles, ranking, splits, thresholds


def scored(spark, n=400, seed=1, hot=True):
    """Rows where a third share one score, so every boundary meets ties."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = 0.25 if hot and i % 3 == 0 else round(rng.random(), 2)
        rows.append((i, i % 4, s, int(rng.random() < s * 0.6), "AB"[i % 2]))
    return rows, spark.createDataFrame(rows, "account_id int, period int, decision_score double, went_bad int, portfolio string")


def pairwise_auc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def test_auc_matches_all_pairs_and_flips_with_the_score(spark):
    rows, df = scored(spark)
    s, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    got = histogram.rank_metrics(histogram.score_histogram(df)).first()
    flipped = histogram.rank_metrics(histogram.score_histogram(df.withColumn("decision_score", 1 - F.col("decision_score")))).first()
    assert got.auc == pytest.approx(pairwise_auc(s, y)) and flipped.auc == pytest.approx(1 - got.auc)
    cuts = np.unique(s)
    assert got.ks == pytest.approx(max((s[y == 1] >= c).mean() - (s[y == 0] >= c).mean() for c in cuts))


def test_one_class_has_no_auc(spark):
    _, df = scored(spark, 20)
    got = histogram.rank_metrics(histogram.score_histogram(df.withColumn("went_bad", F.lit(0)))).first()
    assert got.auc is None and got.ks is None
    assert model.isotonic_map(df.withColumn("went_bad", F.lit(0))) is None


def tie(r):
    return hashlib.md5(f"{r[0]}|{r[1]}".encode()).hexdigest()


def test_deciles_are_the_integer_slices_even_inside_a_hot_score(spark):
    for n in (11, 97, 400):
        rows, df = scored(spark, n, seed=n)
        order = sorted(rows, key=lambda r: (r[2], tie(r)))
        want = []
        for i in range(10):
            part = order[int(i * n / 10):int((i + 1) * n / 10)]
            want.append((i + 1, len(part), sum(r[3] for r in part)))
        got = [(r.decile, r.n, r.k) for r in ranking.deciles(df, ("account_id", "period")).orderBy("decile").collect()]
        assert got == [w for w in want if w[1]]


def test_budget_is_floored_by_row_and_rounded_by_account(spark):
    rows, df = scored(spark, 95)
    order = sorted(rows, key=lambda r: (-r[2], tie(r)))
    for book, k in ((False, 9), (True, 10)):
        got = ranking.recall_at_budgets(df, (0.10,), ("account_id", "period"), book_grain=book).first()
        assert (got.n_reviewed, got.n_caught) == (k, sum(r[3] for r in order[:k]))


def test_exact_quantiles_with_outliers_and_ties(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=300), np.full(150, 0.5), [1e12, -1e9]])
    df = spark.createDataFrame([(float(v), "g") for v in x], "x double, g string")
    probs = (0.0, 0.1, 0.37, 0.5, 0.9, 1.0)
    got = {r.prob: r.value for r in quantiles.exact_quantiles(df, "x", probs, ("g",)).collect()}
    assert [got[p] for p in probs] == pytest.approx(list(np.quantile(x, probs)))


def test_three_calibration_rules(spark):
    rows, df = scored(spark, 300)
    s, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows], dtype=float)

    def gap(idx):
        return sum((idx == b).mean() * abs(s[idx == b].mean() - y[idx == b].mean()) for b in set(idx))

    hist = histogram.score_histogram(df)
    wide = np.clip(np.digitize(s, np.array([i / 10 for i in range(1, 10)]), right=True), 0, 9)
    edges = np.unique(np.quantile(s, np.linspace(0, 1, 11)))
    count = np.clip(np.searchsorted(edges, s, side="right") - 1, 0, len(edges) - 2)
    assert calibration.ece_equal_width(hist).first().ece == pytest.approx(gap(wide))
    assert calibration.ece_equal_count(hist).first().ece == pytest.approx(gap(count))
    assert calibration.brier(hist).first().brier == pytest.approx(((s - y) ** 2).mean())


def test_recalibration_recovers_a_known_slope(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.uniform(0.05, 0.95, 4000), 3)
    true = 1 / (1 + np.exp(-(0.3 + 0.5 * np.log(p / (1 - p)))))
    y = (rng.random(4000) < true).astype(int)
    df = spark.createDataFrame([(int(i // 4), float(a), int(b)) for i, (a, b) in enumerate(zip(p, y))], "account_id int, decision_score double, went_bad int")
    got = calibration.cox_calibration(df).first()
    assert got.slope_lo < 0.5 < got.slope_hi < 1 and got.intercept_lo < 0.3 < got.intercept_hi and got.n_clusters == 1000


def test_stability_index(spark):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(size=500), 3), np.round(rng.normal(0.7, 1.2, 400), 3)
    df = spark.createDataFrame([(True, float(v)) for v in a] + [(False, float(v)) for v in b], "e boolean, x double")
    edges = np.unique(np.quantile(a, np.linspace(0, 1, 11)))
    edges[0], edges[-1] = -np.inf, np.inf
    e, c = (np.clip(np.histogram(v, edges)[0] / len(v), 1e-6, None) for v in (a, b))
    assert drift.psi(df, F.col("e"), "x").first().psi == pytest.approx(((c - e) * np.log(c / e)).sum())
    same = df.where("e").unionByName(df.where("e").withColumn("e", F.lit(False)))
    assert drift.psi(same, F.col("e"), "x").first().psi == pytest.approx(0.0)


def test_a_level_without_test_rows_costs_the_floor_term(spark):
    df = spark.createDataFrame([(True, "u")] * 3 + [(True, "v")] + [(False, "u")] * 4, "e boolean, f string")
    want = (1 - 0.75) * np.log(1 / 0.75) + (1e-6 - 0.25) * np.log(1e-6 / 0.25)
    assert drift.categorical_csi(df, F.col("e"), ("f",)).first().csi == pytest.approx(want)


def test_bootstrap_interval_covers_the_estimate_and_pairs_draws(spark):
    rows, df = scored(spark, 600)
    s, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    got = bootstrap.auc_interval(df, "decision_score", 60).first()
    assert got.lo < pairwise_auc(s, y) < got.hi and got.replicates == 60
    same = bootstrap.paired_delta_interval(df.withColumn("copy", F.col("decision_score")), "decision_score", "copy", 8)
    assert all(abs(r.lo) < 1e-12 and abs(r.hi) < 1e-12 for r in same.collect())


@pytest.mark.parametrize("split", [1_000_000, 7])
def test_draws_as_columns_equal_rows_repeated_by_draw(spark, monkeypatch, split):
    """Every draw's AUC and Brier against repeated rows; buckets dealt on by account give the same."""
    monkeypatch.setattr(bootstrap, "SPLIT_ROWS", split)
    rng = random.Random(3)
    rows = [(i % 40, "ab"[i % 3 == 0], rng.choice([0.2, 0.2004, 0.5, 0.7, 1.0, 0.0]), rng.random(), int(rng.random() < 0.3)) for i in range(300)]
    df = spark.createDataFrame(rows, "account_id long, part string, p double, q double, went_bad int")
    got = {(r.replicate, r.model, r.part): r for r in bootstrap.replicate_metrics(df, ("p", "q"), 20, groups=("part",)).collect()}
    weights = bootstrap.Weights(20)
    for model, at in (("p", 2), ("q", 3)):
        for part in "ab":
            for draw in (0, 7, 8, 19):
                own = [(round(r[at], 6), r[4]) for r in rows if r[1] == part for _ in range(weights[str(r[0])][draw])]
                s, y = np.array(own).T
                r = got[draw + 1, model, part]
                assert (r.n, r.n_bad) == (len(own), y.sum()) and r.auc == pytest.approx(pairwise_auc(s, y)) and r.brier == pytest.approx(((s - y) ** 2).mean())
    deciles = {(r.replicate, r.decile): r for r in bootstrap.replicate_deciles(df.where("part = 'b'"), "q", 20).collect()}
    own = sorted((round(r[3], 6), r[4]) for r in rows if r[1] == "b" for _ in range(weights[str(r[0])][5]))
    for k in range(10):
        lo, hi = k * len(own) // 10, (k + 1) * len(own) // 10
        assert deciles[6, k].n == hi - lo and abs(deciles[6, k].bad - sum(y for _, y in own[lo:hi])) < 8


def book(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = round(min(0.99, rng.random() ** 2), 3)
        rows.append((i, "PQ"[i % 2], None if i % 9 == 0 else i % 2, s, int(rng.random() < s ** 1.5), rng.randint(1, 50) * 1e5))
    return rows, spark.createDataFrame(rows, "account_id int, portfolio string, secured int, decision_score double, went_bad int, ead double")


def brute_force_pick(rows):
    """Cheapest admissible pair by pricing every account under every pair."""
    p = CostParams()
    s, y, ead = (np.array([r[i] for r in rows], dtype=float) for i in (3, 4, 5))
    lgd = np.array([0.575 if r[2] is None else 0.4 if r[2] else 0.75 for r in rows])
    loss = ead * lgd + ead * 14.75 / 100 * 0.5
    interest = ead * 0.1275
    cost = {"green": y * loss, "amber": p.review_cost_amber_inr + (1 - y) * 0.02 * interest + y * loss * 0.9,
            "red": p.review_cost_red_inr + (1 - y) * 0.15 * interest + y * loss * 0.65}
    cuts, seen = [], set()
    for f in candidate_fractions():
        t = round(float(np.quantile(s, 1 - f)), 6)
        k = int((s >= t).sum())
        if 1 <= k < len(s) and k not in seen:
            seen.add(k)
            cuts.append(t)
    groups = [np.ones(len(s), bool)] + [np.array([r[1] == g for r in rows]) for g in "PQ"]
    best = None
    for a in cuts:
        for r in cuts:
            if (s >= a).sum() <= (s >= r).sum():
                continue
            band = np.where(s >= r, "red", np.where(s >= a, "amber", "green"))
            rates = [[y[(band == b) & g].mean() if ((band == b) & g).any() else 0.0 for b in BANDS] for g in groups]
            mono = [q[0] < q[1] < q[2] for q in rates]
            reds = all(((band == "red") & g).any() for g in groups)
            rung = 1 if all(mono) and reds else 2 if all(mono) else 3 if mono[0] else 4
            key = (rung, sum(cost[b][band == b].sum() for b in BANDS), -a, -r)
            if best is None or key < best[0]:
                best = (key, a, r)
    return best


@pytest.mark.parametrize("seed", [1, 2])
def test_chosen_pair_is_the_cheapest_admissible_one(spark, seed):
    rows, df = book(spark, 260, seed)
    hist = thresholds.cost_histogram(df)
    got = thresholds.pick(thresholds.cost_grid(thresholds.cut_table(hist))).first()
    (rung, cost, *_), amber, red = brute_force_pick(rows)
    assert (got.amber, got.red, got.rung) == (amber, red, rung) and got.cost == pytest.approx(cost)


def test_a_book_too_thin_to_band_falls_back(spark):
    df = spark.createDataFrame([(1, "P", 1, 0.5, 1, 1e5), (2, "P", 1, 0.5, 0, 1e5)],
                               "account_id int, portfolio string, secured int, decision_score double, went_bad int, ead double")
    hist = thresholds.cost_histogram(df)
    best = thresholds.pick(thresholds.cost_grid(thresholds.cut_table(hist)))
    got = thresholds.operating_pair(best, (0.04, 0.40)).first()
    assert tuple(got) == (0.04, 0.40, "legacy_fallback")
    assert [r.role for r in thresholds.choose(hist, (0.04, 0.40)).collect()].count("chosen") == 1


def test_isotonic_map_is_monotone_and_keeps_the_mean(spark):
    rows, df = scored(spark, 500)
    points = model.isotonic_map(df)
    predictions = [r.prediction for r in points.orderBy("boundary").collect()]
    assert predictions == sorted(predictions)
    mapped = calibration.apply_map_table(df, points, "decision_score", "c")
    assert mapped.columns == [*df.columns, "c"] and mapped.count() == len(rows)
    assert mapped.agg(F.avg("c")).first()[0] == pytest.approx(np.mean([r[3] for r in rows]))
    ends = spark.range(1).select(*[calibration.apply_map(F.lit(x), F.array(F.lit(0.2), F.lit(0.4)), F.array(F.lit(0.0), F.lit(1.0))) for x in (0.0, 0.3, 0.9)])
    assert list(ends.first()) == pytest.approx([0.0, 0.5, 1.0])


def test_a_map_of_a_million_points_is_looked_up_by_ranges(spark):
    points = spark.range(1_000_000).select((F.col("id") / 1e6).alias("boundary"), (F.col("id") / 1e6 * F.col("id") / 1e6).alias("prediction"))
    x = [-1.0, 0.0, 1e-7, 0.25, 0.3333337, 0.9999985, 0.999999, 2.0, None]
    scores = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, score double")
    got = [r.calibrated for r in calibration.apply_map_table(scores, points).orderBy("i").collect()]
    want = np.interp([v for v in x if v is not None], np.arange(1_000_000) / 1e6, (np.arange(1_000_000) / 1e6) ** 2)
    assert got[:-1] == pytest.approx(list(want), abs=1e-12) and got[-1] is None
    assert [r.calibrated for r in calibration.apply_map_table(scores, points.limit(0)).collect()] == [None] * len(x)


def test_quantiles_of_a_column_with_two_outliers_stay_dealt(spark):
    """Most values lie in a sliver of the range: parts still hold like numbers of values."""
    df = spark.range(40_000).select((F.col("id") / 1e6).alias("x")).unionByName(spark.createDataFrame([(1e11,), (1e15,)], "x double"))
    ranked = quantiles.with_rank_range(df.groupBy("x").agg(F.count("*").alias("n")), "x")
    rows = sorted((r.x, r.before, r.total) for r in ranked.collect())
    assert [r[1] for r in rows] == list(range(40_002)) and {r[2] for r in rows} == {40_002}
    sizes = [r["count"] for r in ranked.sparkSession.createDataFrame([(x,) for x, _, _ in rows], "x double").repartitionByRange(4, "x").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sorted(sizes)[len(sizes) // 2]


def test_dealt_labels_are_the_same_at_every_cell_width(spark):
    df = spark.createDataFrame([(i, i % 5, int(i % 3 == 0)) for i in range(200)], "account_id int, period int, went_bad int")
    deals = [sorted(map(tuple, splits.permute_labels(df, ("account_id", "period"), cell_rows=c).collect())) for c in (1, 20, 500_000)]
    assert deals[0] == deals[1] == deals[2] and sum(r[2] for r in deals[0]) == 67


def test_tree_contributions_add_up_and_name_the_feature_that_was_asked(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 0, float(a), float(b) if i % 7 else None, "uvw"[i % 3], int(a > 0.3 or i % 3 == 1)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "account_id int, period int, a double, b double, k string, went_bad int")
    fit = model.fit_trees(df, ["a", "b"], ["k"], iterations=4, depth=3)
    for r in model.tree_contributions(fit, df, ["a", "b"], ["k"]).collect():
        assert r.bias + r.c_a + r.c_b + r.c_k == pytest.approx(r.log_odds, abs=1e-9) and r.c_other == 0
    nodes = model.tree_nodes(fit).collect()
    assert {n.tree for n in nodes} == {0, 1, 2, 3} and any(n.categories for n in nodes) and any(n.threshold is not None for n in nodes)


def test_contributions_add_up_to_the_log_odds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 0, float(a), float(b) if i % 7 else None, int(a + b + rng.normal() > 0.5)) for i, (a, b) in enumerate(rng.normal(size=(300, 2)))]
    df = spark.createDataFrame(rows, "account_id int, period int, a double, b double, went_bad int")
    fit = model.fit_scorecard(df, ["a", "b"], balanced=False)
    out = model.score(fit, model.scorecard_contributions(fit, df, ["a", "b"]), ["a", "b"], "p")
    b0 = fit.stages[-1].intercept
    for r in out.collect():
        assert 1 / (1 + np.exp(-(b0 + r.c_a + r.c_b))) == pytest.approx(r.p, abs=1e-6)


def test_dealt_labels_keep_their_count_and_lose_their_signal(spark):
    rows, df = scored(spark, 600)
    dealt = splits.permute_labels(df, ("account_id", "period"))
    got = histogram.rank_metrics(histogram.score_histogram(dealt)).first()
    assert got.n == 600 and got.n_bad == sum(r[3] for r in rows) and abs(got.auc - 0.5) < 0.1


def test_hash_sample_is_exact_in_a_hot_group(spark):
    df = spark.range(3000).select(F.col("id").alias("account_id"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("g"))
    take = spark.createDataFrame([("hot", 1234), ("cold", 10_000)], "g string, take bigint")
    got = {r.g: r.n for r in splits.take_by_hash(df, take, ("g",), ("account_id",)).groupBy("g").agg(F.count_distinct("account_id").alias("n")).collect()}
    assert got == {"hot": 1234, "cold": 900}


def test_folds_are_disjoint_and_stratified_sample_is_proportional(spark):
    df = spark.range(2000).select(F.col("id").alias("account_id"), (F.col("id") % 3).alias("portfolio"), F.lit("green").alias("band"))
    folds = {r.f: r.n for r in df.groupBy(splits.three_way_split(F.col("account_id")).alias("f")).agg(F.count("*").alias("n")).collect()}
    assert sum(folds.values()) == 2000 and 520 < folds["test"] < 680 and folds["policy"] < folds["fit"]
    sample = splits.stratified_sample(df, 100, ("portfolio", "band"), df.where("account_id = 5"))
    assert 100 <= sample.count() <= 101 and sample.where("account_id = 5").count() == 1


def test_partner_links_are_symmetric_without_loops(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("a", "c")], "src string, dst string")
    rows = spark.createDataFrame([("a", "green"), ("b", "red"), ("c", "amber"), ("d", "green")], "account_id string, band string")
    got = {r.account_id: (r.partners, r.flagged, r.red) for r in graph.partner_counts(rows, edges).collect()}
    assert got == {"a": (2, 2, 1), "b": (1, 0, 0), "c": (1, 0, 0), "d": (0, 0, 0)}


def test_gate_keeps_the_first_worst_cell_and_skips_thin_ones(spark):
    crit = spark.createDataFrame([("A", "ge", 0.5, None, 10, "fail"), ("B", "ge", 0.5, None, 0, "warn")],
                                 "criterion_id string, op string, lo double, hi double, min_n bigint, severity string")
    res = spark.createDataFrame([("A", "x", 0.1, 5, 0), ("A", "y", 0.2, 50, 1), ("A", "z", 0.3, 60, 2), ("C", "all", 1.0, 9, 0)],
                                "criterion_id string, level string, value double, n bigint, cell int").withColumn("series", F.array(F.lit(1.0)))
    graded = gates.grade_cells(gates.criteria_with_results(crit, res))
    got = {r.criterion_id: (r.status, r.level) for r in gates.worst_of(graded).collect()}
    assert got == {"A": ("fail", "y"), "B": ("pending", None), "C": ("error", "all")}
    assert gates.verdict(graded).first()[0] == "FAIL"
    assert gates.verdict(graded.where("criterion_id = 'B'")).first()[0] == "PASS_PENDING"


def test_an_answer_about_somebody_else_is_no_evidence(spark):
    acc = spark.createDataFrame([("a",), ("b",), ("c",)], "account_id string")
    out = provenance.account_provenance(acc, acc.where("account_id in ('a', 'b')"), acc.where("account_id = 'a'"), F.lit("BANK_API"))
    assert {r.account_id: (r.identity, r.model) for r in out.collect()} == {
        "a": ("BANK_API", "SIMULATED"), "b": ("FIXTURE", "FIXTURE"), "c": ("SIMULATED", "SIMULATED")}
