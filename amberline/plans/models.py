"""Model queries. Fits are checked by rows here and by properties in the tests."""

from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from amberline.functions import reasons
from amberline.operators import attribution, bootstrap, calibration, drift, histogram, model, splits
from amberline.operators.quality import null_share
from amberline.plans.evaluation import REPLICATES
from amberline.plans.registry import Tables, query
from amberline.session import materialise, work_dir

NUMERIC = ["dpd", "utilisation", "txn_count", "inflow", "demanded", "collected", "bureau_score", "sanctioned"]
CATEGORICAL = ["portfolio", "region"]
# the nine families of an ablation; what the panel carries of each
ABLATED = {"repayment": ("dpd",), "utilisation": ("utilisation",), "cash_flow": ("inflow",), "collection": ("demanded", "collected"), "income": ("txn_count",),
           "leverage": ("sanctioned",), "bureau": ("bureau_score",), "adverse": ("bounce",), "profile": ("portfolio", "region")}
FAMILIES = {"repayment": ("dpd",), "utilisation": ("utilisation",), "cash_flow": ("txn_count", "inflow"),
            "collection": ("demanded", "collected"), "bureau": ("bureau_score",), "profile": ("sanctioned",)}


def _rows(t: Tables):
    """The modelling table, written once: training and test accounts are disjoint."""
    side = splits.group_split(F.col("account_id"))
    rows = t.eligible().withColumn("side", side).select(
        "account_id", "period", "to_npa", "went_bad", "side", "decision_score", *NUMERIC, "bounce", *CATEGORICAL)
    return t.stored(rows, *rows.columns)


def _sides(t: Tables):
    rows = _rows(t)
    return rows.where(F.col("side") == "train"), rows.where(F.col("side") == "test")


def _prepared_sides(t: Tables, numeric):
    """The sides with their inputs filled and numbered once, for several tree models."""
    rows = model.with_inputs(_rows(t), F.col("side") == "train", numeric, CATEGORICAL, ("account_id", "side", "went_bad"))
    return rows.where(F.col("side") == "train"), rows.where(F.col("side") == "test")


def _metrics(df, name: str, column: str):
    return model.auc_of(df, column).select(F.lit(name).alias("model"), "n", "n_bad", F.round("auc", 6).alias("auc"), F.round("ks", 6).alias("ks"))


@query("ml01_assemble_features", """
SELECT account_id, period, 18 AS inputs, CASE WHEN bureau_score IS NULL THEN 1.0::DOUBLE ELSE 0.0 END AS bureau_missing FROM eligible""")
def assemble_features(t: Tables):
    rows = model.with_missing_flags(_rows(t), NUMERIC)
    out = Pipeline(stages=model.assembler(NUMERIC, CATEGORICAL)).fit(rows).transform(rows)
    return out.select("account_id", "period", F.size(vector_to_array("features")).alias("inputs"), F.col("bureau_score_missing").alias("bureau_missing"))


@query("ml02_boosted_trees")
def boosted_trees(t: Tables):
    train, test = _sides(t)
    fit = model.fit_trees(train, NUMERIC, CATEGORICAL)
    return _metrics(model.score(fit, test, NUMERIC, "p"), "boosted_trees", "p")


@query("ml03_scorecard")
def scorecard(t: Tables):
    train, test = _sides(t)
    return _metrics(model.score(model.fit_scorecard(train, NUMERIC), test, NUMERIC, "p"), "scorecard", "p")


@query("ml04_isotonic_calibration", """
WITH h AS (SELECT decision_score AS s, count(*)::DOUBLE AS n, sum(went_bad)::DOUBLE AS b FROM eligible GROUP BY 1),
c AS (SELECT s, n, sum(n) OVER (ORDER BY s) AS cn, sum(b) OVER (ORDER BY s) AS cb, sum(n) OVER (ORDER BY s) - n AS pn, sum(b) OVER (ORDER BY s) - b AS pb FROM h),
lo AS (SELECT i.s, j.s AS js, min((k.cb - j.pb) / (k.cn - j.pn)) AS m FROM c i JOIN c j ON j.s <= i.s JOIN c k ON k.s >= i.s GROUP BY 1, 2)
SELECT s AS score, round(max(m), 6) AS calibrated FROM lo GROUP BY 1""")
def isotonic_calibration(t: Tables):
    rows = t.stored(t.eligible(), "decision_score", "went_bad")
    found = model.isotonic_map(rows)
    scores = histogram.score_histogram(rows)
    if found is None:
        return scores.select("score", F.lit(None).cast("double").alias("calibrated"))
    return calibration.apply_map_table(scores.select("score"), found).withColumn("calibrated", F.round("calibrated", 6))


@query("ml05_score_frozen_model")
def score_frozen_model(t: Tables):
    """Fit on early periods, save, load and score the later ones."""
    rows = _rows(t)
    path = os.path.join(work_dir(t.spark), f"model-{uuid.uuid4().hex}")
    model.fit_scorecard(rows.where(F.col("period") < 12), NUMERIC).save(path)
    later = model.score(PipelineModel.load(path), rows.where(F.col("period") >= 16), NUMERIC, "p")
    return later.select("account_id", "period", "p")


@query("ml06_scorecard_contributions")
def scorecard_contributions(t: Tables):
    train, test = _sides(t)
    out = model.scorecard_contributions(model.fit_scorecard(train, NUMERIC), test, NUMERIC)
    why = reasons.reason_codes({c: F.col(f"c_{c}") for c in NUMERIC}, {c: F.col(c) for c in NUMERIC})
    return out.select("account_id", "period", *[F.round(f"c_{c}", 6).alias(f"c_{c}") for c in NUMERIC], F.array_join(why, "; ").alias("reasons"))


@query("ml06b_tree_contributions")
def tree_contributions(t: Tables):
    train, test = _sides(t)
    out = model.tree_contributions(model.fit_trees(train, NUMERIC, CATEGORICAL), test, NUMERIC, CATEGORICAL, FAMILIES | {"profile": ("sanctioned", *CATEGORICAL)})
    return out.select("account_id", "period", F.round("bias", 6).alias("bias"), *[F.round(f"c_{f}", 6).alias(f"c_{f}") for f in FAMILIES], F.round("log_odds", 6).alias("log_odds"))


TEST_SQL = "('0x' || substr(md5(account_id::VARCHAR), 1, 8))::BIGINT % 1000 < 300"


@query("ml06c_contributions_add_up", f"SELECT count(*) AS n, true AS adds_up, true AS all_named FROM eligible WHERE {TEST_SQL}")
def contributions_add_up(t: Tables):
    """The bias and the families' contributions against the log-odds of every test row."""
    train, test = _sides(t)
    out = model.tree_contributions(model.fit_trees(train, NUMERIC, CATEGORICAL), test, NUMERIC, CATEGORICAL, FAMILIES | {"profile": ("sanctioned", *CATEGORICAL)})
    total = F.col("bias") + sum(F.col(f"c_{f}") for f in FAMILIES)
    return out.agg(F.count("*").alias("n"), F.every(F.abs(total - F.col("log_odds")) < 1e-9).alias("adds_up"), F.every(F.col("c_other") == 0).alias("all_named"))


def _contributions(t: Tables):
    train, test = _sides(t)
    out = model.scorecard_contributions(model.fit_scorecard(train, NUMERIC), test, NUMERIC)
    return materialise(out.select("account_id", "to_npa", "went_bad", *[f"c_{c}" for c in NUMERIC]), "contributions")


def _shares(rows, merge=()):
    family = {f"c_{c}": f for f, cols in FAMILIES.items() for c in cols}
    return model.attribution_share(rows, family, [(1, 2), (3, 4)], merge)


@query("ml07_attribution_share")
def attribution_share(t: Tables):
    rows = _contributions(t)
    primary = _shares(rows).withColumn("reading", F.lit("primary"))
    other = _shares(rows, ("repayment", "collection")).withColumn("reading", F.lit("alternative"))
    return primary.unionByName(other).withColumn("share", F.round("share", 6))


BY_FEATURE = {"repayment": ("c_dpd",), "utilisation": ("c_utilisation",), "cash_flow": ("c_txn_count", "c_inflow"), "collection": ("c_demanded", "c_collected"),
              "bureau": ("c_bureau_score",), "profile": ("c_sanctioned", "c_portfolio", "c_region")}


def _attributed(t: Tables):
    """Exact contributions of the tree model's single features, read both ways, with intervals by account."""
    train, test = _sides(t)
    out = model.tree_contributions(model.fit_trees(train, NUMERIC, CATEGORICAL), test, NUMERIC, CATEGORICAL)
    rows = materialise(out.select("account_id", "to_npa", "went_bad", *[f"c_{c}" for c in (*NUMERIC, *CATEGORICAL)]), "tree-contributions")
    merged = {f: c for f, c in BY_FEATURE.items() if f != "collection"} | {"repayment": BY_FEATURE["repayment"] + BY_FEATURE["collection"]}
    parts = [attribution.attribution_intervals(rows, families, [(1, 2), (3, 4)], REPLICATES).withColumn("reading", F.lit(reading))
             for reading, families in (("primary", BY_FEATURE), ("alternative", merged))]
    return materialise(parts[0].unionByName(parts[1]), "attribution")


@query("ml07b_tree_attribution_intervals")
def tree_attribution_intervals(t: Tables):
    return _attributed(t).select("reading", "bucket", "family", "n", *[F.round(c, 6).alias(c) for c in ("share", "lo", "hi", "signed_share", "signed_lo", "signed_hi")])


@query("ml07c_attribution_adds_up", f"""
WITH b AS (SELECT CASE WHEN to_npa BETWEEN 1 AND 2 THEN '1-2' WHEN to_npa BETWEEN 3 AND 4 THEN '3-4' END AS bucket FROM eligible WHERE went_bad = 1 AND {TEST_SQL})
SELECT reading, bucket, count(*) AS n, families, true AS whole, true AS whole_net, true AS ordered
FROM b, (VALUES ('primary', 6::BIGINT), ('alternative', 5::BIGINT)) AS r(reading, families) WHERE bucket IS NOT NULL GROUP BY reading, bucket, families""")
def attribution_adds_up(t: Tables):
    """Shares of a bucket sum to one, net shares in absolute value too, and every interval is in order."""
    return _attributed(t).groupBy("reading", "bucket").agg(
        F.max("n").alias("n"), F.count("*").alias("families"), (F.abs(F.sum("share") - 1) < 1e-9).alias("whole"), (F.abs(F.sum(F.abs("signed_share")) - 1) < 1e-9).alias("whole_net"),
        F.every((F.col("lo") <= F.col("hi")) & (F.col("signed_lo") <= F.col("signed_hi"))).alias("ordered"))


# readable names of the inputs
READABLE = {"dpd": "Days in arrears", "utilisation": "Limit drawn", "txn_count": "Account activity", "inflow": "Inflow", "demanded": "Amount due",
            "collected": "Amount collected", "bureau_score": "Bureau score", "sanctioned": "Ticket size", "portfolio": "Portfolio", "region": "Region"}


@query("ml08_feature_importance")
def feature_importance(t: Tables):
    train, _ = _sides(t)
    return model.feature_importance(model.fit_trees(train, NUMERIC, CATEGORICAL), NUMERIC, CATEGORICAL, labels=READABLE)


GRADED_SQL = f"(SELECT count(*) FROM eligible WHERE {TEST_SQL}) AS n, (SELECT sum(went_bad)::BIGINT FROM eligible WHERE {TEST_SQL}) AS n_bad"


def _compared(scored, names):
    """A row a variant: AUC, its difference from the first on shared draws, and whether the numbers fit together."""
    base, *others = (f"p_{n}" for n in names)
    spans = bootstrap.paired_delta_intervals(scored, base, tuple(others), REPLICATES).where(F.col("metric") == "auc").select(
        F.expr("substr(model, 3)").alias("variant"), "lo", "hi")
    long = scored.select("went_bad", F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"p_{n}").alias("p")) for n in names])).alias("v")).select("went_bad", "v.*")
    m = histogram.rank_metrics(histogram.score_histogram(long, "p", groups=("variant",)), ("variant",))
    full = m.where(F.col("variant") == names[0]).select("auc").scalar()
    rows = m.withColumn("delta", F.col("auc") - full).join(spans, "variant", "left")
    return materialise(rows.select("variant", "n", "n_bad", "auc", "delta", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(0.0)).alias("hi")), "compared")


def _figures(rows):
    return rows.select("variant", "n", "n_bad", *[F.round(c, 6).alias(c) for c in ("auc", "delta", "lo", "hi")])


def _ablation(t: Tables):
    train, test = _prepared_sides(t, [*NUMERIC, "bounce"])
    out, names = test, ["full", *(f"no_{f}" for f in ABLATED)]
    for name, dropped in zip(names, [(), *ABLATED.values()]):
        numeric, levels = [c for c in (*NUMERIC, "bounce") if c not in dropped], [c for c in CATEGORICAL if c not in dropped]
        out = model.score(model.fit_trees(train, numeric, levels, iterations=5), out, numeric, f"p_{name}")
    return _compared(materialise(out.drop(model.INPUTS), "ablated"), names)


@query("ml09_family_ablation")
def family_ablation(t: Tables):
    """The tree model without each of nine families, on shared draws."""
    return _figures(_ablation(t))


ABLATION_SQL = ", ".join(f"('{n}')" for n in ("full", *(f"no_{f}" for f in ABLATED)))


@query("ml09b_ablation_fits_together", f"SELECT variant, {GRADED_SQL}, true AS inside, true AS ordered FROM (VALUES {ABLATION_SQL}) AS v(variant)")
def ablation_fits_together(t: Tables):
    rows = _ablation(t)
    return rows.select("variant", "n", "n_bad", F.col("auc").between(0, 1).alias("inside"), (F.col("lo") <= F.col("hi")).alias("ordered"))


def _stressed(t: Tables):
    """Labels dealt at random before the split, failing training rows twice, and the bureau score hidden, beside the plain fit."""
    rows = _rows(t)
    train, test = rows.where(F.col("side") == "train"), rows.where(F.col("side") == "test")
    shuffled = materialise(splits.permute_labels(rows, ("account_id", "period")), "permuted")
    noise = model.fit_scorecard(shuffled.where(F.col("side") == "train"), NUMERIC)
    twice = model.fit_scorecard(splits.oversample_positives(train, 2).drop("copy"), NUMERIC, balanced=False)
    fit = model.fit_scorecard(train, NUMERIC)
    plain = model.score(twice, model.score(fit, test, NUMERIC, "p_plain"), NUMERIC, "p_twice_base_rate")
    hidden = plain.withColumns({"_kept": F.col("bureau_score"), "bureau_score": F.lit(None).cast("bigint")})
    masked = model.score(fit, hidden, NUMERIC, "p_bureau_masked").drop("bureau_score").withColumnRenamed("_kept", "bureau_score")
    stressed = materialise(masked, "stressed")
    # dealt labels are another target: their scores are graded against them, the difference is to the plain fit
    dealt = materialise(model.score(noise, shuffled.where(F.col("side") == "test"), NUMERIC, "p_permuted_labels"), "dealt")
    main = _compared(stressed, ["plain", "twice_base_rate", "bureau_masked"])
    own = model.auc_of(dealt, "p_permuted_labels")
    span = bootstrap.auc_interval(dealt, "p_permuted_labels", REPLICATES)
    base = main.where(F.col("variant") == "plain").select("auc").scalar()
    row = own.select(F.lit("permuted_labels").alias("variant"), "n", "n_bad", "auc", (F.col("auc") - base).alias("delta"))
    row = row.withColumns({"lo": span.agg(F.max("lo")).scalar() - base, "hi": span.agg(F.max("hi")).scalar() - base})
    return materialise(main.unionByName(row), "stress")


@query("ml10_stress_tests")
def stress_tests(t: Tables):
    return _figures(_stressed(t))


@query("ml10b_stress_bounds", f"SELECT variant, (SELECT count(*) FROM eligible WHERE {TEST_SQL}) AS n, true AS ordered, true AS in_bounds FROM (VALUES ('plain'), ('twice_base_rate'), ('bureau_masked'), ('permuted_labels')) AS v(variant)")
def stress_bounds(t: Tables):
    """Every stressed fit stays a ranking of the test rows; dealt labels rank no better than chance."""
    rows = _stressed(t)
    chance = F.when(F.col("variant") == "permuted_labels", F.col("auc").between(0.35, 0.65)).otherwise(F.col("auc").between(0, 1))
    return rows.select("variant", "n", (F.col("lo") <= F.col("hi")).alias("ordered"), chance.alias("in_bounds"))


@query("ml11_baseline_ladder")
def baseline_ladder(t: Tables):
    """Arrears alone, a scorecard, boosted trees: AUC with account-level intervals."""
    train, test = _sides(t)
    scored = model.score(model.fit_scorecard(train, NUMERIC), test.withColumn("arrears", F.round(F.col("dpd") / 90, 6)), NUMERIC, "scorecard")
    scored = materialise(model.score(model.fit_trees(train, NUMERIC, CATEGORICAL), scored, NUMERIC, "trees"), "ladder")
    out = None
    for name in ("arrears", "scorecard", "trees"):
        span = bootstrap.auc_interval(scored, name, REPLICATES)
        rung = _metrics(scored, name, name).withColumn("_s", span.agg(F.struct(F.max("lo").alias("lo"), F.max("hi").alias("hi"))).scalar())
        rung = rung.select("model", "auc", F.round("_s.lo", 6).alias("lo"), F.round("_s.hi", 6).alias("hi"))
        out = rung if out is None else out.unionByName(rung)
    return out


PROFILE = ("sanctioned", *CATEGORICAL)


def _variants(t: Tables):
    """One tree model three ways: all inputs, none that describe the borrower, and shallow trees with large leaves."""
    train, test = _prepared_sides(t, NUMERIC)
    conduct = [c for c in NUMERIC if c not in PROFILE]
    fits = {"full": (NUMERIC, model.fit_trees(train, NUMERIC, CATEGORICAL)), "profile_free": (conduct, model.fit_trees(train, conduct)),
            "regularised": (NUMERIC, model.fit_trees(train, NUMERIC, CATEGORICAL, depth=3, least_rows=40))}
    scored = test
    for name, (numeric, fit) in fits.items():
        scored = model.score(fit, scored, numeric, f"p_{name}")
    return _compared(materialise(scored.drop(model.INPUTS), "variants"), list(fits))


@query("ml12_feature_set_variants")
def feature_set_variants(t: Tables):
    return _figures(_variants(t))


@query("ml12b_variants_fit_together", f"SELECT variant, {GRADED_SQL}, true AS inside, true AS ordered FROM (VALUES ('full'), ('profile_free'), ('regularised')) AS v(variant)")
def variants_fit_together(t: Tables):
    rows = _variants(t)
    return rows.select("variant", "n", "n_bad", F.col("auc").between(0, 1).alias("inside"), (F.col("lo") <= F.col("hi")).alias("ordered"))


@query("ml13_missing_at_random")
def missing_at_random(t: Tables):
    return model.missing_odds(_rows(t), ["bureau_score"]).select("column", F.round("odds_ratio", 6).alias("odds_ratio"))


@query("ml14_availability_manifest", """
WITH c AS (SELECT unnest(['dpd', 'utilisation', 'txn_count', 'inflow', 'bureau_score', 'sanctioned', 'region']) AS "column", unnest([count(dpd), count(utilisation), count(txn_count), count(inflow), count(bureau_score), count(sanctioned), count(region)]) AS n,
 count(*) AS total FROM eligible)
SELECT "column", round(1 - n / total, 6) AS null_share, CASE "column" WHEN 'dpd' THEN 'repayment' WHEN 'utilisation' THEN 'utilisation' WHEN 'txn_count' THEN 'cash_flow' WHEN 'inflow' THEN 'cash_flow' WHEN 'bureau_score' THEN 'bureau'
 WHEN 'region' THEN 'profile' END AS family, "column" = 'sanctioned' AS orphan FROM c""")
def availability_manifest(t: Tables):
    shares = null_share(t.eligible(), ("dpd", "utilisation", "txn_count", "inflow", "bureau_score", "sanctioned", "region"))
    return model.availability(shares).select("column", F.round("share", 6).alias("null_share"), "family", "orphan")


@query("ml16_attribution_coverage")
def attribution_coverage(t: Tables):
    return model.attribution_coverage(_shares(_contributions(t))).withColumn("worst_gap", F.round("worst_gap", 6))


@query("ml17_score_drift_by_side")
def score_drift_by_side(t: Tables):
    """Drift of a fitted score between training and test accounts: the floor real drift is read against."""
    rows = _rows(t)
    fit = model.fit_scorecard(rows.where(F.col("side") == "train"), NUMERIC)
    return drift.psi(model.score(fit, rows, NUMERIC, "p"), F.col("side") == "train", "p").withColumn("psi", F.round("psi", 6))
