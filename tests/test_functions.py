"""Expressions on hand-made rows: missingness, ties and edges."""

import math

from pyspark.sql import functions as F

from amberline.config import CostParams
from amberline.functions import bands, costs, display, numeric, reasons
from amberline.functions.hashing import poisson1


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def null(kind="double"):
    return F.lit(None).cast(kind)


def test_unobserved_never_becomes_a_number(spark):
    row = one(spark, numeric.pct_change(F.lit(5.0), null()), numeric.pct_change(null(), F.lit(5.0)), numeric.ratio(null(), F.lit(2.0)),
              numeric.collection_ratio(F.lit(1.0), null()), numeric.clip(null(), 0, 1), bands.rag_band(null(), 0.1, 0.2))
    assert all(v is None for v in row)


def test_nothing_demanded_is_fully_collected(spark):
    assert one(spark, numeric.collection_ratio(F.lit(0.0), F.lit(0.0)))[0] == 1.0


def test_rounding_to_a_step_goes_half_to_even(spark):
    assert list(one(spark, *[numeric.round_to_step(F.lit(v), 1.0) for v in (0.5, 1.5, 2.5)])) == [0.0, 2.0, 2.0]


def test_non_finite_and_unreadable_are_null(spark):
    row = one(spark, numeric.finite_or_null(F.lit(float("nan"))), numeric.finite_or_null(F.lit(float("-inf"))),
              numeric.int_or_null(F.lit("x")), numeric.int_or_null(F.lit("-7.9")), numeric.year_of(F.lit("FY2019")), numeric.num_of(F.lit(" - ")))
    assert list(row) == [None, None, None, -7, 2019, None]


def test_the_two_vintage_rules_differ_at_their_edges(spark):
    row = one(spark, bands.vintage_band(F.lit(12)), bands.vintage_cut(F.lit(12)), bands.vintage_band(F.lit(18)), bands.vintage_cut(F.lit(18)))
    assert list(row) == ["7-12", "[12,18)", "13-18", "[18,30)"]


def test_level_instalments_pay_the_loan_off(spark):
    args = F.lit(1000.0), F.lit(0.12), F.lit(24)
    emi, full, none, late = one(spark, numeric.level_emi(*args), numeric.scheduled_balance(*args, F.lit(24)),
                                numeric.scheduled_balance(*args, F.lit(0)), numeric.scheduled_balance(*args, F.lit(99)))
    balance = 1000.0
    for _ in range(24):
        balance = balance * 1.01 - emi
    assert abs(balance) < 1e-6 and abs(full) < 1e-6 and abs(none - 1000) < 1e-9 and abs(late) < 1e-6


def test_wilson_interval_bounds(spark):
    lo, hi, empty = one(spark, numeric.wilson_low(F.lit(0), F.lit(40)), numeric.wilson_high(F.lit(0), F.lit(40)), numeric.wilson_high(F.lit(0), F.lit(0)))
    assert lo == 0.0 and 0.08 < hi < 0.1 and empty == 0.0


def test_unknown_security_is_costed_at_the_midpoint(spark):
    p = CostParams()
    row = one(spark, costs.lgd(null("int"), p), costs.lgd(F.lit(1), p), costs.lgd(F.lit(0), p))
    assert list(row) == [0.575, 0.4, 0.75]


def test_cost_of_each_band_by_hand(spark):
    b = costs.band_costs(F.lit(1), F.lit(1e6), F.lit(1e6), F.lit(0.4), CostParams())
    loss = 1e6 * 0.4 + 1e6 * 14.75 / 100 * 0.5
    assert all(math.isclose(x, y) for x, y in zip(one(spark, b["green"], b["amber"], b["red"]), (loss, 1500 + 0.9 * loss, 18000 + 0.65 * loss)))


def test_reasons_skip_unobserved_benign_and_negative(spark):
    contributions = {"dpd": F.lit(0.5), "utilisation": F.lit(0.9), "bureau_score": F.lit(0.4), "ltv": F.lit(-1.0), "bounces_6m": F.lit(0.5)}
    values = {"dpd": F.lit(30.0), "utilisation": null(), "bureau_score": F.lit(900), "ltv": F.lit(0.99), "bounces_6m": F.lit(2)}
    assert one(spark, reasons.reason_codes(contributions, values))[0] == ["30 days in arrears", "2 returned instalment(s) in half a year"]


def test_field_states_are_three_different_claims(spark):
    ch = F.array(F.lit("dpd"))
    row = one(spark, display.field_state(F.lit(1.0), "ltv", ch), display.field_state(null(), "ltv", ch), display.field_state(null(), "dpd", ch),
              display.field_state(null(), "ltv", F.array().cast("array<string>")))
    assert list(row) == ["observed", "not_applicable", "unobserved", "unobserved"]


def test_synthetic_cif_and_classification(spark):
    row = one(spark, display.synthetic_cif(F.lit("AB-123")), display.synthetic_cif(F.lit("9876543210")),
              display.observed_classification(F.lit(""), null("string"), F.lit(31.0)), display.observed_classification(F.lit("SMA-1"), null("string"), F.lit(31.0)))
    assert list(row) == ["900000123", "976543210", "not supplied, DPD 31", "SMA-1"]


def test_poisson_weights_have_mean_and_variance_one(spark):
    m, v = spark.range(65536).select(poisson1(F.col("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(m - 1) < 1e-3 and abs(v - 1) < 1e-2
