"""The quality report in full: every data check of the panel as one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.operators import quality
from amberline.plans import summaries, timeseries
from amberline.plans.registry import Tables, check_sql, query


def _one(found: DataFrame, name: str, observed: str, passed: str = "passed") -> DataFrame:
    return found.select(F.lit(name).alias("check"), F.col(observed).alias("observed"), F.expr(passed).alias("passed"))


def _steps(found: DataFrame, name: str) -> DataFrame:
    """A rate by band that must not fall: steps that do."""
    return found.agg(F.lit(name).alias("check"), F.count(F.when(~F.col("step_ok"), 1)).alias("violations"))


# check name -> (query whose SQL says it, what is selected from that SQL)
PARTS = {
    "rate_inside_band": ("ag02_rate_bands", "'rate_inside_band[' || portfolio || ']', bad_rate, passed"),
    "event_ratio": ("ag18_event_ratio", "'event_ratio', event_ratio, passed"),
    "shares": ("ag17_share_checks", '"check", observed, passed'),
    "dpd_shares": ("ag13_sma_shares", "'dpd_shares_fall', sma0, passed"),
    "utilisation_mode": ("ag14_histogram_mode", "'utilisation_mode', mode, mode BETWEEN 0 AND 1"),
    "hazard_hump": ("wn22_hazard_hump", "'hazard_hump', hump, passed"),
    "rate_by_dpd": ("ag15_rate_monotone_by_band", "'rate_rises_by_dpd', count(*) FILTER (NOT step_ok), count(*) FILTER (NOT step_ok) = 0"),
    "null_share": ("ag16_null_share", "'null_share[' || \"column\" || ']', share, share < 1"),
    "presence": ("ag22_channel_presence", '"check", violations, violations = 0'),
    "absence": ("ag23_borrower_absence", '"check", violations, violations = 0'),
    "ids": ("jn06_id_bijection", "'ids_on_one_side', count(*), count(*) = 0"),
    "static": ("ag19_static_attrs_changed", "'changes[' || \"check\" || ']', violations, violations = 0"),
    "age": ("jn07_vintage_mismatches", "'age_not_elapsed_time', count(*), count(*) = 0"),
    "rows": ("gt06_quality_report", '"check", violations, passed'),
}


def _report_sql() -> str:
    parts = " UNION ALL ".join(f"SELECT {what} FROM ({check_sql(name)}) AS {key}" for key, (name, what) in PARTS.items())
    return f"SELECT c AS \"check\", round(o::DOUBLE, 6) AS observed, coalesce(p, false) AS passed FROM ({parts}) AS whole(c, o, p)"


@query("gt06b_full_quality_report", _report_sql())
def full_quality_report(t: Tables):
    """Rates, shares, hazard, presence, joins and row rules; the panel is derived once."""
    t = t.with_stored_panel()
    named = F.concat(F.lit("null_share["), F.col("column"), F.lit("]"))
    found = {
        "rate_inside_band": summaries.rate_bands(t).select(F.concat(F.lit("rate_inside_band["), "portfolio", F.lit("]")).alias("check"), F.col("bad_rate").alias("observed"), "passed"),
        "event_ratio": _one(summaries.event_ratio(t), "event_ratio", "event_ratio"),
        "shares": summaries.share_checks(t),
        "dpd_shares": _one(summaries.sma_shares(t), "dpd_shares_fall", "sma0"),
        "utilisation_mode": _one(summaries.histogram_mode(t), "utilisation_mode", "mode", "mode BETWEEN 0 AND 1"),
        "hazard_hump": _one(timeseries.hazard_hump(t), "hazard_hump", "hump"),
        "rate_by_dpd": _steps(summaries.rate_monotone_by_band(t), "rate_rises_by_dpd"),
        "null_share": summaries.null_share(t).select(named.alias("check"), F.col("share").alias("observed"), (F.col("share") < 1).alias("passed")),
        "presence": summaries.channel_presence(t),
        "absence": summaries.borrower_absence(t),
        "ids_on_one_side": summaries.id_bijection(t),
        "static": summaries.static_attrs_changed(t).withColumn("check", F.concat(F.lit("changes["), "check", F.lit("]"))),
        "age_not_elapsed_time": summaries.vintage_mismatches(t),
        "rows": summaries.quality_report(t).drop("passed"),
    }
    return quality.observed_report(found).withColumn("observed", F.round("observed", 6))
