"""Plain-language drivers of a score, as arrays of text. No Python per row."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReasonRule:
    """Fires when the observed value passes a limit; ``{}`` in the text takes the scaled value."""

    feature: str
    op: str
    limit: object
    text: str
    scale: float = 1.0

    def column(self, value: Column) -> Column:
        if self.op == "in":
            hit, shown = value.isin(*self.limit), value.cast("string")
        else:
            if self.op == "between":
                hit = value.between(*self.limit)
            else:
                hit = {"lt": value < self.limit, "gt": value > self.limit, "ge": value >= self.limit}[self.op]
            shown = F.round(F.abs(value) * self.scale).cast("bigint").cast("string")
        head, mark, tail = self.text.partition("{}")
        return F.when(hit, F.concat(F.lit(head), shown, F.lit(tail)) if mark else F.lit(head))


# Feature, comparison and limit of each conduct rule.
CONDUCT_RULES = (
    ReasonRule("inflow_vs_6m_avg", "lt", -0.08, "inflow {}% under its half-year mean", 100),
    ReasonRule("inflow_trend_3m", "lt", -0.08, "inflow fell {}% in a quarter", 100),
    ReasonRule("sales_trend_3m", "lt", -0.08, "declared sales fell {}% in a quarter", 100),
    ReasonRule("utilisation", "gt", 0.75, "limit {}% drawn", 100),
    ReasonRule("util_avg_3m", "gt", 0.75, "limit {}% drawn on average over a quarter", 100),
    ReasonRule("util_max_6m", "gt", 0.85, "limit drawn up to {}%", 100),
    ReasonRule("months_over_90pct_util_6m", "ge", 1, "{} month(s) close to the limit"),
    ReasonRule("dpd", "gt", 0, "{} days in arrears"),
    ReasonRule("dpd_max_6m", "gt", 0, "up to {} days late in half a year"),
    ReasonRule("times_late_6m", "gt", 0, "late in {} month(s) of six"),
    ReasonRule("bounces_6m", "gt", 0, "{} returned instalment(s) in half a year"),
    ReasonRule("minbal_breach_6m", "gt", 0, "minimum balance missed {} time(s)"),
    ReasonRule("txn_drop_flag", "gt", 0, "account activity dropped"),
    ReasonRule("adverse_remark_6m", "gt", 0, "auditor remark on file"),
    ReasonRule("vintage_months", "lt", 12, "on book for under a year"),
    ReasonRule("business_age_years", "lt", 3, "borrower active for under three years"),
    ReasonRule("log_sanctioned", "gt", 16.1, "large ticket"),
    ReasonRule("sector", "in", ("Trading", "Retail", "Logistics"), "sector with raised risk: {}"),
    ReasonRule("promoter_age_group", "in", ("<30", "60+"), "age group {}"),
    ReasonRule("qualification", "in", ("SchoolOnly", "UnderGrad"), "qualification {}"),
    ReasonRule("collection_ratio", "lt", 0.95, "{}% of demand collected", 100),
    ReasonRule("collection_ratio_3m", "lt", 0.95, "{}% of a quarter's demand collected", 100),
    ReasonRule("salary_vs_6m_avg", "lt", -0.08, "salary {}% under its half-year mean", 100),
    ReasonRule("salary_gap_6m", "ge", 1, "salary missing in {} month(s) of six"),
    ReasonRule("emi_burden_ratio", "gt", 0.50, "instalments take {}% of income", 100),
    ReasonRule("other_bank_emi", "gt", 0, "pays other lenders too"),
    ReasonRule("ltv_vs_schedule", "gt", 0.03, "loan to value {}% over plan", 100),
    ReasonRule("ltv", "gt", 0.85, "loan to value {}%", 100),
    ReasonRule("rental_vs_6m_avg", "lt", -0.08, "rent {}% under its half-year mean", 100),
    ReasonRule("crop_receipt_vs_norm", "lt", -0.08, "crop receipts {}% under the season's norm", 100),
    ReasonRule("renewal_overdue_months", "ge", 1, "renewal {} month(s) late"),
    ReasonRule("commute_vs_6m_avg", "lt", -0.15, "travel spend {}% under its half-year mean", 100),
    ReasonRule("months_since_moratorium_end", "between", (0, 6), "{} month(s) after the payment holiday"),
    ReasonRule("bureau_score", "lt", 650, "bureau score {}"),
)

# Limits of the company-account rules.
FINANCIAL_RULES = (
    ReasonRule("interest_cover", "lt", 1.5, "interest barely covered"),
    ReasonRule("borrow_to_income", "gt", 1, "debt above a year's income"),
    ReasonRule("loss_flag", "gt", 0, "loss in the year"),
    ReasonRule("neg_networth", "gt", 0, "net worth below zero"),
    ReasonRule("d_income", "lt", -0.05, "income down {}% on the year", 100),
    ReasonRule("d_borrow", "gt", 0.1, "debt up {}% on the year", 100),
    ReasonRule("debt_to_equity", "gt", 2, "high debt to equity"),
    ReasonRule("pbdita_margin", "lt", 0.06, "operating margin {}%", 100),
    ReasonRule("pat_margin", "lt", 0.02, "net margin {}%", 100),
    ReasonRule("d_pat", "lt", -0.1, "profit falling"),
    ReasonRule("d_networth", "lt", -0.05, "net worth falling"),
    ReasonRule("age", "lt", 3, "company under three years old"),
    ReasonRule("log_income", "lt", 0, "very small company"),
)


def reason_codes(contributions: dict[str, Column], values: dict[str, Column], rules=CONDUCT_RULES, k: int = 3) -> Column:
    """The ``k`` largest positive contributions whose rule fires, as an array of text.

    An unobserved (NULL) value never gives a reason; equal contributions keep
    the order of ``contributions``.
    """
    by_feature = {r.feature: r for r in rules}
    cells = [F.struct((-c).alias("order"), F.lit(i).alias("i"), by_feature[f].column(values[f]).alias("text"))
             for i, (f, c) in enumerate(contributions.items()) if f in by_feature]
    fired = F.filter(F.array(*cells), lambda x: (x["order"] < 0) & x["text"].isNotNull())
    return F.transform(F.slice(F.array_sort(fired), 1, k), lambda x: x["text"])
