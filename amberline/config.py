"""Domain constants. All are plain parameters of the operators that use them."""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: horizons, cut-offs and rounding of the score contract ---
NPA_DPD = 90
SMA2_DPD = 61
LABEL_HORIZON_MONTHS = 12
SMA2_HORIZON_MONTHS = 6
RANK_HORIZON_MONTHS = 8
REFERENCE_MONTH = 24
SMOOTH_ROWS = 4
SCORE_DECIMALS = 6
LEGACY_AMBER, LEGACY_RED = 0.04, 0.40
DECILE_FLOOR = 0.9
Z95 = 1.959963984540054
RUPEES_PER_CRORE = 1e7

# --- fixed values: bands in ascending order of risk ---
BANDS = ("green", "amber", "red")

# --- fixed values: observation channels and the columns each one supplies ---
CHANNEL_COLUMNS = {
    "repayment": ("dpd", "bounce", "minbal_breach", "dpd_max_6m", "times_late_6m", "bounces_6m",
                  "minbal_breach_6m"),
    "utilisation": ("utilisation", "util_avg_3m", "util_max_6m", "months_over_90pct_util_6m"),
    "drawing_power": ("drawing_power",),
    "cash_flow": ("inflow", "inflow_trend_3m", "inflow_vs_6m_avg"),
    "transactions": ("txn_count", "txn_drop_flag"),
    "gst": ("gst_sales", "sales_trend_3m"),
    "adverse": ("adverse_remark", "adverse_remark_6m"),
    "salary": ("salary_credit", "salary_vs_6m_avg", "salary_gap_6m"),
    "emi_stacking": ("other_bank_emi", "emi_burden_ratio"),
    "ltv": ("ltv", "ltv_vs_schedule"),
    "rental": ("rental_income", "rental_vs_6m_avg"),
    "harvest": ("crop_receipt", "crop_receipt_vs_norm", "renewal_overdue_months"),
    "moratorium": ("moratorium_active", "months_since_moratorium_end"),
    "commute": ("commute_spend", "commute_vs_6m_avg"),
}
STATEMENT_COLUMNS = ("inflow", "inflow_trend_3m", "inflow_vs_6m_avg", "txn_count", "txn_drop_flag",
                     "balance", "min_balance_6m")

# --- fixed values: which channel family a channel belongs to, and its aliases ---
CHANNEL_FAMILY = {
    "repayment": "repayment", "utilisation": "exposure", "drawing_power": "exposure",
    "cash_flow": "cashflow", "transactions": "cashflow", "gst": "filings", "adverse": "filings",
    "salary": "cashflow", "emi_stacking": "exposure", "ltv": "exposure", "rental": "cashflow",
    "harvest": "cashflow", "moratorium": "repayment", "commute": "cashflow",
    "ecosystem": "filings", "profile": "profile", "bureau": "bureau",
}
CHANNEL_LABEL = {
    "repayment": "Repayment behaviour", "utilisation": "Limit utilisation", "drawing_power": "Drawing power",
    "cash_flow": "Account inflows", "transactions": "Transaction activity", "gst": "GST filings",
    "adverse": "Adverse filings", "salary": "Salary credits", "emi_stacking": "EMIs to other lenders",
    "ltv": "Loan-to-value", "rental": "Rental income", "harvest": "Crop receipts", "moratorium": "Moratorium",
    "commute": "Commute / fuel spend", "ecosystem": "Trading-partner linkage", "profile": "Borrower profile",
    "bureau": "Bureau",
}
# the fields a channel shows, where they are not its panel columns
CHANNEL_SHOWN = {
    "repayment": ("dpd", "dpd_max_6m", "times_late_6m", "bounces_6m", "minbal_breach_6m", "collection_ratio",
                  "collection_ratio_3m", "npa_status", "asset_classification"),
    "cash_flow": ("inflow", "inflow_vs_6m_avg", "inflow_trend_3m"),
    "ecosystem": ("eco_partners", "eco_flagged", "eco_red"),
    "profile": ("vintage_months", "business_age_years", "sector"),
    "bureau": ("bureau_score",),
}
CHANNEL_ALIAS = {"cashflow": "cash_flow", "filings": "gst", "dpd": "repayment"}

# --- fixed values: model feature families ---
FEATURE_FAMILIES = {
    "repayment": ("dpd", "dpd_max_6m", "times_late_6m", "bounce", "bounces_6m", "minbal_breach",
                  "minbal_breach_6m"),
    "cash_flow": ("inflow", "gst_sales", "inflow_trend_3m", "inflow_vs_6m_avg", "sales_trend_3m",
                  "txn_count", "txn_drop_flag"),
    "collection": ("demanded_amount", "collected_amount", "collection_ratio", "collection_ratio_3m"),
    "utilisation": ("utilisation", "util_avg_3m", "util_max_6m", "months_over_90pct_util_6m",
                    "drawing_power", "outstanding"),
    "income": ("salary_credit", "salary_vs_6m_avg", "salary_gap_6m", "balance", "min_balance_6m",
               "rental_income", "rental_vs_6m_avg", "crop_receipt", "crop_receipt_vs_norm",
               "commute_spend", "commute_vs_6m_avg"),
    "leverage": ("other_bank_emi", "emi_burden_ratio", "ltv", "ltv_vs_schedule",
                 "renewal_overdue_months", "moratorium_active"),
    "bureau": ("bureau_score",),
    "adverse": ("adverse_remark", "adverse_remark_6m"),
    "profile": ("log_sanctioned", "vintage_band", "months_since_moratorium_end_band",
                "business_age_years", "sector", "region", "loan_type", "segment", "qualification",
                "promoter_age_group", "portfolio", "constitution", "state", "city_tier",
                "nic_group", "secured", "tenor_months", "interest_rate_pa"),
}

# --- fixed values: provenance sources, weakest first, and the feeds behind each family ---
SOURCE_RANK = ("FIXTURE", "SIMULATED", "BANK_API")
FAMILY_APIS = {
    "identity": ("442", "456", "394", "508"),
    "exposure": ("391", "441", "362", "433", "473", "538"),
    "repayment": ("402", "404"),
    "cashflow": ("393",),
    "bureau": ("408",),
    "profile": ("456",),
}
ALWAYS_SIMULATED = ("filings",)
OVERLAY_FIELDS = ("cif_id", "foracid", "branch_code", "branch_name", "ifsc", "rm_ein", "rm_name",
                  "reporting_manager_ein", "account_manager_ein")

# --- fixed values: grading severities, mildest first ---
STATUS_RANK = ("pass", "report", "skipped_low_n", "warn", "pending", "fail", "error")


@dataclass(frozen=True)
class CostParams:
    """Rupee parameters of the threshold search (fixed default values)."""

    lgd_secured: float = 0.40
    lgd_unsecured: float = 0.75
    income_reversal_months: float = 6.0
    effective_rate_pa: float = 12.75
    penal_rate_pa: float = 2.0
    cure_share_red: float = 0.35
    cure_share_amber: float = 0.10
    review_cost_red_inr: float = 18_000.0
    review_cost_amber_inr: float = 1_500.0
    friction_share_red: float = 0.15
    friction_share_amber: float = 0.02


def candidate_fractions(n: int = 96, first: float = 0.002, last: float = 0.70) -> list[float]:
    """Geometric grid of flagged shares the cut-off search looks at."""
    step = (last / first) ** (1.0 / (n - 1))
    return [round(first * step**i, 5) for i in range(n)]
