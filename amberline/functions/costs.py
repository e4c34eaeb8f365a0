"""Rupee cost expressions of banding one account."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amberline.config import CostParams


def ead(outstanding: Column, log_sanctioned: Column) -> Column:
    """Outstanding when finite and positive, else the sanctioned amount, else 0."""
    return F.coalesce(
        F.when((outstanding > 0) & (outstanding < float("inf")), outstanding),
        F.exp(log_sanctioned),
        F.lit(0.0),
    )


def lgd(secured: Column, p: CostParams) -> Column:
    """Loss given default; an unknown flag is costed at the midpoint."""
    return (F.when(secured.isNull(), F.lit((p.lgd_secured + p.lgd_unsecured) / 2))
            .when(secured > 0.5, F.lit(p.lgd_secured)).otherwise(F.lit(p.lgd_unsecured)))


def expected_loss(ead_: Column, lgd_: Column, p: CostParams) -> Column:
    reversal = (p.effective_rate_pa + p.penal_rate_pa) / 100.0 * p.income_reversal_months / 12.0
    return ead_ * lgd_ + ead_ * reversal


def band_costs(n: Column, ead_: Column, ead_bad: Column, lgd_: Column, p: CostParams) -> dict[str, Column]:
    """Cost of ``n`` accounts in each band, keyed by band.

    ``ead_bad`` is the part of the exposure that goes bad, so the same formula
    prices one account (n = 1) and a histogram cell of accounts with one LGD.
    """
    loss = expected_loss(ead_bad, lgd_, p)
    interest_good = (ead_ - ead_bad) * p.effective_rate_pa / 100.0

    def flagged(review, friction, cure) -> Column:
        return n * review + interest_good * friction + loss * (1.0 - cure)

    return {
        "green": loss,
        "amber": flagged(p.review_cost_amber_inr, p.friction_share_amber, p.cure_share_amber),
        "red": flagged(p.review_cost_red_inr, p.friction_share_red, p.cure_share_red),
    }
