"""Null-aware arithmetic and statistical expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from amberline.config import Z95


def all_present(*cols: Column) -> Column:
    ok = cols[0].isNotNull()
    for c in cols[1:]:
        ok = ok & c.isNotNull()
    return ok


def pct_change(now: Column, then: Column) -> Column:
    """(now - then) / max(then, 1). ``greatest`` skips NULLs, hence the guard."""
    return F.when(all_present(now, then), (now - then) / F.greatest(then, F.lit(1.0)))


def ratio(now: Column, base: Column) -> Column:
    """now / max(base, 1), NULL when either side is unobserved."""
    return F.when(all_present(now, base), now / F.greatest(base, F.lit(1.0)))


def collection_ratio(collected: Column, demanded: Column) -> Column:
    """Share of demand collected; 1 when nothing was demanded, NULL when unobserved."""
    return F.when(demanded > 0, ratio(collected, demanded)).when(demanded.isNotNull(), F.lit(1.0))


def level_emi(principal: Column, rate_pa: Column, tenor_months: Column) -> Column:
    """Level monthly instalment; straight-line when the rate is zero."""
    r = rate_pa / 12.0
    growth = F.pow(1.0 + r, tenor_months)
    return F.when(r == 0, principal / tenor_months).otherwise(principal * r * growth / (growth - 1.0))


def scheduled_balance(principal: Column, rate_pa: Column, tenor_months: Column, elapsed: Column) -> Column:
    """Outstanding principal of a level-instalment loan after ``elapsed`` months."""
    r = rate_pa / 12.0
    k = F.least(elapsed, tenor_months)
    growth, paid = F.pow(1.0 + r, tenor_months), F.pow(1.0 + r, k)
    amortised = principal * (growth - paid) / (growth - 1.0)
    return F.when(r == 0, principal * (1.0 - k / tenor_months)).otherwise(amortised)


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))


def ltv(outstanding: Column, collateral: Column) -> Column:
    return clip(F.try_divide(outstanding, collateral), 0.0, 3.0)


def emi_burden(other_emi: Column, demanded: Column, income: Column, floor: Column) -> Column:
    load = F.when(all_present(other_emi, demanded, income, floor),
                  (other_emi + demanded) / F.greatest(income, floor))
    return clip(load, 0.0, 20.0)


def round_to_step(value: Column, step: float) -> Column:
    """Nearest multiple of ``step``, ties to even."""
    return F.bround(value / F.lit(step)) * F.lit(step)


def finite_or_null(value: Column) -> Column:
    v = value.cast("double")
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(v.isNotNull() & ~bad, v)


def int_or_null(text: Column) -> Column:
    """Whole number out of text or a number; NULL for anything else."""
    v = finite_or_null(text.try_cast("double"))
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("bigint")


def year_of(text: Column) -> Column:
    """First run of four digits, as a year."""
    return F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")


def num_of(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def wilson_low(k: Column, n: Column, z: float = Z95) -> Column:
    return _wilson(k, n, z, -1)


def wilson_high(k: Column, n: Column, z: float = Z95) -> Column:
    return _wilson(k, n, z, 1)


def _wilson(k: Column, n: Column, z: float, sign: int) -> Column:
    nn = n.cast("double")
    p = k.cast("double") / nn
    spread = F.lit(z) * F.sqrt(p * (1.0 - p) / nn + F.lit(z * z) / (4.0 * nn * nn))
    centre = p + F.lit(z * z) / (2.0 * nn)
    bound = (centre + F.lit(float(sign)) * spread) / (1.0 + F.lit(z * z) / nn)
    return F.when(n > 0, F.least(F.greatest(bound, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def rate(k: Column, n: Column) -> Column:
    """k / n with an empty cell rated 0."""
    return F.when(n > 0, k / n).otherwise(F.lit(0.0))


def clipped_logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (1.0 - q))


def calendar_month(idx: Column, first_year: int, first_month: int = 1) -> Column:
    """First day of the month ``idx`` months after the panel start."""
    return F.add_months(F.lit(f"{first_year:04d}-{first_month:02d}-01").cast("date"), idx.cast("int"))


def crop_year(date: Column) -> Column:
    """Agricultural year of a date: the year steps in July."""
    return F.when(F.month(date) >= 7, F.year(date)).otherwise(F.year(date) - 1)
