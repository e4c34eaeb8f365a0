"""Company-year tables from ratings and financials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MEASURES = {"income": "Total Income", "networth": "Net worth", "pat": "PAT", "borrowings": "Total borrowings including default",
            "pbit": "PBIT", "interest": "Interest expense", "pbdita": "PBDITA", "pbt": "PBT",
            "cover_given": "Interest cover (times)", "leverage_given": "Debt to equity ratio (times)"}  # fixed values: source column names

# fixed values: two-digit industry codes
INDUSTRY = {
    "01": "Agriculture", "05": "Mining", "10": "Food products", "11": "Beverages", "13": "Textiles", "14": "Apparel", "15": "Leather",
    "16": "Wood products", "17": "Paper", "18": "Printing", "20": "Chemicals", "21": "Pharmaceuticals", "22": "Rubber & plastics",
    "23": "Cement & minerals", "24": "Basic metals", "25": "Fabricated metal", "26": "Electronics", "27": "Electrical equipment",
    "28": "Machinery", "29": "Auto & parts", "30": "Other transport eqpt", "31": "Furniture", "32": "Other manufacturing", "35": "Power",
    "41": "Construction", "42": "Civil engineering", "43": "Specialised construction", "45": "Auto trade", "46": "Wholesale trade",
    "47": "Retail trade", "49": "Land transport", "52": "Warehousing", "55": "Hotels", "56": "Restaurants", "62": "IT services",
    "64": "Finance", "68": "Real estate", "71": "Engineering services", "72": "R&D", "82": "Business support"}


def first_default_year(events: DataFrame) -> DataFrame:
    """Earliest year with a default rating, per company that has one."""
    defaulted = (F.col("rating") == "D") | F.col("rating").startswith("D ")
    return events.where(defaulted).groupBy("company").agg(F.min("year").alias("default_year"))


def rated_only(financials: DataFrame, events: DataFrame) -> DataFrame:
    return financials.join(events.select("company").distinct(), "company", "left_semi")


def company_years(long: DataFrame) -> DataFrame:
    """One row per company and year; ``has_<measure>`` tells absent from supplied but unreadable."""
    def value(measure: str) -> Column:
        return F.max(F.when(F.col("measure") == measure, F.col("value")))

    def supplied(measure: str) -> Column:
        return F.max(F.col("measure") == measure)

    return long.groupBy("company", "year").agg(
        *[value(m).alias(c) for c, m in MEASURES.items()],
        *[supplied(MEASURES[c]).alias(f"has_{c}") for c in ("networth", "cover_given", "leverage_given")])


def with_prior_year(years: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add the values of exactly the year before (NULL when that year is missing)."""
    prior = years.select("company", (F.col("year") + 1).alias("year"), F.lit(True).alias("has_prior"),
                         *[F.col(c).alias(f"prior_{c}") for c in columns])
    return years.join(prior, ["company", "year"], "left").withColumn("has_prior", F.coalesce("has_prior", F.lit(False)))


def financial_ratios(years: DataFrame) -> DataFrame:
    """Margins, leverage, flags and year-on-year changes. A division by zero or an unknown is NULL.

    A supplied ratio is used as it stands, even unreadable; the quotient is only
    the fallback for a measure that was not supplied. A zero counts as missing
    in the numerator of a change.
    """
    c = F.col
    changes = ("networth", "income", "pat", "borrowings")
    rows = with_prior_year(years, changes)
    div = F.try_divide

    def change(name: str) -> Column:
        prior = c(f"prior_{name}")
        return div(F.nullif(c(name), F.lit(0.0)) - prior, F.abs(prior))

    ratios = {
        "interest_cover": F.when(c("has_cover_given"), c("cover_given")).otherwise(div(c("pbit"), c("interest"))),
        "debt_to_equity": F.when(c("has_leverage_given"), c("leverage_given")).otherwise(div(c("borrowings"), c("networth"))),
        "pat_margin": div(c("pat"), c("income")), "pbdita_margin": div(c("pbdita"), c("income")), "pbt_margin": div(c("pbt"), c("income")),
        "borrow_to_income": div(c("borrowings"), c("income")), "borrow_to_networth": div(c("borrowings"), c("networth")),
        "neg_networth": F.when(c("networth") < 0, 1.0).otherwise(0.0), "loss_flag": F.when(c("pat") < 0, 1.0).otherwise(0.0),
        "log_income": F.when(c("income") > 0, F.log("income")),
        "d_networth": change("networth"), "d_income": change("income"), "d_pat": change("pat"), "d_borrow": change("borrowings"),
    }
    return rows.withColumns(ratios)


def training_rows(years: DataFrame, defaults: DataFrame, last_year: int, horizon: int = 2) -> DataFrame:
    """Company-years observed before default, labelled by default within the horizon.

    Companies without a default only count where the whole window was observable.
    """
    joined = years.where("has_networth").join(defaults, "company", "left")
    d, y = F.col("default_year"), F.col("year")
    kept = joined.where(F.when(d.isNotNull(), y < d).otherwise(y + horizon <= last_year))
    return kept.withColumn("default", F.when(d.isNotNull() & (d <= y + horizon), 1).otherwise(0))


def industry_label(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in INDUSTRY.items() for x in kv])
    return F.coalesce(F.element_at(table, code), F.lit("Other"))


def company_coverage(years: DataFrame) -> DataFrame:
    """How many companies have how many years, with the median and mean over companies."""
    per = years.groupBy("company").agg(F.count_distinct("year").alias("n_years"))
    dist = per.groupBy("n_years").agg(F.count("*").alias("companies"))
    whole = W.partitionBy(F.lit(0))
    # a handful of rows: one per distinct number of years
    before = F.sum("companies").over(whole.orderBy("n_years")) - F.col("companies")
    n = F.sum("companies").over(whole)
    at = [F.max(F.when((F.col("_b") <= F.floor((F.col("_n") - 1 + s) / 2)) & (F.floor((F.col("_n") - 1 + s) / 2) < F.col("_b") + F.col("companies")), F.col("n_years"))).over(whole) for s in (0, 1)]
    return dist.withColumns({"_b": before, "_n": n}).withColumns({
        "median_years": (at[0] + at[1]) / 2.0,
        "mean_years": F.sum(F.col("n_years") * F.col("companies")).over(whole) / F.col("_n")}).drop("_b", "_n")


def censoring_profile(rows: DataFrame) -> DataFrame:
    return rows.groupBy("year").agg(F.count("*").alias("n"), F.avg("default").alias("positive_rate"))


def event_month_counts(events: DataFrame) -> DataFrame:
    """Default events per month, for dates written like ``12-Mar-2019`` or ``Mar 2019``."""
    month = F.upper(F.regexp_extract("date_text", r"([A-Za-z]{3})", 1))
    return events.where((F.col("rating") == "D") | F.col("rating").startswith("D ")).groupBy(month.alias("month")).agg(F.count("*").alias("n"))
