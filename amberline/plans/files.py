"""Source, sink and company-year queries. Files are derived from the given tables first, then read back."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from amberline.functions import reasons
from amberline.operators import company
from amberline.operators.company_model import RATIOS
from amberline.operators.splits import group_split
from amberline.plans.registry import Tables, query
from amberline.plans.summaries import _rounded
from amberline.session import spread, work_dir
from amberline.sources import company as company_files
from amberline.sources import panel as panel_files
from amberline.sources import pulls


def _folder(t: Tables, name: str) -> str:
    return os.path.join(work_dir(t.spark), f"{name}-{uuid.uuid4().hex}")


def _monthly(t: Tables):
    """The panel under its published column names, with some cells unobserved."""
    return t.panel().select(
        F.concat(F.lit("A"), "account_id").alias("account_id"), F.col("period").alias("month_idx"), "portfolio", "region",
        F.when(F.col("period") % 5 == 0, float("nan")).otherwise(F.col("utilisation")).alias("utilisation"), "dpd",
        # cents and a bit, so that no sum's last digit decides a tie
        (F.round("inflow", 2) + 0.003).alias("inflow"), (F.round("demanded", 2) + 0.003).alias("demanded_amount"), "bureau_score",
        F.when(F.col("portfolio") != "HOUSEHOLD", F.col("txn_count")).alias("txn_count"), F.col("labelable"))


MONTHLY_SQL = """SELECT 'A' || account_id AS account_id, period AS month_idx, portfolio, CASE WHEN period % 5 <> 0 THEN round_even(utilisation, 4) END AS utilisation, round_even(dpd, 1) AS dpd,
 round_even(round(inflow, 2) + 0.003::DOUBLE, 1) AS inflow, round_even(round(demanded, 2) + 0.003::DOUBLE, 0)::BIGINT AS demanded_amount, bureau_score, CASE WHEN portfolio <> 'HOUSEHOLD' THEN txn_count END AS txn_count FROM panel"""
MONTHLY = ("account_id", "month_idx", "portfolio", "utilisation", "dpd", "inflow", "demanded_amount", "bureau_score", "txn_count")


@query("io01_read_panel", MONTHLY_SQL)
def read_panel(t: Tables):
    path = _folder(t, "panel-parquet")
    panel_files.write_panel(_monthly(t), path)
    return panel_files.read_panel(t.spark, path).select(*MONTHLY)


@query("io03_write_panel_csv", MONTHLY_SQL)
def write_panel_csv(t: Tables):
    path = _folder(t, "panel-csv")
    panel_files.write_panel(_monthly(t), path, "csv")
    return panel_files.read_panel(t.spark, path, "csv").select(*MONTHLY)


HEADER_SQL = ", ".join(f"('{c.name}', {i})" for i, c in enumerate(panel_files.PANEL))


@query("io03b_panel_header", f"SELECT * FROM (VALUES {HEADER_SQL}) AS h(name, place)")
def panel_header(t: Tables):
    """The header line of the written files: one and the same, in the contract's order."""
    path = _folder(t, "panel-csv")
    panel_files.write_panel(_monthly(t), path, "csv")
    lines = t.spark.read.text(path).select("value").where(F.col("value").startswith(panel_files.PANEL[0].name + ",")).distinct()
    return lines.select(F.posexplode(F.split("value", ",")).alias("place", "name"))


RULED_SQL = ", ".join(f"('{c.name}', 0::BIGINT)" for c in panel_files.PANEL if c.decimals is not None)


@query("pr15b_panel_rounding", f"SELECT * FROM (VALUES {RULED_SQL}) AS r(\"column\", violations)")
def panel_rounding(t: Tables):
    """Every rounded column of the contract after a round trip."""
    path = _folder(t, "panel-csv")
    panel_files.write_panel(_monthly(t), path, "csv")
    return panel_files.contract_violations(panel_files.read_panel(t.spark, path, "csv"))


@query("io02_read_accounts", """
SELECT 'A' || account_id AS account_id, portfolio, constitution, round(sanctioned, 2) AS sanctioned_amount, secured, bureau_score AS bureau_score_0 FROM acc""")
def read_accounts(t: Tables):
    path = _folder(t, "accounts")
    t.accounts().select(F.concat(F.lit("A"), "account_id").alias("account_id"), "portfolio", "constitution",
                        F.round("sanctioned", 2).alias("sanctioned_amount"), "secured", F.col("bureau_score").alias("bureau_score_0")) \
        .write.option("header", True).csv(path)
    return panel_files.read_accounts(t.spark, path, "csv").select(
        "account_id", "portfolio", "constitution", "sanctioned_amount", "secured", "bureau_score_0")


# ---- company files -----------------------------------------------------------

def _ratings(t: Tables):
    """One rating action per order: companies are customers."""
    key = F.col("o_orderkey")
    rating = F.when(key % 23 == 0, "D").when(key % 7 == 0, "BBB").otherwise("A")
    return t.read("orders").select(F.format_string("Customer#%09d", "o_custkey").alias("company"), rating.alias("rating"),
                                   F.when(key % 11 != 0, F.date_format("o_orderdate", "dd-MMM-yyyy")).otherwise("n.a.").alias("date_text"))


def _rating_file(t: Tables) -> str:
    """The rating history as text: two preamble lines, the header, then quoted-free CSV lines."""
    lines = _ratings(t).select(F.concat_ws(",", "company", F.lit("x"), "rating", F.lit("lt"), F.lit("s"), "date_text").alias("value"))
    head = t.read("region").agg(F.count("*").alias("_n")).select(F.explode(F.array(
        F.lit("Rating history"), F.lit("all dates as published"), F.lit("Company Name,Instrument,Rating,Term,Agency,Date"))).alias("value"))
    path = _folder(t, "ratings")
    head.unionByName(lines).write.text(path)
    return path


RATING_SQL = """ev AS (SELECT printf('Customer#%09d', o_custkey) AS company, CASE WHEN o_orderkey % 23 = 0 THEN 'D' WHEN o_orderkey % 7 = 0 THEN 'BBB' ELSE 'A' END AS rating,
 strftime(o_orderdate, '%d-%b-%Y') AS date_text, year(o_orderdate)::INT AS year FROM orders WHERE o_orderkey % 11 <> 0)"""


def _events(t: Tables):
    return company_files.read_rating_events(t.spark, _rating_file(t))


@query("io04_read_rating_events", f"WITH {RATING_SQL} SELECT * FROM ev")
def read_rating_events(t: Tables):
    return _events(t)


@query("io05_read_identifiers", """
SELECT c_name AS company, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE lpad((c_custkey % 70)::VARCHAR, 2, '0') END AS nic, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE (1950 + c_custkey % 50)::INT END AS incorporated FROM customer""")
def read_identifiers(t: Tables):
    key = F.col("c_custkey")
    code = F.when(key % 9 == 0, "").otherwise(F.concat(F.lpad((key % 70).cast("string"), 2, "0"), F.lit("113")))
    year = F.when(key % 8 == 0, "unknown").otherwise(F.concat(F.lit("Since "), 1950 + key % 50))
    path = _folder(t, "identifiers")
    t.read("customer").select(F.col("c_name").alias("Company Name"), code.alias("NIC code"), year.alias("Incorporation year")) \
        .write.option("header", True).option("emptyValue", "").csv(path)
    return company_files.read_identifiers(t.spark, path)


@query("ag31_first_default_year", f"WITH {RATING_SQL} SELECT company, min(year) AS default_year FROM ev WHERE rating = 'D' GROUP BY 1")
def first_default_year(t: Tables):
    return company.first_default_year(_events(t))


@query("ag28_event_month_counts", f"WITH {RATING_SQL} SELECT upper(date_text[4:6]) AS month, count(*) AS n FROM ev WHERE rating = 'D' GROUP BY 1")
def event_month_counts(t: Tables):
    return company.event_month_counts(_events(t))


LONG_SQL = """base AS (SELECT o_custkey AS k, year(o_orderdate)::INT AS year, sum(o_totalprice) AS inc FROM orders GROUP BY 1, 2),
lg AS (SELECT printf('Customer#%09d', k) AS company, year, unnest(['Total Income', 'Net worth', 'PAT', 'Total borrowings including default', 'Interest expense', 'PBIT', 'PBDITA', 'PBT', 'Interest cover (times)']) AS measure,
 unnest([round(inc, 0), CASE WHEN (k + year) % 13 <> 0 THEN round(inc * ((k + year) % 5 - 1) / 4, 0) END, round(inc * ((k + 2 * year) % 6 - 1) / 20, 0), CASE WHEN (k + year) % 9 = 0 THEN 0 ELSE round(inc * ((k + year) % 7) / 5, 0) END,
  round(inc * (k % 4) / 40, 0), round(inc * ((k + year) % 6) / 15, 0), round(inc * ((k + year) % 6 + 1) / 15, 0), round(inc * ((k + 3 * year) % 7 - 1) / 25, 0), CASE WHEN k % 10 = 0 THEN round(inc / 100000, 0) END]) AS value,
 unnest([true, true, true, true, true, true, true, true, k % 10 = 0]) AS given FROM base),
long AS (SELECT company, year, measure, value FROM lg WHERE given)"""


def _base(t: Tables):
    """Invented financials of a customer-year, all whole numbers so a text file keeps them exactly."""
    orders = t.read("orders")
    base = spread(orders, orders.count(), "o_custkey").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("inc"))
    k, y, inc = F.col("k"), F.col("year"), F.col("inc")
    return base.select("k", "year", *[c.alias(n) for n, c in {
        "Total Income": F.round(inc, 0), "Net worth": F.when((k + y) % 13 != 0, F.round(inc * ((k + y) % 5 - 1) / 4, 0)),
        "PAT": F.round(inc * ((k + 2 * y) % 6 - 1) / 20, 0),
        "Total borrowings including default": F.when((k + y) % 9 == 0, F.lit(0.0)).otherwise(F.round(inc * ((k + y) % 7) / 5, 0)),
        "Interest expense": F.round(inc * (k % 4) / 40, 0), "PBIT": F.round(inc * ((k + y) % 6) / 15, 0),
        "PBDITA": F.round(inc * ((k + y) % 6 + 1) / 15, 0), "PBT": F.round(inc * ((k + 3 * y) % 7 - 1) / 25, 0),
        "Interest cover (times)": F.when(k % 10 == 0, F.round(inc / 100000, 0))}.items()])


MEASURE_NAMES = ("Total Income", "Net worth", "PAT", "Total borrowings including default", "Interest expense", "PBIT", "PBDITA", "PBT", "Interest cover (times)")


def _long(t: Tables):
    """Writes the wide file (one column per year and measure) and reads it back to long form."""
    # blank: not supplied; '-': supplied but unreadable
    text = {m: F.coalesce(F.col(f"`{m}`").cast("decimal(18,0)").cast("string"), F.lit("" if m.startswith("Interest cover") else "-")) for m in MEASURE_NAMES}
    span = t.read("orders").agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    held = range(span[0], span[1] + 1) if span[0] is not None else ()
    cells = _base(t).select("k", "year", *[c.alias(m) for m, c in text.items()])
    # a file per decade of years, each with its own stacked headers and columns
    path = _folder(t, "financials")
    for at, years in enumerate(held[i:i + 4] for i in range(0, len(held), 4)):
        measures = MEASURE_NAMES if at % 2 == 0 else MEASURE_NAMES[::-1]
        columns = [f"c{i}" for i in range(len(years) * len(measures))]
        wide = cells.groupBy("k").agg(*[F.max(F.when(F.col("year") == y, F.col(f"`{m}`"))).alias(c) for c, (y, m) in zip(columns, ((y, m) for y in years for m in measures))])
        lines = wide.select(F.concat_ws(",", F.format_string("Customer#%09d", "k"), *[F.coalesce(c, F.lit("")) for c in columns]).alias("value"))
        top = ["Financials,all figures as supplied", "", "", "", ",".join(["", *[f"Mar {y}" for y in years for _ in measures]]), ",".join(["Company Name", *(m for _ in years for m in measures)])]
        head = t.read("region").agg(F.count("*").alias("_n")).select(F.explode(F.array(*map(F.lit, top))).alias("value"))
        head.coalesce(1).write.text(f"{path}/{at}/head")
        lines.write.text(f"{path}/{at}/body")
    return company_files.read_wide_financials(t.spark, [f"{path}/{at}" for at in range(-(-len(held) // 4))])


@query("io06_wide_financials_to_long", f"WITH {LONG_SQL} SELECT company, year, measure, value + 0 AS value FROM long")
def wide_financials_to_long(t: Tables):
    return _long(t)


CY_SQL = f"""{RATING_SQL}, {LONG_SQL}, fd AS (SELECT company, min(year) AS default_year FROM ev WHERE rating = 'D' GROUP BY 1),
cy AS (SELECT company, year, max(value) FILTER (measure = 'Total Income') AS income, max(value) FILTER (measure = 'Net worth') AS networth, max(value) FILTER (measure = 'PAT') AS pat,
 max(value) FILTER (measure = 'Total borrowings including default') AS borrowings, max(value) FILTER (measure = 'Interest expense') AS interest, max(value) FILTER (measure = 'PBIT') AS pbit,
 max(value) FILTER (measure = 'PBDITA') AS pbdita, max(value) FILTER (measure = 'PBT') AS pbt,
 max(value) FILTER (measure = 'Interest cover (times)') AS cover, bool_or(measure = 'Interest cover (times)') AS has_cover FROM long GROUP BY 1, 2),
rt AS (SELECT c.company, c.year, CASE WHEN c.has_cover THEN c.cover ELSE c.pbit / nullif(c.interest, 0) END AS interest_cover, c.borrowings / nullif(c.networth, 0) AS debt_to_equity, c.pat / nullif(c.income, 0) AS pat_margin,
 c.pbdita / nullif(c.income, 0) AS pbdita_margin, c.pbt / nullif(c.income, 0) AS pbt_margin, c.borrowings / nullif(c.networth, 0) AS borrow_to_networth, (nullif(c.pat, 0) - p.pat) / nullif(abs(p.pat), 0) AS d_pat,
 c.borrowings / nullif(c.income, 0) AS borrow_to_income, CASE WHEN c.networth < 0 THEN 1.0 ELSE 0.0 END AS neg_networth, CASE WHEN c.pat < 0 THEN 1.0 ELSE 0.0 END AS loss_flag, CASE WHEN c.income > 0 THEN ln(c.income) END AS log_income,
 (nullif(c.networth, 0) - p.networth) / nullif(abs(p.networth), 0) AS d_networth, (nullif(c.income, 0) - p.income) / nullif(abs(p.income), 0) AS d_income, (nullif(c.borrowings, 0) - p.borrowings) / nullif(abs(p.borrowings), 0) AS d_borrow
 FROM cy c LEFT JOIN cy p ON p.company = c.company AND p.year = c.year - 1)"""


def _years(t: Tables):
    return company.company_years(_long(t))


@query("pr21_financial_ratios", f"WITH {CY_SQL} SELECT company, year, {', '.join(f'round({c}, 6)::DOUBLE + 0 AS {c}' for c in RATIOS)} FROM rt")
def financial_ratios(t: Tables):
    return _rounded(company.financial_ratios(_years(t)), 6, *RATIOS).select("company", "year", *RATIOS)


INDUSTRY_SQL = " ".join(f"WHEN {int(code)} THEN '{name}'" for code, name in company.INDUSTRY.items())


@query("pr22_industry_label", f"SELECT p_partkey, CASE p_partkey % 90 {INDUSTRY_SQL} ELSE 'Other' END AS industry FROM part")
def industry_label(t: Tables):
    return t.read("part").select("p_partkey", company.industry_label(F.lpad((F.col("p_partkey") % 90).cast("string"), 2, "0")).alias("industry"))


@query("pr25_financial_reasons", f"""
WITH {CY_SQL}, w AS (SELECT company, year, list_transform(list_sort(list_filter([{{'o': -(1.5 - interest_cover), 'i': 0, 't': CASE WHEN interest_cover < 1.5 THEN 'interest barely covered' END}},
 {{'o': -(borrow_to_income - 1), 'i': 1, 't': CASE WHEN borrow_to_income > 1 THEN 'debt above a year''s income' END}}, {{'o': -loss_flag::DOUBLE, 'i': 2, 't': CASE WHEN loss_flag > 0 THEN 'loss in the year' END}},
 {{'o': -(0.02 - pat_margin), 'i': 3, 't': CASE WHEN pat_margin < 0.02 THEN 'net margin ' || round(abs(pat_margin) * 100)::BIGINT || '%' END}}], lambda x: x.o < 0 AND x.t IS NOT NULL))[1:3], lambda x: x.t) AS r FROM rt)
SELECT company, year, array_to_string(r, '; ') AS reasons FROM w""")
def financial_reasons(t: Tables):
    push = {"interest_cover": 1.5 - F.col("interest_cover"), "borrow_to_income": F.col("borrow_to_income") - 1, "loss_flag": F.col("loss_flag"),
            "pat_margin": 0.02 - F.col("pat_margin")}
    rows = company.financial_ratios(_years(t))
    why = reasons.reason_codes(push, {f: F.col(f) for f in push}, reasons.FINANCIAL_RULES)
    return rows.select("company", "year", F.array_join(why, "; ").alias("reasons"))


@query("jn05_prior_year", f"WITH {CY_SQL} SELECT c.company, c.year, p.income AS prior_income, p.company IS NOT NULL AS has_prior FROM cy c LEFT JOIN cy p ON p.company = c.company AND p.year = c.year - 1")
def prior_year(t: Tables):
    return company.with_prior_year(_years(t), ("income",)).select("company", "year", "prior_income", "has_prior")


@query("jn03_first_default_join", f"WITH {CY_SQL} SELECT cy.company, cy.year, default_year FROM cy LEFT JOIN fd USING (company)")
def first_default_join(t: Tables):
    return _years(t).select("company", "year").join(company.first_default_year(_events(t)), "company", "left")


@query("jn04_rated_companies", f"WITH {CY_SQL} SELECT company, year FROM cy WHERE company IN (SELECT company FROM ev)")
def rated_companies(t: Tables):
    return company.rated_only(_years(t).select("company", "year"), _events(t))


TRAIN_SQL = f"""{CY_SQL}, tr AS (SELECT company, year, CASE WHEN default_year <= year + 2 THEN 1 ELSE 0 END AS "default" FROM (SELECT DISTINCT company, year FROM long WHERE measure = 'Net worth') LEFT JOIN fd USING (company)
 WHERE CASE WHEN default_year IS NOT NULL THEN year < default_year ELSE year + 2 <= 2001 END)"""


def _training(t: Tables):
    return company.training_rows(_years(t), company.first_default_year(_events(t)), 2001)


@query("fl10_as_of_training_frame", f'WITH {TRAIN_SQL} SELECT company, year, "default" FROM tr')
def as_of_training_frame(t: Tables):
    return _training(t).select("company", "year", "default")


HASHED = "('0x' || substr(md5(company), 1, 8))::BIGINT % 1000"


@query("jn08_company_disjoint_training", f'WITH {TRAIN_SQL} SELECT company, year FROM tr WHERE year < 1998 AND company NOT IN (SELECT company FROM tr WHERE year >= 1999 AND "default" = 1)')
def company_disjoint_training(t: Tables):
    rows = _training(t)
    held = rows.where((F.col("year") >= 1999) & (F.col("default") == 1)).select("company").distinct()
    return rows.where(F.col("year") < 1998).join(held, "company", "left_anti").select("company", "year")


@query("sp04_split_designs", f"""
WITH {TRAIN_SQL}, d AS (SELECT 'temporal' AS design, CASE WHEN year <= 1997 THEN 'train' ELSE 'test' END AS side, company, year FROM tr UNION ALL
 SELECT 'temporal_disjoint', CASE WHEN year <= 1997 THEN 'train' ELSE 'test' END, company, year FROM tr WHERE (year <= 1997 AND {HASHED} >= 300) OR (year > 1997 AND {HASHED} < 300) UNION ALL
 SELECT 'temporal_lag', CASE WHEN year <= 1995 THEN 'train' ELSE 'test' END, company, year FROM tr WHERE year <= 1995 OR year > 1997)
SELECT design, side, count(*) AS n, count(DISTINCT company) AS companies FROM d GROUP BY 1, 2""")
def split_designs(t: Tables):
    rows = _training(t).select("company", "year")
    side, fold = F.when(F.col("year") <= 1997, "train").otherwise("test"), group_split(F.col("company"))
    disjoint = F.when(side == fold, side)
    lagged = F.when(F.col("year") <= 1995, "train").when(F.col("year") > 1997, "test")
    cells = F.array(*[F.struct(F.lit(d).alias("design"), s.alias("side")) for d, s in (
        ("temporal", side), ("temporal_disjoint", disjoint), ("temporal_lag", lagged))])
    long = rows.select("company", F.explode(cells).alias("c")).where(F.col("c.side").isNotNull()).groupBy(
        F.col("c.design").alias("design"), F.col("c.side").alias("side"), "company").agg(F.count("*").alias("n"))
    return long.groupBy("design", "side").agg(F.sum("n").alias("n"), F.count("*").alias("companies"))


@query("ag26_company_coverage", f"""
WITH {CY_SQL}, p AS (SELECT company, count(DISTINCT year) AS n_years FROM cy GROUP BY 1)
SELECT n_years, count(*) AS companies, (SELECT median(n_years) FROM p)::DOUBLE AS median_years, round((SELECT avg(n_years) FROM p), 6) AS mean_years FROM p GROUP BY 1""")
def company_coverage(t: Tables):
    return _rounded(company.company_coverage(_years(t)), 6, "mean_years")


@query("ag27_censoring_profile", f'WITH {TRAIN_SQL} SELECT year, count(*) AS n, round(avg("default"), 6) AS positive_rate FROM tr GROUP BY 1')
def censoring_profile(t: Tables):
    return _rounded(company.censoring_profile(_training(t)), 6, "positive_rate")


# ---- bank files ----------------------------------------------------------------

@query("io07_read_pull_manifest", """
SELECT (o_orderkey % 40)::VARCHAR AS api_id, CASE WHEN o_orderkey % 40 < 30 THEN 200 ELSE 503 END AS http_status, count(*) AS n_records, CASE WHEN o_orderkey % 40 < 30 THEN 'approved' ELSE 'pending' END AS subscription_status,
 CASE WHEN o_orderkey % 40 % 3 > 0 THEN (100 + o_orderkey % 40)::INT END AS latency_ms, CASE WHEN o_orderkey % 40 >= 30 THEN 'awaiting approval' END AS error FROM orders GROUP BY o_orderkey % 40""")
def read_pull_manifest(t: Tables):
    api = F.col("o_orderkey") % 40
    per = t.read("orders").groupBy(api.alias("a")).agg(F.count("*").alias("n"))
    entry = F.struct(
        F.when(F.col("a") < 30, 200).otherwise(503).alias("http_status"), F.col("n").alias("n_records"),
        F.when(F.col("a") < 30, "BANK_API").otherwise("FIXTURE").alias("provenance"), F.when(F.col("a") % 3 > 0, 100.0 + F.col("a")).alias("latency_ms"),
        F.when(F.col("a") >= 30, "awaiting approval").alias("reason"))
    path = _folder(t, "manifest")
    # forty calls: one document
    per.agg(F.map_from_entries(F.collect_list(F.struct(F.col("a").cast("string"), entry))).alias("apis")).withColumn(
        "generated_at", F.lit("2026-01-01")).write.json(path)
    return pulls.read_pull_manifest(t.spark, path).select("api_id", "http_status", "n_records", "subscription_status", "latency_ms", "error")


@query("io08_identity_fixture_check", """
SELECT count(*) FILTER (account_id % 7 = 0) AS missing_keys, count(*) FILTER (account_id % 10 = 3) AS wrong_tag, 0::BIGINT AS wrong_mode, 8 - count(DISTINCT portfolio) AS missing_portfolios FROM acc""")
def identity_fixture_check(t: Tables):
    key = F.col("account_id")
    row = F.struct(
        F.concat(F.lit("A"), key).alias("account_id"), F.when(key % 7 != 0, F.concat(F.lit("9"), key)).alias("cif_id"), "portfolio", "constitution", "secured",
        F.col("sanctioned").alias("sanctioned_amount"), F.lit(0.0).alias("dpd"), F.lit("STD").alias("npa_status"), F.lit(1.0).alias("outstanding"),
        F.lit(0.1).alias("interest_rate_pa"), F.lit("B1").alias("branch_code"), F.lit("E1").alias("rm_ein"),
        F.when(key % 10 == 3, "SIMULATED").otherwise("FIXTURE").alias("_provenance"))
    path = _folder(t, "fixture")
    # a document per hundred accounts, each the shape of a fixture file
    docs = t.accounts().groupBy(F.floor(key / 100).alias("g")).agg(F.collect_list(row).alias("accounts"))
    docs.select(F.struct(F.lit("fixture").alias("mode"), F.lit("2026-01-01").alias("generated_at")).alias("_meta"), "accounts").write.json(path)
    return pulls.fixture_violations(pulls.read_identity_fixture(t.spark, path, multiline=False), 8)
