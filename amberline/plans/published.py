"""Book, watch list, provenance, partner and gate queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from amberline.functions import display, reasons
from amberline.operators import book, gates, graph, joins, provenance
from amberline.operators.leads import sustained_lead
from amberline.plans.registry import Tables, query
from amberline.plans.summaries import _rounded
from amberline.plans.timeseries import LEAD_SQL, flagged
from amberline.session import work_dir
from amberline.sources import documents


def contributions():
    """Contributions of a transparent score: distance of each signal from its calm level."""
    return {
        "dpd": F.col("dpd") / 90, "utilisation": F.col("utilisation") - 0.7, "collection_ratio": 0.97 - F.col("collection_ratio"),
        "bureau_score": (650 - F.col("bureau_score")) / 1000.0, "vintage_months": (12 - F.col("vintage_months")) / 48.0,
    }


def _with_ratio(df):
    ratio = F.when(F.col("demanded") > 0, F.col("collected") / F.col("demanded")).otherwise(1.0)
    return df.withColumn("collection_ratio", F.round(ratio, 4))


def _reasons(df):
    return df.withColumn("reasons", reasons.reason_codes(contributions(), {f: F.col(f) for f in contributions()}))


REASON_SQL = """ratio AS (SELECT *, round(CASE WHEN demanded > 0 THEN collected / demanded ELSE 1 END, 4) AS cr FROM {source}),
cells AS (SELECT *, [{{'o': -dpd / 90, 'i': 0, 't': CASE WHEN dpd > 0 THEN round(dpd)::BIGINT || ' days in arrears' END}},
 {{'o': -(utilisation - 0.7), 'i': 1, 't': CASE WHEN utilisation > 0.75 THEN 'limit ' || round(utilisation * 100)::BIGINT || '% drawn' END}},
 {{'o': -(0.97::DOUBLE - cr), 'i': 2, 't': CASE WHEN cr < 0.95 THEN round(cr * 100)::BIGINT || '% of demand collected' END}},
 {{'o': -((650 - bureau_score) / 1000.0), 'i': 3, 't': CASE WHEN bureau_score < 650 THEN 'bureau score ' || bureau_score END}},
 {{'o': -((12 - vintage_months) / 48.0), 'i': 4, 't': CASE WHEN vintage_months < 12 THEN 'on book for under a year' END}}] AS c FROM ratio),
why AS (SELECT *, list_transform(list_sort(list_filter(c, lambda x: x.o < 0 AND x.t IS NOT NULL))[1:3], lambda x: x.t) AS reasons FROM cells)"""


@query("pr24_reason_codes", f"WITH {REASON_SQL.format(source='panel')} SELECT account_id, period, array_to_string(reasons, '; ') AS reasons FROM why")
def reason_codes(t: Tables):
    return _reasons(_with_ratio(t.panel())).select("account_id", "period", F.array_join("reasons", "; ").alias("reasons"))


CLASS_SQL = "CASE WHEN account_id % 3 = 0 THEN 'STD' WHEN account_id % 3 = 1 THEN 'SMA' ELSE 'not supplied, DPD ' || round(dpd)::BIGINT END"


def _classified(df):
    key = F.col("account_id")
    return df.withColumn("classification", display.observed_classification(
        F.when(key % 3 == 0, "STD").otherwise(""), F.when(key % 3 == 1, "SMA"), F.col("dpd")))


@query("pr26_alert_memo", f"""
WITH {REASON_SQL.format(source='book')} SELECT account_id, 'Review account ' || account_id || ' (' || portfolio || ', sanctioned ' || round(sanctioned)::BIGINT || '). Score ' || round(decision_score * 100)::BIGINT
 || '%, band red. Books: ' || {CLASS_SQL} || '. Drivers: ' || CASE WHEN len(reasons) > 0 THEN array_to_string(reasons, '; ') ELSE 'score level alone' END || '.' AS memo FROM why WHERE band = 'red'""")
def alert_memo(t: Tables):
    red = _classified(_reasons(_with_ratio(t.book()))).where(F.col("band") == "red")
    return red.select("account_id", display.alert_memo(
        F.col("account_id"), F.col("portfolio"), F.col("sanctioned"), F.col("decision_score"), F.col("classification"), F.col("reasons")).alias("memo"))


@query("pr27_observed_classification", f"SELECT account_id, {CLASS_SQL} AS classification FROM book")
def observed_classification(t: Tables):
    return _classified(t.book()).select("account_id", "classification")


@query("pr28_synthetic_cif", """SELECT c_custkey AS account_id, '9' || lpad(right(regexp_replace(c_name, '[^0-9]', '', 'g'), 8), 8, '0') AS cif FROM customer""")
def synthetic_cif(t: Tables):
    return t.read("customer").select(F.col("c_custkey").alias("account_id"), display.synthetic_cif(F.col("c_name")).alias("cif"))


@query("pr29_field_state", """
SELECT account_id, period, CASE WHEN portfolio = 'MACHINERY' AND period % 2 = 0 THEN 'observed' WHEN portfolio = 'FURNITURE' THEN 'unobserved' WHEN portfolio IN ('MACHINERY', 'BUILDING') THEN 'unobserved'
 ELSE 'not_applicable' END AS state FROM panel""")
def field_state(t: Tables):
    seen = F.when((F.col("portfolio") == "MACHINERY") & (F.col("period") % 2 == 0), F.col("utilisation"))
    channels = F.when(F.col("portfolio").isin("MACHINERY", "BUILDING"), F.array(F.lit("Utilisation "), F.lit("cashflow"))) \
        .when(F.col("portfolio") == "FURNITURE", F.array().cast("array<string>")).otherwise(F.array(F.lit("dpd")))
    return t.panel().select("account_id", "period", display.field_state(seen, "util_avg_3m", channels).alias("state"))


@query("pr29b_partner_and_profile_fields", """
SELECT account_id, period, CASE WHEN period % 3 = 0 THEN 'observed' WHEN portfolio = 'BUILDING' THEN 'not_applicable' ELSE 'unobserved' END AS partners,
 CASE WHEN portfolio IN ('BUILDING', 'MACHINERY') THEN 'unobserved' ELSE 'not_applicable' END AS sector FROM panel""")
def partner_and_profile_fields(t: Tables):
    channels = F.when(F.col("portfolio") == "BUILDING", F.array(F.lit("profile"))).when(
        F.col("portfolio") == "MACHINERY", F.array().cast("array<string>")).otherwise(F.array(F.lit("ecosystem")))
    partners = F.when(F.col("period") % 3 == 0, F.col("txn_count"))
    return t.panel().select("account_id", "period", display.field_state(partners, "eco_partners", channels).alias("partners"),
                            display.field_state(F.lit(None).cast("string"), "sector", channels).alias("sector"))


@query("pr30_normalise_channels", """
WITH c AS (SELECT o_orderkey, unnest(CASE o_orderkey % 4
 WHEN 0 THEN [{'channel': 'cash_flow', 'label': 'Account inflows', 'present': true, 'family': 'cashflow', 'source': 'FIXTURE', 'n_fields': 3}, {'channel': 'gst', 'label': 'GST filings', 'present': true, 'family': 'filings', 'source': 'FIXTURE', 'n_fields': 2}]
 WHEN 1 THEN [{'channel': 'repayment', 'label': 'Dues', 'present': true, 'family': 'repayment', 'source': 'BANK_API', 'n_fields': 9}, {'channel': 'utilisation', 'label': 'Limit utilisation', 'present': false, 'family': 'exposure', 'source': 'FIXTURE', 'n_fields': 4}]
 WHEN 2 THEN [{'channel': 'unknown', 'label': 'unknown', 'present': true, 'family': NULL, 'source': 'FIXTURE', 'n_fields': 0}, {'channel': 'bureau', 'label': 'Bureau', 'present': true, 'family': 'score', 'source': 'FIXTURE', 'n_fields': 2}]
 ELSE [] END) AS c FROM orders)
SELECT o_orderkey, c.channel, c.label, c.present, c.family, c.source, c.n_fields::INT AS n_fields FROM c""")
def normalise_channels(t: Tables):
    """Bare names and objects in one list; a text that is no list gives no row."""
    key = F.col("o_orderkey")
    text = F.when(key % 4 == 0, '[" CashFlow", "filings"]').when(
        key % 4 == 1, '[{"channel": "DPD", "label": "Dues", "source": "BANK_API"}, {"channel": "utilisation", "present": false}]').when(
        key % 4 == 2, '["unknown", {"channel": "Bureau", "family": "score", "fields": ["bureau_score", "enquiries"]}]').otherwise("none")
    rows = t.read("orders").select("o_orderkey", F.explode(display.normalise_channels(display.channel_entries(text), F.lit("FIXTURE"))).alias("c"))
    return rows.select("o_orderkey", "c.channel", "c.label", "c.present", "c.family", "c.source", F.size("c.fields").alias("n_fields"))


@query("pr30b_channel_set", """
SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'cash_flow,gst' ELSE 'repayment' END AS channels FROM orders""")
def channel_set(t: Tables):
    text = F.when(F.col("o_orderkey") % 2 == 0, '["filings", "cashflow", "gst"]').otherwise('["dpd", {"channel": "ltv", "present": false}]')
    return t.read("orders").select("o_orderkey", F.array_join(display.channel_set(display.channel_entries(text)), ",").alias("channels"))


@query("pr31_sync_state", """
SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 OR o_orderstatus = 'F' AND o_orderkey % 5 = 0 THEN 'error' WHEN o_orderkey % 4 = 0 AND o_orderpriority = '1-URGENT' THEN 'pending' WHEN o_orderkey % 4 = 0 THEN 'never'
 WHEN o_orderkey % 4 = 1 THEN 'cached' WHEN o_orderkey % 4 = 2 THEN 'sandbox' WHEN o_orderkey % 7 = 0 THEN 'sandbox' ELSE 'ok' END AS state FROM orders""")
def sync_state(t: Tables):
    key = F.col("o_orderkey")
    status = F.when((F.col("o_orderstatus") == "F") & (key % 5 == 0), "503").otherwise("200")
    mode = F.when(key % 4 == 1, "cached").when(key % 4 == 2, "sandbox_fixture")
    subscription = F.when(F.col("o_orderpriority") == "1-URGENT", "Requested").otherwise("Approved")
    state = display.sync_state(status, subscription, F.when(key % 17 == 0, "timeout"), key % 4, mode, key % 7 != 0)
    return t.read("orders").select("o_orderkey", state.alias("state"))


@query("pr32_source_badge", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'FIXTURE' WHEN o_orderstatus = 'O' THEN 'BANK_API' ELSE 'NOT_COLLECTED' END AS run_badge,
 CASE WHEN o_orderstatus = 'F' THEN 'FIXTURE' WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 0 THEN 'BANK_API_CACHED' WHEN o_orderstatus = 'O' THEN 'BANK_API' ELSE 'NOT_COLLECTED' END AS family_badge FROM orders""")
def source_badge(t: Tables):
    word = F.when(F.col("o_orderstatus") == "F", "Fixture").when(F.col("o_orderstatus") == "O", "bank_api")
    return t.read("orders").select("o_orderkey", display.mode_badge(word).alias("run_badge"),
                                   display.family_badge(word, F.col("o_orderkey") % 2 == 0).alias("family_badge"))


def _watchlist(t: Tables):
    return book.watchlist_rows(t.book().withColumn("published_band", F.col("band")).drop("band"), 0.3, 0.45)


WATCH_SQL = "w AS (SELECT *, band AS published, CASE WHEN decision_score >= 0.45 THEN 'red' WHEN decision_score >= 0.3 THEN 'amber' ELSE 'green' END AS now FROM book)"


@query("pr35_watchlist_row", f"WITH {WATCH_SQL} SELECT account_id, published AS published_band, now AS band, published <> now AS band_moved FROM w")
def watchlist_row(t: Tables):
    return _watchlist(t).select("account_id", "published_band", "band", "band_moved")


@query("fl04_watchlist_query", f"""
WITH {WATCH_SQL} SELECT account_id, decision_score, sanctioned FROM w WHERE now = 'red' AND constitution = 'Company' AND secured = 1 ORDER BY decision_score DESC, account_id LIMIT 20 OFFSET 5""")
def watchlist_query(t: Tables):
    page = book.watchlist_query(_watchlist(t), band="red", constitution="Company", secured=True, limit=20, offset=5)
    return page.select("account_id", "decision_score", "sanctioned")


@query("fl05_watchlist_search", """
SELECT account_id, region, state, portfolio FROM book WHERE dpd > 0 AND dpd <= 30 AND sanctioned >= 1000000 AND sanctioned < 5000000
 AND (contains(lower(region), 'er') OR contains(lower(state), 'er') OR contains(lower(portfolio), 'er'))""")
def watchlist_search(t: Tables):
    hits = book.watchlist_search(t.book(), "ER", ("region", "state", "portfolio"), dpd="1-30", ticket="10Lto50L")
    return hits.select("account_id", "region", "state", "portfolio")


PICKS_SQL = f"""{LEAD_SQL}, bl AS (SELECT book.*, lead FROM book JOIN leads USING (account_id)),
p AS ((SELECT 0 AS k, -to_npa AS o, account_id FROM bl WHERE band = 'amber' AND to_npa BETWEEN 2 AND 4 ORDER BY o, account_id LIMIT 4)
 UNION ALL (SELECT 1, -lead AS o, account_id FROM bl WHERE band = 'red' AND to_npa > 0 ORDER BY o, account_id LIMIT 4)
 UNION ALL (SELECT 2, account_id AS o, account_id FROM bl WHERE band = 'green' AND to_npa = -1 ORDER BY o, account_id LIMIT 3))"""


@query("sp10_spotlight", f"WITH {PICKS_SQL} SELECT account_id, row_number() OVER (ORDER BY min(k), min(account_id)) AS place FROM (SELECT * FROM p WHERE false) GROUP BY 1 UNION ALL "
       f"SELECT account_id, row_number() OVER (ORDER BY k, o, account_id) FROM p")
def spotlight(t: Tables):
    leads = sustained_lead(t.panel(), flagged(), 4)
    return book.spotlight(t.book().join(leads, "account_id")).withColumn("place", F.col("place").cast("bigint"))


@query("st02_ordered_union", """
WITH p AS ((SELECT 0 AS k, -sanctioned AS o, account_id FROM book ORDER BY o, account_id LIMIT 10) UNION ALL (SELECT 1, -decision_score AS o, account_id FROM book ORDER BY o, account_id LIMIT 10)
 UNION ALL (SELECT 2, -sanctioned AS o, account_id FROM book WHERE band = 'red' ORDER BY o, account_id LIMIT 10)),
f AS (SELECT account_id, min({'k': k, 'o': o}) AS m FROM p GROUP BY 1) SELECT account_id, row_number() OVER (ORDER BY m, account_id) AS place FROM f""")
def ordered_union(t: Tables):
    rows = t.book()
    out = book.first_places([(rows, "-sanctioned", 10), (rows, "-decision_score", 10), (rows.where(F.col("band") == "red"), "-sanctioned", 10)])
    return out.withColumn("place", F.col("place").cast("bigint"))


@query("io10_timelines", """
SELECT account_id, n_points, round(first_score, 6) AS first_score, last_period FROM (SELECT account_id, count(*)::INT AS n_points, arg_min(decision_score, period) AS first_score, max(period) AS last_period
 FROM panel WHERE account_id IN (SELECT account_id FROM book) GROUP BY 1)""")
def timelines(t: Tables):
    points = ("decision_score", "dpd", "inflow")
    path = os.path.join(work_dir(t.spark), f"timelines-{uuid.uuid4().hex}")
    documents.write_timelines(t.panel(), t.book(), path, points)
    lines = t.spark.read.schema(book.timelines(t.panel(), t.book(), points).schema).json(path)
    return lines.select("account_id", F.size("timeline").alias("n_points"), F.col("timeline")[0]["decision_score"].alias("first_score"),
                        F.element_at("timeline", -1)["period"].alias("last_period"))


@query("io09_scored_book", f"""
WITH {REASON_SQL.format(source='book')} SELECT account_id, decision_score, CASE WHEN account_id % 9 = 0 THEN NULL ELSE round(pd, 6) END AS pd, band, len(reasons)::INT AS n_reasons,
 CASE WHEN account_id % 5 = 0 THEN 'FIXTURE' ELSE 'SIMULATED' END AS identity FROM why""")
def scored_book(t: Tables):
    """Writes the nested documents and reads them back."""
    rows = _reasons(_with_ratio(t.book())).withColumn("pd", F.when(F.col("account_id") % 9 == 0, float("nan")).otherwise(F.round("pd", 6)))
    source = F.when(F.col("account_id") % 5 == 0, "FIXTURE").otherwise("SIMULATED")
    rows = rows.withColumn("identity_source", source).withColumn("model_source", provenance.weakest(source, F.lit("SIMULATED")))
    path = os.path.join(work_dir(t.spark), f"scored-book-{uuid.uuid4().hex}")
    documents.write_scored_book(rows, path)
    back = t.spark.read.schema(documents.account_documents(rows).schema).json(path)
    return back.select("account_id", "scores.decision_score", "scores.pd", "band", F.size("reasons").alias("n_reasons"),
                       F.element_at("provenance", "identity").alias("identity"))


# ---- provenance ------------------------------------------------------------

API_IDS = ["442", "456", "394", "508", "391", "441", "402", "404", "393", "408"]


def _manifest(t: Tables):
    """One manifest row per order: which feed it came through and how it was obtained."""
    key = F.col("o_orderkey")
    api = F.element_at(F.array(*[F.lit(a) for a in API_IDS]), (key % 10 + 1).cast("int"))
    return t.read("orders").select("o_orderkey", api.alias("api_id"), F.when(key % 10 < 6, F.when(F.col("o_orderstatus") == "O", "BANK_API").otherwise("FIXTURE"))
                                   .otherwise("FIXTURE").alias("provenance"))


@query("pv01_weakest", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'FIXTURE' WHEN o_orderkey % 2 = 0 THEN 'SIMULATED' WHEN o_orderstatus = 'O' THEN 'BANK_API' ELSE 'SIMULATED' END AS model FROM orders""")
def weakest(t: Tables):
    by_status = F.when(F.col("o_orderstatus") == "F", "FIXTURE").when(F.col("o_orderstatus") == "O", "BANK_API")
    other = F.when(F.col("o_orderkey") % 2 == 0, "SIMULATED")
    return t.read("orders").select("o_orderkey", provenance.weakest(by_status, other).alias("model"))


FAMILY_SQL = """mf AS (SELECT ['442','456','394','508','391','441','402','404','393','408'][o_orderkey % 10 + 1] AS api, CASE WHEN o_orderkey % 10 < 6 AND o_orderstatus = 'O' THEN 'BANK_API' ELSE 'FIXTURE' END AS p FROM orders),
fam AS (SELECT f AS family, CASE WHEN f = 'filings' THEN 'SIMULATED' WHEN bool_or(p = 'BANK_API' AND list_contains(apis, api)) THEN 'BANK_API' ELSE 'FIXTURE' END AS source FROM mf, (VALUES ('identity', ['442','456','394','508']),
 ('exposure', ['391','441','362','433','473','538']), ('repayment', ['402','404']), ('cashflow', ['393']), ('bureau', ['408']), ('profile', ['456']), ('filings', [''])) v(f, apis) GROUP BY 1)"""


@query("pv02_family_sources", f"""
WITH {FAMILY_SQL}, a AS (SELECT * FROM fam UNION ALL SELECT 'model', CASE WHEN bool_or(source = 'FIXTURE') THEN 'FIXTURE' ELSE 'SIMULATED' END FROM fam)
SELECT family, source, CASE WHEN bool_and(source = 'BANK_API' OR family = 'model') OVER () THEN 'live' WHEN bool_or(source = 'BANK_API') OVER () THEN 'mixed' ELSE 'fixture' END AS mode FROM a""")
def family_sources(t: Tables):
    families = provenance.family_sources(_manifest(t), F.lit(True))
    return families.withColumn("mode", provenance.run_mode(families).scalar())


@query("pv03_account_provenance", """
SELECT account_id, CASE WHEN account_id % 45 = 0 THEN 'BANK_API' WHEN account_id % 9 = 0 THEN 'FIXTURE' ELSE 'SIMULATED' END AS identity, 'SIMULATED' AS other_families,
 CASE WHEN account_id % 45 = 0 THEN 'SIMULATED' WHEN account_id % 9 = 0 THEN 'FIXTURE' ELSE 'SIMULATED' END AS model FROM acc""")
def account_provenance(t: Tables):
    acc = t.accounts().select("account_id")
    run = provenance.family_sources(_manifest(t), F.lit(True)).where(F.col("family") == "identity").select("source").scalar()
    return provenance.account_provenance(acc, acc.where(F.col("account_id") % 9 == 0), acc.where(F.col("account_id") % 45 == 0), run)


@query("pv04_answered_ids", """SELECT DISTINCT id FROM (SELECT unnest([o_custkey::VARCHAR, 'C' || o_orderkey % 50]) AS id FROM orders WHERE o_orderstatus = 'O')""")
def answered_ids(t: Tables):
    body = F.to_json(F.struct(F.col("o_custkey").alias("acctId"), F.struct(F.concat(F.lit("C"), F.col("o_orderkey") % 50).alias("cifId"),
                                                                        F.col("o_totalprice").alias("amount")).alias("customer")))
    return provenance.answered_ids(t.read("orders").where(F.col("o_orderstatus") == "O").select(body.alias("record")))


@query("pv05_coalesce_with_source", """
SELECT account_id, coalesce(CASE WHEN account_id % 5 = 0 THEN bureau_score END, CASE WHEN account_id % 3 = 0 THEN 700 END, 600)::BIGINT AS score,
 CASE WHEN account_id % 5 = 0 AND bureau_score IS NOT NULL THEN 'live' WHEN account_id % 3 = 0 THEN 'capture' ELSE 'assumption' END AS source FROM acc""")
def coalesce_with_source(t: Tables):
    key = F.col("account_id")
    value, source = provenance.coalesce_with_source([
        ("live", F.when(key % 5 == 0, F.col("bureau_score"))), ("capture", F.when(key % 3 == 0, F.lit(700))), ("assumption", F.lit(600))])
    return t.accounts().select("account_id", value.cast("bigint").alias("score"), source.alias("source"))


@query("pv06_band_moved", f"WITH {WATCH_SQL} SELECT account_id, published <> now AS moved, abs(decision_score - 0.4) < 0.02 AS near_line FROM w")
def band_moved(t: Tables):
    rows = _watchlist(t)
    return rows.select("account_id", provenance.moved(F.col("band"), F.col("published_band")).alias("moved"),
                       (F.abs(F.col("decision_score") - 0.4) < 0.02).alias("near_line"))


@query("pv07_parameter_table", """
SELECT path, CASE WHEN p_size % 10 = 0 THEN 'no value' WHEN p_size % 4 = 3 THEN 'unknown confidence' ELSE 'no source' END AS problem FROM (SELECT 'part.' || p_partkey AS path, p_size, p_brand FROM part)
WHERE p_size % 10 = 0 OR p_size % 4 = 3 OR (p_size % 4 = 0 AND p_brand LIKE '%1')""")
def parameter_table(t: Tables):
    size = F.col("p_size")
    rows = t.read("part").select(
        F.concat(F.lit("part."), "p_partkey").alias("path"), F.when(size % 10 != 0, F.col("p_retailprice")).alias("value"),
        F.element_at(F.array(F.lit("sourced"), F.lit("derived"), F.lit("assumed"), F.lit("guess")), (size % 4 + 1).cast("int")).alias("confidence"),
        F.when(F.col("p_brand").endswith("1"), " ").otherwise(F.col("p_type")).alias("source"))
    return provenance.parameter_problems(rows).select("path", "problem")


# ---- partner links -----------------------------------------------------------

def _edges(t: Tables):
    """Buyer-supplier links: lines are reduced to (order, supplier) before the join; a link may come again for every order."""
    lines = t.read("lineitem").select("l_orderkey", "l_suppkey").distinct()
    pairs = lines.join(t.read("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.select(F.concat(F.lit("C"), "o_custkey").alias("src"), F.concat(F.lit("S"), "l_suppkey").alias("dst"))


def _partners(t: Tables):
    def banded(rows, key: str, prefix: str, balance: str, nation: str):
        return rows.select(F.concat(F.lit(prefix), key).alias("account_id"), F.col(nation).alias("nation"), F.col(balance).alias("sanctioned"),
                           F.when(F.col(balance) < 0, "red").when(F.col(balance) < 2000, "amber").otherwise("green").alias("band"))

    return banded(t.read("customer"), "c_custkey", "C", "c_acctbal", "c_nationkey").unionByName(
        banded(t.read("supplier"), "s_suppkey", "S", "s_acctbal", "s_nationkey"))


GRAPH_SQL = """e AS (SELECT DISTINCT 'C' || o_custkey AS c, 'S' || l_suppkey AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
sy AS (SELECT c AS a, s AS b FROM e UNION ALL SELECT s, c FROM e),
ac AS (SELECT 'C' || c_custkey AS account_id, c_nationkey AS nation, c_acctbal AS sanctioned FROM customer UNION ALL SELECT 'S' || s_suppkey, s_nationkey, s_acctbal FROM supplier),
bd AS (SELECT *, CASE WHEN sanctioned < 0 THEN 'red' WHEN sanctioned < 2000 THEN 'amber' ELSE 'green' END AS band FROM ac),
pc AS (SELECT x.account_id, x.nation, x.band, x.sanctioned, count(y.account_id) AS partners, count(*) FILTER (y.band <> 'green') AS flagged, count(*) FILTER (y.band = 'red') AS red
 FROM bd x LEFT JOIN sy ON sy.a = x.account_id LEFT JOIN bd y ON y.account_id = sy.b GROUP BY 1, 2, 3, 4)"""


@query("gr01_partner_counts", f"WITH {GRAPH_SQL} SELECT account_id, band, partners, flagged, red FROM pc")
def partner_counts(t: Tables):
    return graph.partner_counts(_partners(t), _edges(t)).select("account_id", "band", "partners", "flagged", "red")


@query("jn15_neighbour_bands", f"WITH {GRAPH_SQL} SELECT sy.a AS account_id, bd.band AS partner_band, count(*) AS n FROM sy JOIN bd ON bd.account_id = sy.b GROUP BY 1, 2")
def neighbour_bands(t: Tables):
    return graph.with_partner_band(_partners(t), _edges(t)).groupBy("account_id", "partner_band").agg(F.count("*").alias("n"))


@query("gr02_one_link_from_red", f"""
WITH {GRAPH_SQL} SELECT nation, count(*) FILTER (band = 'green') AS n_green, count(*) FILTER (band = 'amber') AS n_amber, round(sum(sanctioned), 1) AS exposure
FROM pc WHERE red >= 1 AND band <> 'red' GROUP BY 1 ORDER BY sum(sanctioned) DESC, nation LIMIT 6""")
def one_link_from_red(t: Tables):
    return _rounded(graph.one_link_from_red(graph.partner_counts(_partners(t), _edges(t)), "nation"), 1, "exposure")


# ---- gates -------------------------------------------------------------------

def _results(t: Tables):
    """Measured cells: label rate per portfolio, overall rate and the rising rates by quarter of the year."""
    per = t.eligible().groupBy("portfolio").agg(F.avg("went_bad").alias("value"), F.count("*").alias("n"))
    rate = per.select(F.lit("A-01").alias("criterion_id"), F.col("portfolio").alias("level"), F.col("value"), "n",
                      F.ascii(F.col("portfolio")).alias("cell"))
    whole = t.eligible().agg(F.avg("went_bad").alias("value"), F.count("*").alias("n"))
    more = whole.select(F.explode(F.array(*[F.lit(c) for c in ("A-02", "A-03", "A-05", "A-09")])).alias("criterion_id"),
                        F.lit("all").alias("level"), "value", "n", F.lit(0).alias("cell"))
    return rate.unionByName(more).withColumn("series", F.array(F.lit(0.0), F.col("value")))


CRITERIA = [("A-01", "le", 0.0262, None, 6000, "fail"), ("A-02", "between", 0.01, 0.03, 0, "fail"), ("A-03", "ge", 0.5, None, 0, "warn"),
            ("A-04", "ge", 0.5, None, 0, "fail"), ("A-05", "monotone_increasing", None, None, 0, "fail")]


def _criteria(t: Tables):
    cells = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, k, n in zip(row, ("string", "string", "double", "double", "bigint", "string"),
                                                                              ("criterion_id", "op", "lo", "hi", "min_n", "severity"))]) for row in CRITERIA])
    return t.read("region").agg(F.count("*").alias("_n")).select(F.explode(cells).alias("c")).select("c.*")


GATE_SQL = """res AS (SELECT 'A-01' AS criterion_id, portfolio AS level, avg(went_bad) AS value, count(*) AS n, ascii(portfolio) AS cell FROM eligible GROUP BY 2
 UNION ALL SELECT c, 'all', v, n, 0 FROM (SELECT avg(went_bad) AS v, count(*) AS n FROM eligible), (SELECT unnest(['A-02', 'A-03', 'A-05', 'A-09']) AS c)),
crit AS (SELECT * FROM (VALUES ('A-01', 'le', 6000, 'fail'), ('A-02', 'between', 0, 'fail'), ('A-03', 'ge', 0, 'warn'), ('A-04', 'ge', 0, 'fail'), ('A-05', 'monotone_increasing', 0, 'fail')) v(criterion_id, op, min_n, severity)),
gr AS (SELECT criterion_id, op, level, value, n, cell, CASE WHEN op IS NULL THEN 'error' WHEN level IS NULL THEN 'pending' WHEN min_n > 0 AND n < min_n THEN 'skipped_low_n'
 WHEN CASE criterion_id WHEN 'A-01' THEN value <= 0.0262 WHEN 'A-02' THEN value BETWEEN 0.01 AND 0.03 WHEN 'A-03' THEN value >= 0.5 WHEN 'A-05' THEN value > 0 END THEN 'pass' ELSE severity END AS status FROM crit FULL JOIN res USING (criterion_id)),
sv AS (SELECT *, list_position(['pass', 'report', 'skipped_low_n', 'warn', 'pending', 'fail', 'error'], status) AS s FROM gr)"""


def _graded(t: Tables):
    return gates.grade_cells(gates.criteria_with_results(_criteria(t), _results(t)))


@query("gt01_check", f"WITH {GATE_SQL} SELECT criterion_id, level, CASE WHEN op IS NULL OR level IS NULL THEN NULL WHEN criterion_id = 'A-01' THEN value <= 0.0262 WHEN criterion_id = 'A-02' THEN value BETWEEN 0.01 AND 0.03 "
       "WHEN criterion_id = 'A-03' THEN value >= 0.5 ELSE value > 0 END AS passed FROM gr")
def check(t: Tables):
    joined = gates.criteria_with_results(_criteria(t), _results(t))
    passed = gates.check(F.col("op"), F.col("value"), F.col("lo"), F.col("hi"), F.col("series"))
    return joined.select("criterion_id", "level", passed.alias("passed"))


@query("jn14_criteria_with_results", f"WITH {GATE_SQL} SELECT criterion_id, level, CASE WHEN op IS NULL THEN 'error' WHEN level IS NULL THEN 'pending' END AS preset FROM gr")
def criteria_with_results(t: Tables):
    return gates.criteria_with_results(_criteria(t), _results(t)).select("criterion_id", "level", "preset")


@query("gt02_grade_cells", f"WITH {GATE_SQL} SELECT criterion_id, level, round(value, 6) AS value, n, status FROM gr")
def grade_cells(t: Tables):
    return _graded(t).select("criterion_id", "level", F.round("value", 6).alias("value"), "n", "status")


@query("gt03_worst_of", f"""
WITH {GATE_SQL}, w AS (SELECT criterion_id, status, level, value, n, row_number() OVER (PARTITION BY criterion_id ORDER BY s DESC, cell, level) AS rn FROM sv)
SELECT criterion_id, status, CASE WHEN status <> 'pass' THEN level END AS level, CASE WHEN status <> 'pass' THEN round(value, 6) END AS value, CASE WHEN status <> 'pass' THEN n END AS n FROM w WHERE rn = 1""")
def worst_of(t: Tables):
    return _rounded(gates.worst_of(_graded(t)), 6, "value")


@query("gt04_verdict", f"""
WITH {GATE_SQL} SELECT CASE WHEN bool_or(status IN ('fail', 'error')) THEN 'FAIL' WHEN bool_or(status = 'pending') THEN 'PASS_PENDING' ELSE 'PASS' END AS plain,
 CASE WHEN bool_or(status IN ('fail', 'error', 'warn', 'pending')) THEN 'FAIL' ELSE 'PASS' END AS strict FROM gr WHERE criterion_id IN ('A-02', 'A-03', 'A-05')""")
def verdict(t: Tables):
    rows = _graded(t).where(F.col("criterion_id").isin("A-02", "A-03", "A-05"))
    return gates.verdict(rows).select(F.col("verdict").alias("plain"), gates.verdict(rows, strict=True).scalar().alias("strict"))


@query("gt05_summarise_breakdown", f"""
WITH {GATE_SQL} SELECT criterion_id, op, round(CASE WHEN count(value) = count(*) THEN CASE op WHEN 'ge' THEN min(value) WHEN 'le' THEN max(value) END END, 6) AS binding_value,
 count(*) FILTER (status = 'pass') AS n_pass, count(*) AS n_cells FROM gr GROUP BY 1, 2""")
def summarise_breakdown(t: Tables):
    return _rounded(gates.summarise_breakdown(_graded(t)), 6, "binding_value")


# ---- sets --------------------------------------------------------------------

@query("st01_symmetric_difference", """
SELECT count(*) FILTER (only_in = 'panel') AS only_panel, count(*) FILTER (only_in = 'accounts') AS only_accounts FROM (
 SELECT DISTINCT o_custkey AS a, 'panel' AS only_in FROM orders WHERE o_custkey % 7 > 0 AND o_custkey % 5 = 0 UNION ALL SELECT c_custkey, 'accounts' FROM customer WHERE c_custkey % 5 > 0
 AND (c_custkey % 7 = 0 OR c_custkey NOT IN (SELECT o_custkey FROM orders)))""")
def symmetric_difference(t: Tables):
    active = t.read("orders").where(F.col("o_custkey") % 7 > 0).select(F.col("o_custkey").alias("account_id"))
    known = t.accounts().where(F.col("account_id") % 5 > 0)
    one_sided = joins.id_bijection(active, known)
    return one_sided.agg(F.count(F.when(F.col("only_in") == "panel", 1)).alias("only_panel"),
                         F.count(F.when(F.col("only_in") == "accounts", 1)).alias("only_accounts"))


@query("st03_union_of_levels", "SELECT DISTINCT portfolio AS level FROM panel UNION SELECT region FROM panel")
def union_of_levels(t: Tables):
    rows = t.panel().select("portfolio", "region")
    return rows.select(F.explode(F.array("portfolio", "region")).alias("level")).distinct()


# what each portfolio's own block carries besides the keys
BLOCKS = {"MACHINERY": ("utilisation",), "BUILDING": (), "HOUSEHOLD": ("inflow",), "AUTOMOBILE": ("txn_count", "dpd"), "FURNITURE": ("utilisation", "inflow")}
CARRIED = ("utilisation", "inflow", "txn_count", "dpd")


def _block_sql(column: str) -> str:
    held = ", ".join(f"'{p}'" for p, columns in BLOCKS.items() if column in columns)
    return f"CASE WHEN portfolio IN ({held}) THEN {'round(utilisation, 6)' if column == 'utilisation' else column} END AS {column}"


@query("st04_union_of_portfolio_blocks", f"SELECT account_id, period, portfolio, {', '.join(map(_block_sql, CARRIED))} FROM panel")
def union_of_portfolio_blocks(t: Tables):
    """Every portfolio's block, each with its own columns, as one book."""
    panel = t.stored(t.panel(), "account_id", "period", "portfolio", *CARRIED)
    known = panel.where(F.col("portfolio").isin(*BLOCKS))
    blocks = [known.where(F.col("portfolio") == p).select("account_id", "period", "portfolio", *columns) for p, columns in BLOCKS.items()]
    blocks.append(panel.where(~F.col("portfolio").isin(*BLOCKS)).select("account_id", "period", "portfolio"))
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block, allowMissingColumns=True)
    return out.withColumn("utilisation", F.round("utilisation", 6))
