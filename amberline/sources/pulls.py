"""Bank pull manifests and identity fixtures (nested JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = ("struct<http_status:int,n_records:bigint,provenance:string,latency_ms:double,reason:string,records:array<string>>")
MANIFEST_SCHEMA = f"generated_at string, apis map<string,{ENTRY}>"
FIXTURE_SCHEMA = ("_meta struct<mode:string,generated_at:string>, accounts array<struct<account_id:string,cif_id:string,portfolio:string,"
                  "constitution:string,secured:int,sanctioned_amount:double,dpd:double,npa_status:string,outstanding:double,"
                  "interest_rate_pa:double,branch_code:string,rm_ein:string,_provenance:string>>")
# fixed values: keys every fixture account must carry
REQUIRED = ("account_id", "cif_id", "portfolio", "constitution", "secured", "sanctioned_amount", "dpd", "npa_status",
            "outstanding", "interest_rate_pa", "branch_code", "rm_ein", "_provenance")


def read_pull_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per called API."""
    doc = spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)
    rows = doc.select("generated_at", F.explode("apis").alias("api_id", "e"))
    return rows.select(
        "api_id", F.coalesce("e.http_status", F.lit(0)).alias("http_status"), F.coalesce("e.n_records", F.lit(0)).alias("n_records"),
        F.when(F.col("e.provenance") == "BANK_API", "approved").otherwise("pending").alias("subscription_status"),
        F.col("e.latency_ms").cast("int").alias("latency_ms"), F.nullif("e.reason", F.lit("")).alias("error"),
        F.col("e.provenance").alias("provenance"), F.col("e.records").alias("records"))


def read_identity_fixture(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """One row per covered account. ``multiline`` is for one indented document, else one document per line."""
    return spark.read.schema(FIXTURE_SCHEMA).json(path, multiLine=multiline).select(
        F.col("_meta.mode").alias("mode"), F.explode("accounts").alias("a")).select("mode", "a.*")


def fixture_violations(fixture: DataFrame, portfolios: int) -> DataFrame:
    """Counts of what makes a fixture unusable; all zero when it is fine."""
    missing = F.lit(False)
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    return fixture.agg(
        F.count(F.when(missing, 1)).alias("missing_keys"), F.count(F.when(~F.col("_provenance").eqNullSafe(F.lit("FIXTURE")), 1)).alias("wrong_tag"),
        F.count(F.when(~F.col("mode").eqNullSafe(F.lit("fixture")), 1)).alias("wrong_mode"),
        (F.lit(portfolios) - F.count_distinct("portfolio")).alias("missing_portfolios"))
