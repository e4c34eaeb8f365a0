"""Where each number came from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.config import ALWAYS_SIMULATED, FAMILY_APIS, SOURCE_RANK

ID_FIELDS = ("acctId", "accountNumber", "accountNo", "accountId", "account_id", "custCifId", "cifId", "cif_id",
             "customerID", "custId", "customerId", "foracid")  # fixed values


def weakest(*sources: Column) -> Column:
    """The weakest of several sources; SIMULATED when none is known."""
    order = F.array(*[F.lit(s) for s in SOURCE_RANK])
    ranks = F.filter(F.transform(F.array(*sources), lambda s: F.array_position(order, s)), lambda r: r > 0)
    return F.coalesce(F.try_element_at(order, F.array_min(ranks).cast("int")), F.lit("SIMULATED"))


def family_sources(manifest: DataFrame, has_fixture: Column) -> DataFrame:
    """Source of each family for the run, from a manifest (api_id, provenance).

    ``has_fixture`` is a one-value scalar. The families are a fixed short list,
    the manifest is combined to one row before the rows are laid out.
    """
    answered = {f: F.max((F.col("api_id").isin(*apis) & (F.col("provenance") == "BANK_API"))) for f, apis in FAMILY_APIS.items()}
    one = manifest.agg(*[F.coalesce(a, F.lit(False)).alias(f) for f, a in answered.items()]).withColumn("_fixture", has_fixture)
    fallback = F.when(F.col("_fixture"), "FIXTURE").otherwise("SIMULATED")
    known = {f: F.when(F.col(f), "BANK_API").otherwise(fallback) for f in FAMILY_APIS}
    known |= {f: F.lit("SIMULATED") for f in ALWAYS_SIMULATED}
    rows = [F.struct(F.lit(f).alias("family"), s.alias("source")) for f, s in known.items()]
    rows.append(F.struct(F.lit("model").alias("family"), weakest(*known.values()).alias("source")))
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def run_mode(families: DataFrame) -> DataFrame:
    """live, mixed or fixture, from the non-model families."""
    one = families.where(F.col("family") != "model").agg(
        F.min(F.col("source") == "BANK_API").alias("every"), F.max(F.col("source") == "BANK_API").alias("some"))
    return one.select(F.when(F.col("every"), "live").when(F.col("some"), "mixed").otherwise("fixture").alias("mode"))


def account_provenance(accounts: DataFrame, fixture_ids: DataFrame, answered: DataFrame, identity_source: Column) -> DataFrame:
    """Per-account sources: identity by evidence about this account, the rest simulated."""
    joined = (accounts.select("account_id").join(fixture_ids.select("account_id").distinct().withColumn("_f", F.lit(True)), "account_id", "left")
              .join(answered.select("account_id").distinct().withColumn("_a", F.lit(True)), "account_id", "left"))
    run = joined.withColumn("_run", identity_source)
    identity = (F.when((F.col("_run") == "BANK_API") & F.col("_a"), "BANK_API")
                .when(F.col("_f"), F.when(F.col("_run") == "BANK_API", "FIXTURE").otherwise(F.col("_run"))).otherwise("SIMULATED"))
    return run.withColumn("identity", identity).select(
        "account_id", "identity", F.lit("SIMULATED").alias("other_families"), weakest(F.col("identity"), F.lit("SIMULATED")).alias("model"))


def answered_ids(records: DataFrame, text: str = "record") -> DataFrame:
    """Identifier values anywhere in nested JSON records: whole strings and numbers; nulls and nested values are none."""
    field = rf'"(?:{"|".join(ID_FIELDS)})"\s*:\s*'
    strings = F.regexp_extract_all(F.col(text), F.lit(field + r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    numbers = F.regexp_extract_all(F.col(text), F.lit(field + r"(-?[0-9][0-9.eE+-]*)"), F.lit(1))
    ids = F.explode(F.concat(strings, numbers)).alias("id")
    return records.select(ids).where(F.col("id") != "").distinct()


def coalesce_with_source(candidates: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """First known value and the name of where it came from."""
    value = F.coalesce(*[c for _, c in candidates])
    source = reduce(lambda acc, nc: acc.when(nc[1].isNotNull(), F.lit(nc[0])), candidates[1:],
                    F.when(candidates[0][1].isNotNull(), F.lit(candidates[0][0])))
    return value, source


def moved(now: Column, then: Column) -> Column:
    """Null-safe inequality: TRUE when the value differs or appeared or vanished."""
    return ~now.eqNullSafe(then)


def parameter_problems(parameters: DataFrame) -> DataFrame:
    """Parameters (path, value, confidence, source) that break the documentation rules."""
    known = F.col("confidence").isin("sourced", "derived", "assumed")
    problem = (F.when(F.col("value").isNull(), "no value").when(~F.coalesce(known, F.lit(False)), "unknown confidence")
               .when((F.col("confidence") == "sourced") & (F.coalesce(F.trim("source"), F.lit("")) == ""), "no source"))
    return parameters.withColumn("problem", problem).where(F.col("problem").isNotNull())


__all__ = ["account_provenance", "answered_ids", "coalesce_with_source", "family_sources", "moved",
           "parameter_problems", "run_mode", "weakest"]
