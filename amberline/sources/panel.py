"""Panel and account tables: explicit schemas, NULL for anything unobserved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Contract:
    """A column as files carry it: name, type, and decimals kept (None: as it is)."""

    name: str
    kind: T.DataType
    decimals: int | None = None


# fixed values: the panel's columns in file order, with their types and decimals
PANEL = (
    Contract("account_id", T.StringType()),
    Contract("month_idx", T.IntegerType()),
    Contract("date", T.StringType()),
    Contract("sector", T.StringType()),
    Contract("region", T.StringType()),
    Contract("loan_type", T.StringType()),
    Contract("segment", T.StringType()),
    Contract("qualification", T.StringType()),
    Contract("promoter_age_group", T.StringType()),
    Contract("log_sanctioned", T.DoubleType()),
    Contract("business_age_years", T.IntegerType()),
    Contract("vintage_months", T.IntegerType()),
    Contract("dpd", T.DoubleType(), 1),
    Contract("utilisation", T.DoubleType(), 4),
    Contract("inflow", T.DoubleType(), 1),
    Contract("gst_sales", T.DoubleType(), 1),
    Contract("txn_count", T.LongType(), 0),
    Contract("bounce", T.IntegerType(), 0),
    Contract("minbal_breach", T.IntegerType(), 0),
    Contract("adverse_remark", T.LongType(), 0),
    Contract("dpd_max_6m", T.DoubleType(), 1),
    Contract("times_late_6m", T.IntegerType(), 0),
    Contract("bounces_6m", T.IntegerType(), 0),
    Contract("minbal_breach_6m", T.IntegerType(), 0),
    Contract("util_avg_3m", T.DoubleType(), 4),
    Contract("util_max_6m", T.DoubleType(), 4),
    Contract("months_over_90pct_util_6m", T.LongType(), 0),
    Contract("inflow_trend_3m", T.DoubleType(), 4),
    Contract("inflow_vs_6m_avg", T.DoubleType(), 4),
    Contract("sales_trend_3m", T.DoubleType(), 4),
    Contract("txn_drop_flag", T.LongType(), 0),
    Contract("adverse_remark_6m", T.LongType(), 0),
    Contract("portfolio", T.StringType()),
    Contract("constitution", T.StringType()),
    Contract("state", T.StringType()),
    Contract("city_tier", T.StringType()),
    Contract("nic_group", T.StringType()),
    Contract("secured", T.IntegerType()),
    Contract("tenor_months", T.IntegerType()),
    Contract("interest_rate_pa", T.DoubleType(), 4),
    Contract("vintage_band", T.StringType()),
    Contract("outstanding", T.LongType(), 0),
    Contract("demanded_amount", T.LongType(), 0),
    Contract("collected_amount", T.LongType(), 0),
    Contract("collection_ratio", T.DoubleType(), 4),
    Contract("collection_ratio_3m", T.DoubleType(), 4),
    Contract("balance", T.LongType(), 0),
    Contract("min_balance_6m", T.LongType(), 0),
    Contract("bureau_score", T.LongType(), 0),
    Contract("drawing_power", T.LongType(), 0),
    Contract("salary_credit", T.LongType(), 0),
    Contract("salary_vs_6m_avg", T.DoubleType(), 4),
    Contract("salary_gap_6m", T.LongType(), 0),
    Contract("other_bank_emi", T.LongType(), 0),
    Contract("emi_burden_ratio", T.DoubleType(), 4),
    Contract("ltv", T.DoubleType(), 4),
    Contract("ltv_vs_schedule", T.DoubleType(), 4),
    Contract("rental_income", T.LongType(), 0),
    Contract("rental_vs_6m_avg", T.DoubleType(), 4),
    Contract("crop_receipt", T.LongType(), 0),
    Contract("crop_receipt_vs_norm", T.DoubleType(), 4),
    Contract("renewal_overdue_months", T.LongType(), 0),
    Contract("moratorium_active", T.LongType(), 0),
    Contract("months_since_moratorium_end", T.LongType(), 0),
    Contract("commute_spend", T.LongType(), 0),
    Contract("commute_vs_6m_avg", T.DoubleType(), 4),
    Contract("default_within_12m", T.IntegerType()),
    Contract("sma2_within_6m", T.IntegerType()),
    Contract("labelable", T.IntegerType()),
    Contract("months_to_npa", T.IntegerType()),
)

# fixed values: the account table's columns
ACCOUNTS = (
    Contract("account_id", T.StringType()),
    Contract("sector", T.StringType()),
    Contract("region", T.StringType()),
    Contract("loan_type", T.StringType()),
    Contract("segment", T.StringType()),
    Contract("qualification", T.StringType()),
    Contract("promoter_age_group", T.StringType()),
    Contract("portfolio", T.StringType()),
    Contract("constitution", T.StringType()),
    Contract("state", T.StringType()),
    Contract("city_tier", T.StringType()),
    Contract("nic_group", T.StringType()),
    Contract("sanctioned_amount", T.DoubleType()),
    Contract("interest_rate_pa", T.DoubleType()),
    Contract("transient_arrears", T.DoubleType()),
    Contract("vintage_months_0", T.IntegerType()),
    Contract("business_age_years", T.IntegerType()),
    Contract("secured", T.IntegerType()),
    Contract("tenor_months", T.IntegerType()),
    Contract("is_defaulter", T.IntegerType()),
    Contract("npa_month", T.IntegerType()),
    Contract("silent_default", T.IntegerType()),
    Contract("transient_months", T.IntegerType()),
    Contract("statement_gap_months", T.IntegerType()),
    Contract("bureau_score_0", T.LongType()),
)


def schema_of(contract: tuple[Contract, ...]) -> T.StructType:
    return T.StructType([T.StructField(c.name, c.kind) for c in contract])


PANEL_SCHEMA, ACCOUNTS_SCHEMA = schema_of(PANEL), schema_of(ACCOUNTS)


def published(df: DataFrame, contract: tuple[Contract, ...] = PANEL) -> DataFrame:
    """The contract's columns in its order: typed, rounded half to even, NULL where not finite or not there."""
    def column(c: Contract) -> Column:
        if c.name not in df.columns:
            return F.lit(None).cast(c.kind).alias(c.name)
        value = F.col(c.name)
        if isinstance(df.schema[c.name].dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
        if c.decimals is not None:
            value = F.bround(value, c.decimals)
        return value.cast(c.kind).alias(c.name)

    return df.select(*[column(c) for c in contract])


def contract_violations(df: DataFrame, contract: tuple[Contract, ...] = PANEL) -> DataFrame:
    """(column, violations): values that are finer than the contract's decimals or not finite, a row per rounded column."""
    ruled = [c for c in contract if c.decimals is not None]

    def broken(c: Contract) -> Column:
        value = F.col(c.name).cast("double")
        return F.count_if(value.isNotNull() & (F.isnan(value) | (F.abs(value) == float("inf")) | (F.bround(value, c.decimals) != value))).alias(c.name)

    return df.agg(*[broken(c) for c in ruled]).unpivot([], [c.name for c in ruled], "column", "violations")


def null_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in every floating-point column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    bad = {c: F.isnan(c) | (F.abs(c) == float("inf")) for c in floats}
    return df.withColumns({c: F.when(~bad[c], F.col(c)) for c in floats})


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """Read with a fixed schema; CSV columns are matched by header, missing ones are NULL."""
    if fmt == "csv":
        header = spark.read.option("header", True).csv(path).columns  # reads the header line only
        raw = spark.read.option("header", True).schema(
            T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(path)
    else:
        raw = spark.read.format(fmt).load(path)
    typed = [F.col(f.name).try_cast(f.dataType).alias(f.name) if f.name in raw.columns
             else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return null_nan(raw.select(*typed))


def read_panel(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = PANEL_SCHEMA) -> DataFrame:
    """Account-month panel; ids are text, numbers that do not parse are NULL."""
    return _read(spark, path, schema, fmt)


def read_accounts(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = ACCOUNTS_SCHEMA) -> DataFrame:
    return _read(spark, path, schema, fmt)


def write_panel(df: DataFrame, path: str, fmt: str = "parquet", month: str = "month") -> None:
    """Write the contract's columns, in its order and rounding, to a folder per month.

    Rows are rebalanced by month first: a month becomes a few files of the
    advisory partition size, however many rows it has. The folder's name repeats
    ``month_idx``, so every file holds the whole contract. An absent number becomes
    an empty CSV cell.
    """
    rows = published(df).withColumn(month, F.col("month_idx"))
    writer = rows.hint("rebalance", F.col(month)).write.mode("overwrite").partitionBy(month)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").option("emptyValue", '""').csv(path)
    else:
        writer.format(fmt).save(path)
