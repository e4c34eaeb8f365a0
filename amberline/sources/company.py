"""Company files: rating history, identifiers and wide financials."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amberline.functions.numeric import num_of, year_of
from amberline.session import spread


CELLS = 500_000  # cells of wide files that one task brings together


def _text_rows(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)


def _header(spark: SparkSession, path: str, first: str) -> list[str]:
    """The header row, found as the first line that starts with a known column name."""
    line = spark.read.text(path).where(F.col("value").startswith(first + ",")).first()
    if line is None:
        raise ValueError(f"no header row starting with {first!r} in {path}")
    return [c.strip() for c in line.value.split(",")]


def read_rating_events(spark: SparkSession, path: str) -> DataFrame:
    """Dated rating actions (company, rating, event_date_text, year) below a free-text preamble."""
    names = _header(spark, path, "Company Name")
    rows = _text_rows(spark, path, names).select(
        F.trim("Company Name").alias("company"), F.trim("Rating").alias("rating"), F.col("Date").alias("date_text"),
        year_of(F.col("Date")).alias("year"))
    return rows.where((F.col("company") != "") & (F.col("company") != "Company Name") & F.col("year").isNotNull())


def read_identifiers(spark: SparkSession, path: str) -> DataFrame:
    """Two-digit industry prefix and incorporation year per company."""
    names = _header(spark, path, "Company Name")
    rows = _text_rows(spark, path, names).where(F.col("Company Name") != "Company Name")
    return rows.select(F.trim("Company Name").alias("company"), F.nullif(F.substring("NIC code", 1, 2), F.lit("")).alias("nic"),
                       year_of(F.col("Incorporation year")).alias("incorporated"))


def financials_to_long(wide: DataFrame, years: list[int | None], measures: list[str]) -> DataFrame:
    """Wide company rows -> (company, year, measure, value).

    ``years`` and ``measures`` are the two stacked header rows, position by
    position. A blank cell gives no row; a cell that is not a number gives a
    NULL value, because the measure was supplied.
    """
    used = [(c, y, m.strip()) for c, y, m in zip(wide.columns, years, measures) if y and m.strip() and c != "company"]
    keyed = wide.select(F.trim("company").alias("company"), *[F.col(c).cast("string").alias(f"{y}|{m}") for c, y, m in used])
    long = keyed.unpivot("company", [f"{y}|{m}" for _, y, m in used], "key", "text").where(
        (F.col("company") != "") & F.col("text").isNotNull() & (F.trim("text") != ""))
    parts = F.split("key", r"\|", 2)
    return long.select("company", parts[0].cast("int").alias("year"), parts[1].alias("measure"), num_of(F.col("text")).alias("value"))


def read_wide_financials(spark: SparkSession, paths: list[str], year_row: int = 4, name_row: int = 5) -> DataFrame:
    """Wide files with two stacked header rows each -> (company, year, measure, value).

    Every path is a folder with ``head`` (the lines down to the measure names) and
    ``body``; files may differ in years, measures and their order. Only the heads come to
    the driver. Where files give the same cell the last path's stands. Cells are dealt by
    company and year, in tasks that go by their number.
    """
    long, cells = None, 0
    for at, path in enumerate(paths):
        head = [r.value for r in spark.read.text(f"{path}/head").take(name_row + 1)]
        year_cells, names = head[year_row].split(","), head[name_row].split(",")
        years = [int(c.strip()[-4:]) if c.strip()[-4:].isdigit() else None for c in year_cells]
        columns = ["company"] + [f"c{i}" for i in range(1, len(names))]
        body = _text_rows(spark, f"{path}/body", columns).where(F.col("company").isNotNull() & (F.col("company") != names[0]))
        cells += body.count() * len(names)
        part = financials_to_long(body, years, names).withColumn("_file", F.lit(at))
        long = part if long is None else long.unionByName(part)
    if long is None:
        return spark.createDataFrame([], "company string, year int, measure string, value double")
    last = F.max_by("value", "_file") if len(paths) > 1 else F.max("value")
    return spread(long, cells, "company", "year", most=CELLS).groupBy("company", "year", "measure").agg(last.alias("value"))
