"""The published book: watch list, memos, spotlight and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.functions.bands import decision_column, dpd_band, rag_band, ticket_band


def watchlist_rows(df: DataFrame, amber: float, red: float) -> DataFrame:
    """Typed rows with the band recomputed on read beside the published one."""
    band = F.coalesce(rag_band(decision_column(df), amber, red), F.col("published_band"))
    moved = F.col("published_band").isNotNull() & F.col("band").isNotNull() & (F.col("published_band") != F.col("band"))
    return df.withColumn("band", band).withColumn("band_moved", moved)


def watchlist_query(rows: DataFrame, portfolio: str | None = None, band: str | None = None, constitution: str | None = None,
                    secured: bool | None = None, sort: str = "decision_score", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the watch list, largest first, ties by account."""
    for column, wanted in (("portfolio", portfolio), ("band", band), ("constitution", constitution)):
        if wanted is not None:
            rows = rows.where(F.col(column) == wanted)
    if secured is not None:
        rows = rows.where(F.coalesce(F.col("secured") == 1, F.lit(False)) == secured)
    return rows.orderBy(F.col(sort).desc_nulls_last(), "account_id").offset(offset).limit(limit)


def watchlist_search(rows: DataFrame, text: str | None, columns: tuple[str, ...], dpd: str | None = None,
                     ticket: str | None = None) -> DataFrame:
    """Rows in a DPD and ticket band whose columns contain the text, whatever its case."""
    if dpd is not None:
        rows = rows.where(dpd_band(F.col("dpd")) == dpd)
    if ticket is not None:
        rows = rows.where(ticket_band(F.col("sanctioned")) == ticket)
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(F.col(c).cast("string")).contains(text.lower()), F.lit(False))
        rows = rows.where(hit)
    return rows


def spotlight(book: DataFrame) -> DataFrame:
    """4 + 4 + 3 accounts: caught early, red that failed with the longest warning, healthy."""
    caught = book.where((F.col("band") == "amber") & F.col("to_npa").between(2, 4))
    failed = book.where((F.col("band") == "red") & (F.col("to_npa") > 0))
    healthy = book.where((F.col("band") == "green") & (F.col("to_npa") == -1))
    return first_places([(caught, "-to_npa", 4), (failed, "-lead", 4), (healthy, "account_id", 3)])


def first_places(picks: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """Union of top-k picks in order; an id keeps its first place. Ties go by account."""
    both = None
    for i, (rows, order, k) in enumerate(picks):
        ranked = rows.select("account_id", F.expr(order).alias("_o")).orderBy("_o", "account_id").limit(k)
        part = ranked.withColumn("_pick", F.lit(i))
        both = part if both is None else both.unionByName(part)
    first = both.groupBy("account_id").agg(F.min(F.struct("_pick", "_o", "account_id")).alias("_first"))
    return first.select("account_id", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("_first")).alias("place"))


def timelines(panel: DataFrame, book: DataFrame, points: tuple[str, ...]) -> DataFrame:
    """Ordered points per account of the book (at most one per period).

    An account without history gets its single book row as the only point.
    """
    cells = panel.groupBy("account_id").agg(
        F.array_sort(F.collect_list(F.struct("period", *points))).alias("timeline"))
    return book.select("account_id", F.struct("period", *points).alias("_point")).join(cells, "account_id", "left").select(
        "account_id", F.coalesce("timeline", F.array("_point")).alias("timeline"))
