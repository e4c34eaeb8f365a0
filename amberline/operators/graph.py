"""One-hop exposure over partner links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symmetric_edges(edges: DataFrame) -> DataFrame:
    """Undirected links: both directions, no duplicates, no self-loops.

    Duplicates go while a link is one row, before it is turned round.
    """
    links = edges.where(F.col("src") != F.col("dst")).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    cells = F.array(F.struct(F.col("src").alias("account_id"), F.col("dst").alias("partner")),
                    F.struct(F.col("dst").alias("account_id"), F.col("src").alias("partner")))
    return links.select(F.explode(cells).alias("e")).select("e.*")


def with_partner_band(book: DataFrame, edges: DataFrame, salts: int = 16) -> DataFrame:
    """(account_id, partner, partner_band) of every link whose partner is in the book.

    A partner may hold a third of all links, so the join key is the partner and one of
    ``salts`` shares of its accounts; the book side, one row an account, is repeated
    for every share.
    """
    bands = book.select(F.col("account_id").alias("partner"), F.col("band").alias("partner_band"),
                        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_share"))
    links = symmetric_edges(edges).withColumn("_share", F.pmod(F.xxhash64("account_id"), F.lit(salts)).cast("int"))
    return links.join(bands, ["partner", "_share"]).drop("_share")


def partner_counts(book: DataFrame, edges: DataFrame) -> DataFrame:
    """Partners, flagged partners and red partners per account of the book.

    Counts are combined before they are shuffled to the account.
    """
    counts = with_partner_band(book, edges).groupBy("account_id").agg(
        F.count("*").alias("partners"), F.count(F.when(F.col("partner_band") != "green", 1)).alias("flagged"),
        F.count(F.when(F.col("partner_band") == "red", 1)).alias("red"))
    return book.join(counts, "account_id", "left").fillna(0, ["partners", "flagged", "red"])


def one_link_from_red(counted: DataFrame, by: str, k: int = 6) -> DataFrame:
    """Green and amber accounts next to a red one: counts and exposure of the ``k`` largest groups."""
    near = counted.where((F.col("red") >= 1) & F.col("band").isin("green", "amber"))
    return near.groupBy(by).agg(
        F.count(F.when(F.col("band") == "green", 1)).alias("n_green"), F.count(F.when(F.col("band") == "amber", 1)).alias("n_amber"),
        F.sum("sanctioned").alias("exposure")).orderBy(F.desc("exposure"), by).limit(k)
