"""Splits and samples that depend on keys only, never on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.functions.hashing import key_hash, unit_mod
from amberline.session import materialise

CELL_HEX = 4  # 65,536 cells of hash values per group


def group_split(account: Column, test_share: float = 0.30, salt: str = "") -> Column:
    """'test' or 'train', disjoint by account."""
    return F.when(unit_mod(account, salt) < round(test_share * 1000), "test").otherwise("train")


def three_way_split(account: Column, test_share: float = 0.30, policy_share: float = 0.30) -> Column:
    """'fit', 'policy' or 'test'; the policy share is taken from what test leaves."""
    rest = F.when(unit_mod(account, "policy") < round(policy_share * 1000), "policy").otherwise("fit")
    return F.when(group_split(account, test_share) == "test", "test").otherwise(rest)


def out_of_time(df: DataFrame, periods: int, horizon: int, cut: int | None = None) -> DataFrame:
    """Tag rows 'train' or 'test' by time; rows whose outcome spans the cut are dropped.

    The default cut leaves exactly ``horizon`` labelable periods to test on.
    """
    cut = max(0, periods - 2 * horizon) if cut is None else cut
    side = F.when(F.col("period") >= cut, "test").when(F.col("period") + horizon <= cut, "train")
    return df.withColumn("side", side).where(F.col("side").isNotNull())


def take_by_hash(df: DataFrame, take: DataFrame, groups: tuple[str, ...], key: tuple[str, ...], salt: str = "") -> DataFrame:
    """The ``take`` rows of each group with the smallest key hash.

    ``take`` has one row per group with a column ``take``, which may be large. Hash
    cells below the limit are taken whole; only the one cell per group that
    crosses it has its rows numbered, so no group is sorted in one task.
    """
    g = list(groups)
    rows = df.withColumn("_h", key_hash(*[F.col(k) for k in key], F.lit(salt))).withColumn(
        "_cell", F.substring("_h", 1, CELL_HEX))
    cells = rows.groupBy(*g, "_cell").agg(F.count("*").alias("_n")).join(take.select(*g, "take"), g)
    cells = cells.withColumn("_before", F.sum("_n").over(W.partitionBy(*(g or [F.lit(0)])).orderBy("_cell")) - F.col("_n"))
    used = cells.where(F.col("_before") < F.col("take")).select(
        *g, "_cell", F.when(F.col("_before") + F.col("_n") > F.col("take"), F.col("take") - F.col("_before")).alias("_left"))
    used = materialise(used, "hash-cells")  # of known size, so Spark can broadcast it rather than shuffle the rows
    candidates = rows.join(used, [*g, "_cell"])
    whole = candidates.where(F.col("_left").isNull())
    cut = candidates.where(F.col("_left").isNotNull()).withColumn(
        "_rn", F.row_number().over(W.partitionBy(*g, "_cell").orderBy("_h"))).where(F.col("_rn") <= F.col("_left")).drop("_rn")
    return whole.unionByName(cut).drop("_h", "_cell", "_left")


def largest_remainder(counts: DataFrame, n: int, keys: tuple[str, ...]) -> DataFrame:
    """Share ``n`` places over strata in proportion to their size (largest remainder)."""
    everything, whole = counts.agg(F.sum("n")).scalar(), W.partitionBy(F.lit(0))
    exact = F.col("n") * F.lit(n) / everything
    alloc = counts.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
    alloc = alloc.withColumn("_spare", F.lit(n) - F.sum("_base").over(whole)).withColumn(
        "_rank", F.row_number().over(whole.orderBy(F.desc(F.round(F.col("_exact") - F.col("_base"), 9)), *keys)))
    extra = (F.col("_rank") <= F.col("_spare")).cast("bigint")
    return alloc.select(*keys, "n", F.least(F.col("_base") + extra, F.col("n")).alias("take"))


def stratified_sample(book: DataFrame, n: int, strata: tuple[str, ...], keep: DataFrame | None = None) -> DataFrame:
    """A sample of the book with proportional strata; ids in ``keep`` are always included."""
    counts = book.groupBy(*strata).agg(F.count("*").alias("n"))
    picked = take_by_hash(book, largest_remainder(counts, n, strata), strata, ("account_id",), "sample").select("account_id")
    if keep is not None:
        picked = picked.unionByName(keep.select("account_id"))
    return book.join(picked.distinct(), "account_id", "left_semi")


def replenish(train: DataFrame, test: DataFrame, level: str, key: tuple[str, ...]) -> DataFrame:
    """Test rows resampled so their level mix matches the training mix.

    The size is the largest no level has to over-supply; levels absent from
    the test rows cannot be supplied and are left out.
    """
    want = train.groupBy(level).agg(F.count("*").alias("_w"))
    total = train.agg(F.count("*")).scalar()
    have = test.groupBy(level).agg(F.count("*").alias("_have"))
    mix = want.withColumn("_share", F.col("_w") / total).join(have, level)
    scale = mix.agg(F.min(F.col("_have") / F.col("_share"))).scalar()
    take = mix.withColumn("take", F.least(F.bround(F.col("_share") * scale).cast("bigint"), F.col("_have"))).where(F.col("take") > 0)
    return take_by_hash(test, take, (level,), key, "replenish")


def account_sample(df: DataFrame, k: int, account: str = "account_id") -> DataFrame:
    """Rows of ``k`` accounts chosen by hash (a sampling operator)."""
    ids = df.select(account).distinct().orderBy(key_hash(F.col(account), F.lit("accounts"))).limit(k)
    return df.join(ids, account, "left_semi")


def oversample_positives(df: DataFrame, times: int, outcome: str = "went_bad") -> DataFrame:
    """Repeat failing rows ``times`` times, each copy numbered."""
    copies = F.when(F.col(outcome) == 1, F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))
    return df.withColumn("copy", F.explode(copies))


CELL_ROWS = 500_000  # about as many rows a sort cell of dealt labels holds


def permute_labels(df: DataFrame, key: tuple[str, ...], outcome: str = "went_bad", seed: str = "permute", cell_rows: int = CELL_ROWS) -> DataFrame:
    """Labels dealt again over the rows at random, keeping their exact count.

    Rows are ordered by one hash and labels by another. A hash's first digits are its
    cell, as many digits as the number of rows asks for, so a cell holds about
    ``cell_rows`` at every size. Only the counts per cell are needed to number them, so
    each side is sorted inside its cells, and the two sides are joined on the number.
    """
    n = df.count()
    digits = next(d for d in range(1, 16) if n <= cell_rows * 16**d)

    def numbered(rows: DataFrame, salt: str) -> DataFrame:
        hashed = rows.withColumn("_h", key_hash(*[F.col(k) for k in key], F.lit(salt))).withColumn("_cell", F.substring("_h", 1, digits))
        counts = hashed.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn(
            "_offset", F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_cell")) - F.col("_n")).drop("_n")
        inside = F.row_number().over(W.partitionBy("_cell").orderBy("_h"))
        return hashed.withColumn("_rn", inside).join(counts, "_cell").withColumn(
            "_rn", F.col("_rn") + F.col("_offset")).drop("_h", "_cell", "_offset")

    labels = numbered(df.select(*key, outcome), seed).select("_rn", outcome)
    return numbered(df.drop(outcome), seed + "-rows").join(labels, "_rn").drop("_rn")
