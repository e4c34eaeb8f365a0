"""Population and characteristic stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.functions.hashing import unit_mod
from amberline.operators.quantiles import left_closed_bin, quantiles_of_ranked, with_rank_range
from amberline.operators.scalars import lookup_map
from amberline.session import materialise

FLOOR = 1e-6


def _stability(cells: DataFrame, key: str = "feature") -> DataFrame:
    """Sum of (a - e) * ln(a / e) over cells (key, e, a), with floored shares.

    The totals per feature are a short map, so the cells are not regrouped by feature.
    """
    totals = cells.groupBy(key).agg(F.struct(F.sum("e").alias("e"), F.sum("a").alias("a")).alias("t"))
    rows = cells.withColumn("_t", F.element_at(lookup_map(totals, key, "t"), F.col(key)))

    def share(side: str) -> Column:
        return F.greatest(F.col(side) / F.greatest(F.col(f"_t.{side}"), F.lit(1)), F.lit(FLOOR))

    part = (share("a") - share("e")) * F.log(share("a") / share("e"))
    both = (F.max("_t.e") > 0) & (F.max("_t.a") > 0)
    return rows.groupBy(key).agg(F.when(both, F.sum(part)).otherwise(0.0).alias("csi"))


def numeric_csi(df: DataFrame, expected: Column, features: tuple[str, ...], bins: int = 10) -> DataFrame:
    """Stability index of numeric features: bins are quantiles of the expected rows.

    ``expected`` is TRUE for the reference rows, FALSE for the rows compared
    with them, NULL for neither. All features go through one pass; values are
    counted first, so quantiles and bins work on distinct values.
    """
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    values = df.where(expected.isNotNull()).select(expected.alias("_e"), F.explode(cells).alias("c")).where(
        F.col("c.value").isNotNull() & ~F.isnan("c.value")).groupBy("c.feature", "c.value").agg(
        F.count(F.when(F.col("_e"), 1)).alias("e"), F.count(F.when(~F.col("_e"), 1)).alias("a"))
    values = materialise(values, "value-counts")
    ranked = with_rank_range(values.where(F.col("e") > 0), "value", ("feature",), n="e")
    edges = quantiles_of_ranked(ranked, "value", tuple(i / bins for i in range(bins + 1)), ("feature",), n="e").groupBy("feature").agg(
        F.array_sort(F.collect_set("value")).alias("edges"))
    binned = values.withColumn("_edges", lookup_map(edges, "feature", "edges")).withColumn(
        "_edges", F.element_at("_edges", F.col("feature")))
    per_bin = binned.where(F.size("_edges") >= 3).groupBy("feature", left_closed_bin(F.col("value"), F.col("_edges")).alias("bin")).agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"))
    per_bin = materialise(per_bin, "bin-counts")
    # np.unique edges < 3 means nothing to compare: such features rate 0
    empty = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    return empty.join(_stability(per_bin), "feature", "left").select("feature", F.coalesce("csi", F.lit(0.0)).alias("csi"))


def psi(df: DataFrame, expected: Column, score: str, bins: int = 10) -> DataFrame:
    """Population stability index of one score."""
    return numeric_csi(df, expected, (score,), bins).withColumnRenamed("csi", "psi")


def categorical_csi(df: DataFrame, expected: Column, features: tuple[str, ...]) -> DataFrame:
    """Stability index over the union of levels of categorical features, in one pass."""
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features])
    levels = df.where(expected.isNotNull()).select(expected.alias("_e"), F.explode(cells).alias("c")).where(
        F.col("c.level").isNotNull()).groupBy("c.feature", "c.level").agg(
        F.count(F.when(F.col("_e"), 1)).alias("e"), F.count(F.when(~F.col("_e"), 1)).alias("a"))
    return _stability(materialise(levels, "level-counts"))


def feature_csi_table(df: DataFrame, expected: Column, numeric: tuple[str, ...], categorical: tuple[str, ...]) -> DataFrame:
    """Stability of every feature, the worst one marked as binding."""
    both = numeric_csi(df, expected, numeric).unionByName(categorical_csi(df, expected, categorical))
    worst = both.agg(F.max_by("feature", F.struct("csi", "feature"))).scalar()
    return both.withColumn("binding", F.col("feature") == worst)


def random_halves(df: DataFrame, key: str = "account_id", salt: str = "half") -> Column:
    """A TRUE/FALSE split by key that no real drift can follow (the control)."""
    return unit_mod(F.col(key), salt, 2) == 0
