"""Exact quantiles without bringing a whole column into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from amberline.session import materialise


def with_rank_range(counts: DataFrame, value: str, groups: tuple[str, ...] = (), n: str = "n") -> DataFrame:
    """Add ``before`` (rows with a smaller value) and ``total`` to value counts.

    ``counts`` holds one row per (group, value). The values are range-partitioned by
    splitters that Spark samples from them, so every part holds about as many distinct
    values wherever outliers or dense regions lie. Offsets come from a window over one
    row a part, ranks from a window inside a part.
    """
    keys = list(groups)
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = counts.repartitionByRange(parts, *keys, value).withColumn("_part", F.spark_partition_id())
    placed = materialise(placed, "value-parts")
    offsets = placed.groupBy(*keys, "_part").agg(F.sum(n).alias("_m")).select(
        *keys, "_part", _running_before("_m", keys, "_part").alias("_outer"), F.sum("_m").over(W.partitionBy(*keys)).alias("total"))
    offsets = materialise(offsets, "part-offsets")  # a row a part and group: joined by broadcast as its size shows
    ranked = placed.withColumn("_inner", _running_before(n, [*keys, "_part"], value))
    return ranked.join(offsets, [*keys, "_part"]).withColumn("before", F.col("_outer") + F.col("_inner")).drop("_part", "_outer", "_inner")


def _running_before(n: str, keys: list[str], order: str):
    return F.sum(n).over(W.partitionBy(*keys).orderBy(order)) - F.col(n)


def quantiles_of_ranked(ranked: DataFrame, value: str, probs: tuple[float, ...], groups: tuple[str, ...] = (),
                        n: str = "n") -> DataFrame:
    """Linearly interpolated quantiles from :func:`with_rank_range` output.

    One row per (group, prob): ``value``.
    """
    keys = list(groups)
    first, last = F.col("before"), F.col("before") + F.col(n) - 1

    def position(p):
        at = p * (F.col("total") - 1)
        return F.struct(p.alias("prob"), F.floor(at).alias("lo"), F.ceil(at).alias("hi"), (at - F.floor(at)).alias("part"))

    def covers(rank):
        return (first <= rank) & (rank <= last)

    # every rank lies in exactly one row, so at most two rows per probability survive
    wanted = F.transform(F.array(*[F.lit(float(p)) for p in probs]), position)
    hits = ranked.select(*keys, F.col(value).alias("_v"), first.alias("_first"), last.alias("_last"), F.explode(
        F.filter(wanted, lambda w: covers(w["lo"]) | covers(w["hi"]))).alias("w"))

    def value_at(side):
        return F.max(F.when((F.col("_first") <= F.col(f"w.{side}")) & (F.col(f"w.{side}") <= F.col("_last")), F.col("_v")))

    ends = hits.groupBy(*keys, F.col("w.prob").alias("prob")).agg(
        value_at("lo").alias("_lo"), value_at("hi").alias("_hi"), F.max("w.part").alias("_part"))
    return ends.select(*keys, "prob", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value"))


def exact_quantiles(df: DataFrame, value: str, probs: tuple[float, ...], groups: tuple[str, ...] = ()) -> DataFrame:
    """Exact quantiles of a column of any cardinality, per group.

    The table is read once; the value counts are written to the work folder and
    the ranks are found on them.
    """
    counts = materialise(
        df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("n")), "value-counts")
    return quantiles_of_ranked(with_rank_range(counts, value, groups), value, probs, groups)


def edges_scalar(quantiles: DataFrame):
    """The distinct quantile values of an ungrouped result as one ascending array (a scalar subquery)."""
    return quantiles.agg(F.array_sort(F.array_distinct(F.collect_list("value")))).scalar()


def right_closed_bin(value, edges):
    """0-based bin under edges[i] < v <= edges[i+1]; the first bin includes its lower edge."""
    inner = F.filter(edges, lambda e, i: (i > 0) & (i < F.size(edges) - 1))
    return F.size(F.filter(inner, lambda e: e < value))


def left_closed_bin(value, edges):
    """0-based bin under edges[i] <= v < edges[i+1]; the last bin includes its upper edge."""
    inner = F.filter(edges, lambda e, i: (i > 0) & (i < F.size(edges) - 1))
    return F.size(F.filter(inner, lambda e: e <= value))
