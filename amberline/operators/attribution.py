"""Who drives a score: shares of families in the contributions of rows that went bad, by how early they are, with intervals by account."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from amberline.operators.bootstrap import Weights, interval
from amberline.session import materialise

BATCH = 4_096  # accounts weighted at once


def replicate_sums(df: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], replicates: int, account: str = "account_id") -> DataFrame:
    """(keys, replicate, values): sums under each draw's account weights.

    A task adds up its accounts and emits a row per key and draw, so ``keys`` must have few levels.
    NULL values count as zero.
    """
    per = df.groupBy(*keys, F.col(account).cast("string").alias("_account")).agg(*[F.coalesce(F.sum(F.col(v).cast("double")), F.lit(0.0)).alias(v) for v in values])
    schema = StructType([*[per.schema[k] for k in keys], StructField("replicate", IntegerType()), *[StructField(v, DoubleType()) for v in values]])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, totals = Weights(replicates), {}
        for whole in batches:
            for begin in range(0, whole.num_rows, BATCH):
                batch = whole.slice(begin, BATCH)
                own = list(zip(*(c.to_pylist() for c in batch.columns[:width])))
                drawn = np.stack([weights[a] for a in batch.column(width).to_pylist()]).astype(float)
                amounts = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[width + 1:]])
                for key in set(own):
                    at = np.array([k == key for k in own])
                    part = drawn[at].T @ amounts[at]
                    totals[key] = totals[key] + part if key in totals else part
        for key, sums in totals.items():
            columns = [*([k] * replicates for k in key), range(replicates), *sums.T]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, to_arrow_schema(schema))], schema=to_arrow_schema(schema))

    return per.mapInArrow(run, schema).groupBy(*keys, "replicate").agg(*[F.sum(v).alias(v) for v in values])


def _bucket(buckets: list[tuple[int, int]], lead: str) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in reversed(buckets):
        out = F.when(F.col(lead).between(lo, hi), f"{lo}-{hi}").otherwise(out)
    return out


def _shares(sums: DataFrame, keys: tuple[str, ...], families: list[str]) -> DataFrame:
    """(keys, family, share, signed_share): a family's part of all contributions, and of all net ones."""
    size = sum(F.col(f"a_{f}") for f in families)
    net = sum(F.abs(F.col(f"s_{f}")) for f in families)
    cells = [F.struct(F.lit(f).alias("family"), F.coalesce(F.try_divide(F.col(f"a_{f}"), size), F.lit(0.0)).alias("share"),
                      F.coalesce(F.try_divide(F.col(f"s_{f}"), net), F.lit(0.0)).alias("signed_share")) for f in families]
    return sums.select(*keys, F.explode(F.array(*cells)).alias("c")).select(*keys, "c.*")


def attribution_intervals(df: DataFrame, families: dict[str, tuple[str, ...]], buckets: list[tuple[int, int]], replicates: int,
                          lead: str = "to_npa", label: str = "went_bad", account: str = "account_id") -> DataFrame:
    """(bucket, family, n, share, lo, hi, signed_share, signed_lo, signed_hi) over rows that went bad.

    ``families`` maps a family to its contribution columns. ``share`` adds up absolute
    contributions of single columns and sums to one over a bucket's families;
    ``signed_share`` lets pushes up and down cancel and shows the direction: its absolute
    values sum to one. A bucket without rows has no result.
    """
    names = list(families)
    absolute = {f"a_{f}": sum(F.abs(F.col(c)) for c in columns) for f, columns in families.items()}
    signed = {f"s_{f}": sum(F.col(c) for c in columns) for f, columns in families.items()}
    rows = df.where(F.col(label) == 1).select(account, _bucket(buckets, lead).alias("bucket"), *[c.alias(n) for n, c in (absolute | signed).items()])
    rows = materialise(rows.where(F.col("bucket").isNotNull()), "attribution-rows")
    values = (*absolute, *signed)
    whole = rows.groupBy("bucket").agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values])
    point = _shares(whole, ("bucket", "n"), names)
    drawn = materialise(_shares(replicate_sums(rows, ("bucket",), values, replicates, account), ("bucket", "replicate"), names), "attribution-draws")
    keys = ("bucket", "family")
    spans = interval(drawn, "share", groups=keys).select(*keys, "lo", "hi")
    nets = interval(drawn, "signed_share", groups=keys).select(*keys, F.col("lo").alias("signed_lo"), F.col("hi").alias("signed_hi"))
    return point.join(spans, list(keys), "left").join(nets, list(keys), "left").select(
        *keys, "n", "share", "lo", "hi", "signed_share", "signed_lo", "signed_hi")
