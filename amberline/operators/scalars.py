"""Small results attached to rows without a join.

Each helper aggregates to one row and inlines it as a scalar subquery, which
Spark runs once. Only use them where the size is bounded by the schema or by a
business list (cut-offs, bin edges, portfolios), never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_value(df: DataFrame, expression: Column) -> Column:
    return df.agg(expression).scalar()


def ascending_array(df: DataFrame, column: str) -> Column:
    """Distinct values of a column of few values, ascending."""
    return one_value(df, F.array_sort(F.collect_set(column)))


def lookup_map(df: DataFrame, key: str, value: str) -> Column:
    """Map from a low-cardinality key (portfolio, feature) to its value."""
    return one_value(df, F.map_from_entries(F.collect_list(F.struct(key, value))))
