"""Reading the text tables, and small helpers several operators share.

Rules every operator here keeps:

* a null text (or html) counts as the empty text;
* an operator picks the columns it needs under its own names first, so further
  columns of the input, whatever their names, neither clash nor get lost in
  :func:`drop_rows`;
* a row without an id gets its own result row with a null id and is never
  linked with another row by its id.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

OUT_ROWS = 5_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def sha256(column: Column | str) -> Column:
    """Lowercase hex of the UTF-8 bytes."""
    return F.sha2(F.encode(F.col(column) if isinstance(column, str) else column, "UTF-8"), 256)


def content_key(text: Column | str) -> Column:
    """128 bits of a text; a null text has those of the empty one."""
    return F.substring(sha256(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), 1, 32)


def drop_rows(docs: DataFrame, gone: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose id and content are in ``gone`` (doc_id, content); all columns as they were.

    An id alone names no row: two texts under one id are told apart by their content.
    Rows without an id stay.
    """
    gone = gone.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__gone"), F.col("content").alias("__content")).distinct()
    marked = docs.withColumn("__key", F.col(key).cast("long")).withColumn("__own", content_key(text))
    return marked.join(gone, (F.col("__key") == F.col("__gone")) & (F.col("__own") == F.col("__content")), "left_anti").select(*[marked[c] for c in docs.columns])


def map_rows(df: DataFrame, run: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str | StructType) -> DataFrame:
    """``run`` over each partition's rows, as plain tuples both ways and Arrow batches on the wire.

    Integers stay integers beside nulls, and a task holds one batch in and one batch out.
    """
    spark_schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(spark_schema)
        rows = run(row for batch in found for row in zip(*(c.to_pylist() for c in batch.columns)))
        while block := list(itertools.islice(rows, OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*block), arrow)], schema=arrow)

    return df.mapInArrow(batches, schema)
