"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

The first scan reads each text's length and a hash of its first characters and
counts the (length, prefix) groups; a group of one is finished. The keys of the
surviving groups become a bitmap of a fixed size, so the second scan hashes the
full content of rows in surviving groups only (plus the few that share a bit) and
no text is ever shuffled. Groups are counted with map-side aggregates; a group that
holds a third of all rows is a few partial counts. Rows meet their group's result
in a join Spark may split where a key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amberline.llm.common import content_key, drop_rows, sha256, texts
from amberline.session import materialise

BITMAP = 32768  # bits in one value of bitmap_construct_agg


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """At most ``bits / 32768`` rows of 4 KiB: which of the keys' slots are taken."""
    slot = F.pmod(F.col("group_key"), F.lit(bits))
    return keys.groupBy(F.floor(slot / BITMAP).cast("int").alias("part")).agg(
        F.bitmap_construct_agg(slot % BITMAP).alias("taken"))


def _is_taken(taken: Column, key: Column, bits: int) -> Column:
    at = F.pmod(key, F.lit(bits)) % BITMAP
    byte = F.conv(F.hex(F.substring(taken, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce((F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2) == 1, F.lit(False))


def exact_groups(docs: DataFrame, prefix_chars: int = 256, bits: int = 1 << 23, carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept and the ``carry`` columns.

    Texts are equal when their UTF-8 bytes are; a null text is an empty one. The row
    with the largest doc_id of a group stays; rows repeated with that very id are all
    marked kept. A row without doc_id counts in its group and stays only where the
    whole group has none. ``carry`` names expressions over (doc_id, text) evaluated in
    the second scan. An empty table gives an empty result.
    """
    if bits % BITMAP:
        raise ValueError(f"bits must be a multiple of {BITMAP}")
    prefix = F.xxhash64(F.octet_length("text"), F.substring("text", 1, prefix_chars)).alias("group_key")
    rows = texts(docs)
    groups = rows.select(F.octet_length("text").alias("n_bytes"), prefix).groupBy("n_bytes", "group_key").agg(F.count("*").alias("n"))
    taken = _bitmap(groups.where(F.col("n") > 1), bits)

    keyed = rows.select("doc_id", "text", prefix).withColumn(
        "part", F.floor(F.pmod(F.col("group_key"), F.lit(bits)) / BITMAP).cast("int"))
    # the bitmap has at most bits / 8 bytes whatever the input's size
    survivors = keyed.join(F.broadcast(taken), "part", "left")
    full = F.when(_is_taken(F.col("taken"), F.col("group_key"), bits), sha256("text"))
    hashed = materialise(survivors.select(
        "doc_id", F.coalesce(full, F.concat(F.lit("only-"), F.hex("group_key"))).alias("full_hash"),
        *[expr.alias(name) for name, expr in (carry or {}).items()]), "exact-hash")
    best = hashed.groupBy("full_hash").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return hashed.join(best, "full_hash").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), *(carry or {}))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the largest doc_id.

    Rows are told apart by id and text, so another text under the same id stays. Rows
    that repeat both the largest id and the text all stay, as do rows without an id.
    """
    gone = exact_groups(docs, carry={"content": content_key("text")}).where(~F.col("kept")).select("doc_id", "content")
    return drop_rows(docs, gone)
