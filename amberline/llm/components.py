"""Connected components of a graph of integer ids by repeated contraction, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from amberline.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, component_id) of every id in ``links`` (a, b): the smallest id it is linked with, itself included.

    Each round every root takes the smallest root beside it, chains of such choices are
    shortened twice, and links inside one component go. A round at least halves the
    components that still have links. Every round is a written table, so nothing is
    replayed after a loss and nothing is gathered. No links give no rows.
    """
    links = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(F.col("a") < F.col("b")).distinct(), "links")
    member = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    member = materialise(member.select("id", F.col("id").alias("root")), "members")
    while not links.isEmpty():
        both = links.union(links.select("b", "a"))
        root = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "roots")
        for _ in range(2):
            above = root.select(F.col("a").alias("x"), F.col("up").alias("above"))
            root = materialise(root.join(above, root["up"] == above["x"]).select("a", F.col("above").alias("up")), "roots")
        up = root.select(F.col("a").alias("x"), "up")
        member = materialise(member.join(up, member["root"] == up["x"], "left").select("id", F.coalesce("up", "root").alias("root")), "members")
        moved = links.join(up, links["a"] == up["x"]).select(F.col("up").alias("a"), "b")
        moved = moved.join(up, moved["b"] == up["x"]).select("a", F.col("up").alias("b"))
        links = materialise(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return member.select("id", F.col("root").alias("component_id"))
