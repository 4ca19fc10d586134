"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm.common import spool


def components(links: DataFrame) -> DataFrame:
    """(v, root): one row per vertex of `links` (columns a, b), `root` being the same for all of its component.

    Rounds of contraction: every vertex points to the neighbour of least hashed rank (or to itself, if it has the
    least), links are renamed to what their ends point to, loops and repeats go. Hashed ranks keep chains of ids from
    becoming chains of pointers, so the number of vertices falls by a constant factor a round. Nothing is collected;
    each round's tables are written, so a lost executor costs at most one round. Self-links and nulls are ignored.
    """
    ends = lambda df: df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    left = spool(ends(links.where("a IS NOT NULL AND b IS NOT NULL")), "links")
    labels = left.select(F.col("a").alias("v"), F.col("a").alias("root"))
    first = True
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
        parent = both.groupBy("a").agg(F.min(rank("b")).alias("least")).select(F.col("a").alias("from"), F.least(rank("a"), "least").getField("to").alias("to"))
        parent = spool(parent, "parents")
        if first:
            labels, first = parent.select(F.col("from").alias("v"), F.col("to").alias("root")), False
        else:
            labels = labels.join(parent, labels["root"] == parent["from"], "left").select("v", F.coalesce("to", "root").alias("root"))
            labels = spool(labels, "labels")
        a, b = (parent.select(F.col("from").alias(k), F.col("to").alias(f"{k}_to")) for k in ("a", "b"))
        left = spool(ends(left.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))), "links")
    return labels
