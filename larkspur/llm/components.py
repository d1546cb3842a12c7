"""Connected components of a table of links, by alternating stars; no link or label leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _star(edges: DataFrame, large: bool, scratch: Scratch) -> DataFrame:
    """One round: every node's neighbours above it (large) or up to it (small) are linked to its least neighbour."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # a table of its own, so that adaptive execution can split the links of a node that has very many
    least = scratch.table(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = both.join(least, "a")
    if large:
        made = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return made.where("a <> b").distinct()


def components(edges: DataFrame, scratch: Scratch, most_rounds: int = 100) -> DataFrame:
    """For links (a, b) of one orderable type: a row (node, root) for every node of a link, root the least node that it reaches.

    Links to oneself and repeated links do no harm; nulls are no nodes. Each round is two aggregations and joins on the
    links that are left, written to the shared folder. The rounds end when a round changes nothing; a chain of n nodes
    takes about log n of them. A node with very many links is one key of a join against a single row, which adaptive
    execution splits.
    """
    now = scratch.table(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(most_rounds):
        found = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)")).alias("s")).first()
        if mark == found or found["n"] == 0:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = found
        after = scratch.table(_star(_star(now, True, scratch), False, scratch), "links")
        scratch.drop(now)
        now = after
    raise RuntimeError(f"the components are not complete after {most_rounds} rounds")
