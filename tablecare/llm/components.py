"""Connected components of a graph by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.tables import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
    )


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Columns ``node`` and ``root`` for every node of ``edges`` (``a``, ``b``) that
    is not itself the smallest of its component; ``root`` is the smallest.

    Each round points the larger neighbours of every node to its smallest one
    (large star), then does the same for the smaller ones (small star), until
    nothing changes; the number of rounds grows with the logarithm of the number
    of nodes. Minima are combined in the tasks before they are shuffled, so that a
    node with very many neighbours costs a row per task; its edges meet its minimum
    in a join, whose hot keys Spark splits. Null ends and loops are ignored.
    """
    pairs = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    current = scratch.keep(pairs.distinct())
    state = _state(current)
    while state[0]:
        both = current.select(F.col("a").alias("u"), F.col("b").alias("v")).union(
            current.select("b", "a")
        )
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = scratch.keep(
            small.union(low.select("a", F.col("m").alias("b"))).distinct()
        )
        before, state = state, _state(following)
        current = following
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
