"""Links between the members of hash buckets, without all pairs of a bucket.

A bucket table has a row (``key``, ``node``) for each bucket a node is in. Links are
found in two steps. First every member is compared with one pivot of its bucket.
Most buckets, and nearly all members of a dense one, are connected by that. Only in
buckets that still hold several components are members compared with members of
other components, in blocks of bounded size that tasks share out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.components import connected_components
from tablecare.llm.tables import Scratch

#: members of one block; a task holds two blocks at a time
BLOCK_ROWS = 512


def colliding(buckets: DataFrame) -> DataFrame:
    """The rows of buckets with at least two members, with the number ``n`` of them
    and the smallest as ``pivot``."""
    groups = buckets.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("pivot")
    )
    return buckets.join(groups.where("n > 1"), "key")


def in_blocks(members: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Deal each bucket into blocks of about ``rows`` members by a hash, and each
    member to every pair (``lo``, ``hi``) of blocks its own block (``block``) is in."""
    blocks = F.ceil(F.col("n") / rows).cast("int")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", "key"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    dealt = dealt.select("*", other.alias("other"))
    return dealt.withColumns(
        {"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}
    ).drop("other")


def grouped(
    df: DataFrame,
    keys: list[str],
    work: Callable[[pd.DataFrame], pd.DataFrame | None],
    schema: str,
) -> DataFrame:
    """Apply ``work`` to each group of bounded size.

    Unlike ``applyInPandas`` the groups of a partition arrive in one sorted stream of
    large batches, so that a million groups of two rows stay cheap.
    """

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            change = np.zeros(len(rest), bool)
            for key in keys:
                values = rest[key].to_numpy()
                change[1:] |= values[1:] != values[:-1]
            starts = np.flatnonzero(change)
            if not len(starts):
                continue
            edges = [0, *starts]
            yield from _finished(rest, edges)
            rest = rest.iloc[starts[-1] :].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from _finished(rest, [0, len(rest)])

    def _finished(rows: pd.DataFrame, edges: list[int]) -> Iterator[pd.DataFrame]:
        done = []
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            found = work(rows.iloc[start:end])
            if found is not None and len(found):
                done.append(found)
        if done:
            yield pd.concat(done, ignore_index=True)

    dealt = df.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(stream, schema)


def roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index each of ``size`` nodes reaches over the pairs ``a``, ``b``."""
    low = np.arange(size)
    while len(a):
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            break
    return low


def linked(
    buckets: DataFrame,
    verified: Callable[[DataFrame], DataFrame],
    attach: Callable[[DataFrame], DataFrame],
    similar: Callable[[pd.DataFrame, pd.DataFrame], np.ndarray],
    scratch: Scratch,
) -> DataFrame:
    """``node`` and ``root`` of all nodes that are linked to a smaller one.

    ``verified`` keeps the truly linked of candidate pairs (``node``, ``pivot``),
    ``attach`` adds the columns that ``similar`` needs, and that gives the matrix of
    links between two tables of members.
    """
    members = scratch.keep(colliding(buckets))
    stars = members.where("node != pivot").select("node", "pivot").distinct()
    stars = scratch.keep(verified(stars).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
    first = connected_components(stars, scratch)
    placed = members.where("n > 2").join(first, "node", "left")
    placed = placed.select("key", "node", "n", F.coalesce("root", "node").alias("component"))
    several = placed.groupBy("key").agg(
        F.min("component").alias("least"), F.max("component").alias("most")
    )
    several = several.where("least != most").select("key")
    open_members = scratch.keep(placed.join(several, "key", "left_semi"))
    if open_members.isEmpty():
        return first
    node_type = dict(buckets.dtypes)["node"]

    def compare(rows: pd.DataFrame) -> pd.DataFrame | None:
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        left = rows[rows["block"] == lo]
        right = left if lo == hi else rows[rows["block"] == hi]
        if not len(left) or not len(right):
            return None
        links = similar(left, right)
        links &= left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
        i, j = np.nonzero(links)
        if not len(i):
            return None
        # a forest of the links says as much as all of them
        nodes, place = np.unique(
            np.concatenate([left["component"].to_numpy()[i], right["component"].to_numpy()[j]]),
            return_inverse=True,
        )
        low = roots(len(nodes), place[: len(i)], place[len(i) :])
        rest = np.flatnonzero(low != np.arange(len(nodes)))
        return pd.DataFrame({"a": nodes[rest], "b": nodes[low[rest]]})

    dealt = in_blocks(attach(open_members))
    found = grouped(dealt, ["key", "lo", "hi"], compare, f"a {node_type}, b {node_type}")
    found = scratch.keep(found.distinct())
    if found.isEmpty():
        return first
    known = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return connected_components(known.union(found), scratch)
