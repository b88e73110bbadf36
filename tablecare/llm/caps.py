"""Embedding near-duplicates by spherical-cap filters.

Filters are directions; a vector is in a filter if its inner product with the
direction reaches a threshold, that is, if it lies in a cap of the sphere. Close
vectors share a cap with high probability. The directions form a structured random
product code: the space is turned at random and cut into blocks, each block has a
small random codebook, and a direction is one codeword from each. So a million
directions need a few hundred codewords, and all caps that hold a vector are found
by list-decoding: combining only the codewords that can still reach the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.buckets import colliding, grouped, in_blocks, roots
from tablecare.llm.components import connected_components
from tablecare.llm.tables import Scratch
from tablecare.llm.vectors import measurable
from tablecare.session import configure

#: rows by which the threshold and the number of filters are calibrated
SAMPLE_ROWS = 512
#: made pairs that the number of filters is tuned with
TUNING_PAIRS = 2048
#: vectors of a length that fewer vectors have than this are one bucket
CODED_ROWS = 2048


@lru_cache(maxsize=64)
def _leading(first: int, second: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The places in two falling lists whose sums can be among the ``count`` largest: a
    sum comes after all of those at smaller places."""
    sizes = np.minimum(second, count // np.arange(1, min(first, count) + 1))
    i = np.repeat(np.arange(len(sizes)), sizes)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class ProductCode:
    """``words`` codewords in each of ``blocks`` blocks of a turned space."""

    def __init__(self, dimension: int, words: int, blocks: int = 3, seed: int = 5):
        random = np.random.default_rng(seed)
        self.turn = np.linalg.qr(random.standard_normal((dimension, dimension)))[0]
        self.blocks = min(blocks, dimension)
        self.cuts = np.linspace(0, dimension, self.blocks + 1).astype(int)
        self.words = []
        for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True):
            book = random.standard_normal((words, b - a))
            # in one dimension there are two directions only
            book /= np.linalg.norm(book, axis=1, keepdims=True)
            self.words.append(np.unique(book, axis=0))
        self.size = int(np.prod([len(book) for book in self.words], dtype=object))
        self.threshold, self.least = 0.0, 1

    def _scores(self, rows: np.ndarray) -> list[np.ndarray]:
        turned = rows @ self.turn
        return [
            turned[:, a:b] @ book.T
            for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.words, strict=True)
        ]

    def _best(self, scores: list[np.ndarray], filters: int) -> np.ndarray:
        """The ``filters`` best sums of one row, in no order, all if there are fewer."""
        total = np.zeros(1)
        for own in scores:
            i, j = _leading(len(total), len(own), filters)
            total = -np.sort(-total)[i] + -np.sort(-own)[j]
            if len(total) > filters:
                # a copy, so that the other sums are let go
                total = np.partition(total, -filters)[-filters:].copy()
        return total

    def calibrate(self, rows: np.ndarray, filters: float) -> None:
        """Set the threshold at which ``rows`` are in ``filters`` filters on average, and
        half of that as the number that every row is in at least."""
        self._settle(self._pooled(rows, 64 * int(filters)), len(rows), filters)

    def _pooled(self, rows: np.ndarray, each: int) -> np.ndarray:
        """The best sums of all rows, ``each`` of a row at most, in falling order."""
        scores = self._scores(rows)
        pooled = [self._best([s[n] for s in scores], each) for n in range(len(rows))]
        return -np.sort(-np.concatenate(pooled))

    def _settle(self, pooled: np.ndarray, rows: int, filters: float) -> None:
        self.least = max(1, int(filters) // 2)
        self.threshold = float(pooled[min(len(pooled) - 1, int(filters * rows))])

    def tune(self, rows: np.ndarray, similarity: float, recall: float, most: int) -> int:
        """Calibrate to the fewest filters, in steps of a quarter and ``most`` at most, that share one
        between ``recall`` of the ``rows`` and made partners at exactly ``similarity``."""
        random = np.random.default_rng(11)
        pooled, each = self._pooled(rows, 16 * most), len(rows)
        # enough pairs for a share of a few in a thousand, whatever the rows
        rows = np.tile(rows, (-(-TUNING_PAIRS // each), 1))[:TUNING_PAIRS]
        away = random.standard_normal(rows.shape)
        away -= (away * rows).sum(1, keepdims=True) * rows
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
        partners = similarity * rows + np.sqrt(1 - similarity**2) * away
        filters = 32
        while True:
            filters = min(filters, most)
            self._settle(pooled, each, filters)
            if filters == most or self.size <= filters:
                return filters
            shared = [
                len(np.intersect1d(a, b, assume_unique=True)) > 0
                for a, b in zip(self.decode(rows), self.decode(partners), strict=True)
            ]
            if np.mean(shared) >= recall:
                return filters
            filters += -(-filters // 4)

    def decode(self, rows: np.ndarray) -> list[np.ndarray]:
        """The filters that hold each row: all that reach the threshold. A row that is far
        from all directions has a lower one of its own, which ``least`` filters reach."""
        scores = self._scores(rows)
        most = [s.max(1) for s in scores]
        found = []
        for number in range(len(rows)):
            rest = sum(m[number] for m in most)
            bound = min(self.threshold, self._best([s[number] for s in scores], self.least).min())
            total, code = np.zeros(1), np.zeros(1, np.int64)
            for score, top in zip(scores, most, strict=True):
                own = score[number]
                rest -= top[number]
                # what the best of the later blocks could still lift over the bound
                use = np.flatnonzero(own >= bound - rest - total.max() - 1e-12)
                sums = total[:, None] + own[use][None, :]
                i, j = np.nonzero(sums >= bound - rest - 1e-12)
                total = sums[i, j]
                code = code[i] * len(own) + use[j]
            found.append(code)
        return found


def _links(similarity: float):
    def links(rows: pd.DataFrame) -> pd.DataFrame | None:
        """The links of a pair of blocks of one filter: per member how many vectors it
        is linked with, and the smallest member it reaches."""
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        block = rows["block"].to_numpy()
        left = np.flatnonzero(block == lo)
        right = left if lo == hi else np.flatnonzero(block == hi)
        if not len(left) or not len(right) or len(rows) < 2:
            return None
        held = _units(rows["embedding"])
        close = held[left] @ held[right].T >= similarity
        nodes = rows["node"].to_numpy()
        close &= nodes[left][:, None] != nodes[right][None, :]
        if not close.any():
            return None
        # pairs that share a smaller filter are counted there
        key = rows["key"].iloc[0]
        lists = rows["filters"].to_numpy()
        smaller = [f[f < key] for f in lists]
        values, place = np.unique(np.concatenate(smaller), return_inverse=True)
        if len(values):
            often = np.bincount(place) > 1
            column = np.cumsum(often) - 1
            row = np.repeat(np.arange(len(rows)), [len(s) for s in smaller])
            shared = np.zeros((len(rows), int(often.sum())), np.float32)
            shared[row[often[place]], column[place[often[place]]]] = 1
            close &= shared[left] @ shared[right].T == 0
        i, j = np.nonzero(close)
        if not len(i):
            return None
        sizes = rows["size"].to_numpy()
        count = np.zeros(len(rows), np.int64)
        np.add.at(count, left[i], sizes[right[j]])
        if lo != hi:
            np.add.at(count, right[j], sizes[left[i]])
        order = np.argsort(nodes, kind="stable")
        rank = np.empty(len(rows), np.int64)
        rank[order] = np.arange(len(rows))
        low = roots(len(rows), rank[left[i]], rank[right[j]])
        use = np.flatnonzero(count)
        return pd.DataFrame(
            {"node": nodes[use], "links": count[use], "root": nodes[order[low[rank[use]]]]}
        )

    return links


def embedding_components(
    vectors: DataFrame, similarity: float = 0.95, filters: int | None = None, recall: float = 0.99,
    most_filters: int = 512, spread: int = 4096, seed: int = 5,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links`` (other vectors found at a cosine of
    ``similarity`` or more, each compared in double precision), ``component_id`` (the
    smallest id reachable by links) and ``kept`` (it is the vector's own).

    A vector is in about ``filters`` filters of some ``spread`` times as many as there are
    vectors, so that buckets stay small at any size. Where ``filters`` is not given, as
    many are used (``most_filters`` at most) as find ``recall`` of made pairs at exactly
    ``similarity``, so that their number grows with the table. Both are calibrated on
    SAMPLE_ROWS rows. Vectors of different lengths have no cosine; those of each length
    link among themselves, and where fewer than CODED_ROWS have a length, these are one
    bucket. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing. Equal vectors are one
    node that counts for all of them. Null ids have no component, and no part in any.
    Rows that repeat an id and a vector are one row. Other columns are not read.
    """
    spark = configure(vectors.sparkSession)
    scratch, result = Scratch(spark, "caps-work"), Scratch(spark, "caps")
    every = vectors.select("vec_id", "embedding").distinct()
    rows = measurable(every.where("vec_id is not null"))
    nodes = rows.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("size"))
    # an id that has several vectors is a node with each of them; the numbers are written
    nodes = scratch.keep(nodes.withColumn("row", F.monotonically_increasing_id()))
    if nodes.isEmpty():
        return every.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.lit(True).alias("kept"),
        )
    lengths = nodes.groupBy(F.size("embedding").alias("length")).count()
    # lengths with less than CODED_ROWS vectors need no code
    lengths = dict(map(tuple, lengths.where(F.col("count") >= CODED_ROWS).collect()))
    codes: dict[int, tuple[ProductCode, int]] = {}
    offset = 0
    for length, total in sorted(lengths.items()):
        sample = nodes.where(F.size("embedding") == length)
        known = _units(sample.orderBy(F.xxhash64("node")).limit(SAMPLE_ROWS).toPandas()["embedding"])
        words = max(4, int(np.ceil((spread * total) ** (1 / 3))))
        code = ProductCode(length, words, seed=seed)
        if filters is None:
            code.tune(known, similarity, recall, most_filters)
        else:
            code.calibrate(known, filters)
        codes[length] = code, offset
        offset += code.size

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["embedding"].map(len)
            for length, held in batch.groupby(sizes, sort=False):
                for at in range(0, len(held), 1024):
                    part = held.iloc[at : at + 1024]
                    if length in codes:
                        code, first = codes[length]
                        found = [first + f for f in code.decode(_units(part["embedding"]))]
                    else:
                        found = [np.array([-length], np.int64)] * len(part)
                    yield pd.DataFrame({"row": part["row"].to_numpy(), "filters": found})

    read = nodes.select("row", "embedding")
    decoded = scratch.keep(read.mapInPandas(decode, "row long, filters array<long>"))
    index = decoded.select(F.explode("filters").alias("key"), F.col("row").alias("node"))
    # numbers and keys first; a vector then travels once for each filter that it shares,
    # in the type it came in, with the shared ones only
    shared = colliding(index).groupBy(F.col("node").alias("row"))
    shared = shared.agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("in"))
    came = nodes.withColumn("embedding", F.col("embedding").cast(vectors.schema["embedding"].dataType))
    members = shared.join(came.select("row", "node", "size", "embedding"), "row")
    members = members.select(
        "node", "size", "embedding", F.col("in.key").alias("filters"), F.explode("in").alias("at")
    ).select("node", "size", "embedding", "filters", "at.key", "at.n")
    found = grouped(
        in_blocks(members), ["key", "lo", "hi"], _links(similarity), "node long, links long, root long"
    )
    found = scratch.keep(found.groupBy("node", "root").agg(F.sum("links").alias("links")))
    reached = connected_components(
        found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = (
        nodes.join(links, "node", "left")
        .join(reached, "node", "left")
        .select(
            "embedding",
            (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"),
            F.coalesce("root", "node").alias("root"),
        )
    )
    classes = result.keep(
        rows.join(named, "embedding").select(F.col("vec_id").alias("of"), "links", "root", F.col("embedding").alias("unit"))
    )
    scratch.drop()
    same = (F.col("vec_id") == F.col("of")) & (F.col("embedding").cast("array<double>") == F.col("unit"))
    component = F.coalesce("root", "vec_id")
    return every.join(classes, same, "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _units(embeddings: pd.Series) -> np.ndarray:
    held = np.stack(embeddings.to_numpy()).astype(np.float64)
    # against overflow and underflow of the squares
    held /= np.abs(held).max(1, keepdims=True)
    return held / np.linalg.norm(held, axis=1, keepdims=True)
