"""Nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own codebook; a cell is a pair
of centroids. A query goes through the cells in the order of summed distance, by a
heap, until enough candidates are listed, and these are ranked by exact distance.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecare.llm.tables import Scratch
from tablecare.llm.vectors import usable
from tablecare.session import configure

#: rows of the index that a task holds at a time
_CHUNK_ROWS = 8192


def codebook(rows: np.ndarray, size: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's iterations."""
    random = np.random.default_rng(seed)
    rows = np.unique(rows, axis=0)
    centroids = rows[random.choice(len(rows), min(size, len(rows)), replace=False)]
    for _ in range(rounds):
        of = nearest(rows, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, rows)
        counts = np.bincount(of, minlength=len(centroids))
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    return centroids


def _squares(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (rows**2).sum(1)[:, None] - 2 * rows @ centroids.T + (centroids**2).sum(1)


def nearest(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return _squares(rows, centroids).argmin(1)


def traversal(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[tuple[int, int]]:
    """Cells by increasing ``first[i] + second[j]``, empty ones left out, until they
    list ``enough`` vectors."""
    by_first, by_second = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by_first], second[by_second]
    heap, seen, cells, listed = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and listed < enough:
        _, i, j = heapq.heappop(heap)
        cell = (int(by_first[i]), int(by_second[j]))
        if counts[cell]:
            cells.append(cell)
            listed += counts[cell]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return cells


def _best(ids: np.ndarray, rows: np.ndarray, cells: np.ndarray, queries: pd.DataFrame, k: int) -> pd.DataFrame | None:
    """The k nearest of ``rows`` to each query, in the cells it goes through."""
    wanted = np.stack(queries["embedding"].to_numpy()).astype(np.float64)
    about, norms = _squares(wanted, rows), (rows**2).sum(1)
    query_ids = queries["id"].to_numpy()
    out = []
    for number, visited in enumerate(queries["cells"]):
        here = np.isin(cells, visited) & (ids != query_ids[number])
        place = np.flatnonzero(here)
        if not len(place):
            continue
        if len(place) > k:
            # the k-th smallest and all that rounding could put in front of it
            values = about[number, place]
            bound = np.partition(values, k - 1)[k - 1]
            rounding = 1e-15 * (wanted.shape[1] + 8) * ((wanted[number] ** 2).sum() + norms[place])
            # written so that values past the range of doubles stay in
            place = place[~(values - rounding > bound + rounding.max())]
        exact = np.sqrt(((rows[place] - wanted[number]) ** 2).sum(1))
        order = np.lexsort((ids[place], exact))[:k]
        out.append((query_ids[number], ids[place][order], exact[order]))
    if not out:
        return None
    sizes = [len(o[1]) for o in out]
    return pd.DataFrame(
        {
            "query_id": np.repeat([o[0] for o in out], sizes),
            "vec_id": np.concatenate([o[1] for o in out]),
            "score": np.concatenate([o[2] for o in out]),
        }
    )


def _true_neighbours(index: DataFrame, ids: np.ndarray, asks: np.ndarray, k: int) -> pd.DataFrame:
    """``number`` of the query, and the cell (``first``, ``second``) of each of its ``k``
    nearest rows: a bounded number of queries against all rows, in blocks, of which
    each task passes on the ``k`` best at most."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                held = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                about = _squares(asks, held)
                about[ids[:, None] == part["vec_id"].to_numpy()[None, :]] = np.inf
                use = min(k, len(part))
                near = np.argpartition(about, use - 1, axis=1)[:, :use]
                place = near.ravel()
                found = pd.DataFrame(
                    {
                        "number": np.repeat(np.arange(len(asks)), use),
                        "score": np.take_along_axis(about, near, 1).ravel(),
                        "vec_id": part["vec_id"].to_numpy()[place],
                        "first": part["first"].to_numpy()[place],
                        "second": part["second"].to_numpy()[place],
                    }
                )
                found = found[np.isfinite(found["score"])]
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["number", "score", "vec_id"]).groupby("number").head(k)
        if best is not None:
            yield best

    schema = "number int, score double, vec_id long, first int, second int"
    found = index.select("vec_id", "embedding", "first", "second").mapInPandas(compare, schema)
    rank = F.row_number().over(Window.partitionBy("number").orderBy("score", "vec_id"))
    # ``k`` rows per query of a bounded number
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("number", "first", "second").toPandas()


def _listed_before(first: np.ndarray, second: np.ndarray, counts: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Rows that are listed before or with each of ``cells`` (pairs), by the order of
    ``traversal`` up to ties."""
    sums = (first[:, None] + second[None, :]).ravel()
    order = np.argsort(sums, kind="stable")
    listed = np.cumsum(counts.ravel()[order])
    wanted = first[cells[:, 0]] + second[cells[:, 1]]
    return listed[np.searchsorted(sums[order], wanted, "right") - 1]


def nearest_neighbours(
    vectors: DataFrame, queries: Column, k: int = 10, share: float | None = None,
    recall: float = 0.96, least: int = 1000, centroids: int = 1024,
    sample_rows: int = 16_384, sample_queries: int = 256, seed: int = 3,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (Euclidean distance in double
    precision) of the ``k`` nearest candidates found for each row that ``queries`` selects.

    Candidates are all rows but the query's own id. A query lists cells until they
    hold ``share`` of the rows, ``least`` at least. Where ``share`` is not given it is
    the smallest that lists ``recall`` of the true neighbours of ``sample_queries``
    rows, those with the smallest hash, which are compared with all rows: vectors with
    structure need little, others up to half. Ties go to the smaller id.
    Vectors that are null or empty, hold null or non-finite components, are zero, or
    are not as long as most, take no part; neither do null ids. Rows that repeat an id
    with one vector are one candidate.

    Space is moved to the mean of the sample and turned at random before it is halved, so
    that both halves tell rows apart. There is a cell per 16 rows, up to ``centroids``
    entries in the codebook of a half, fitted on the
    ``sample_rows`` rows with the smallest hash; all rows are indexed. The index is cut
    by the first centroid into chunks of bounded size, however full a cell is. A task
    holds one chunk, past which the queries that go through it stream, and returns the
    k best per query and chunk.
    """
    spark = configure(vectors.sparkSession)
    scratch, result = Scratch(spark, "search-work"), Scratch(spark, "search")
    rows = usable(vectors).select("vec_id", "embedding", queries.alias("asks"))
    rows = scratch.keep(rows.where("vec_id is not null").dropDuplicates(["vec_id", "embedding"]))
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    known = np.stack(sample["embedding"].to_numpy()).astype(np.float64)
    cut = known.shape[1] // 2
    size = int(min(centroids, max(1, round(total**0.5 / 4))))
    centre = known.mean(0)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(centre), len(centre))))[0]

    def halves(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = (held - centre) @ turn
        return turned[:, :cut], turned[:, cut:]

    books = [codebook(half, size, seed) for half in halves(known)]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                held = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                batch["first"], batch["second"] = map(nearest, halves(held), books)
                yield batch

    index = rows.mapInPandas(
        assign, "vec_id long, embedding array<double>, asks boolean, first int, second int"
    )
    index = scratch.keep(index)
    # at most ``centroids`` squared rows
    filled = index.groupBy("first", "second").count().collect()
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for cell in filled:
        counts[cell["first"], cell["second"]] = cell["count"]
    chunks = np.maximum(1, -(-counts.sum(1) // _CHUNK_ROWS)).tolist()
    if share is None:
        asks = known[:sample_queries]
        true = _true_neighbours(index, sample["vec_id"].to_numpy()[:sample_queries], asks, k)
        scores = [_squares(half, book) for half, book in zip(halves(asks), books, strict=True)]
        needed = [
            _listed_before(scores[0][number], scores[1][number], counts, part[["first", "second"]].to_numpy())
            for number, part in true.groupby("number")
        ]
        needed = np.sort(np.concatenate([np.zeros(0, np.int64), *needed]))
        enough = int(needed[int(np.ceil(recall * len(needed))) - 1]) if len(needed) else total
        enough = max(least, enough)
    else:
        enough = max(least, int(np.ceil(share * total)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            held = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            firsts, seconds = map(_squares, halves(held), books)
            out = []
            for number, (vec_id, embedding) in enumerate(
                zip(batch["vec_id"], batch["embedding"], strict=True)
            ):
                by_first: dict[int, list[int]] = {}
                for i, j in traversal(firsts[number], seconds[number], counts, enough):
                    by_first.setdefault(i, []).append(j)
                out += [
                    (i, chunk, 1, vec_id, embedding, cells)
                    for i, cells in by_first.items()
                    for chunk in range(chunks[i])
                ]
            yield pd.DataFrame(out, columns=["first", "chunk", "kind", "id", "embedding", "cells"])

    asked = index.where("asks").select("vec_id", "embedding").mapInPandas(
        route, "first int, chunk int, kind int, id long, embedding array<double>, cells array<int>"
    )
    per_first = F.element_at(F.array(*map(F.lit, chunks)), F.col("first") + 1)
    listed = index.select(
        "first",
        F.pmod(F.xxhash64("vec_id"), per_first).cast("int").alias("chunk"),
        F.lit(0).alias("kind"),
        F.col("vec_id").alias("id"),
        "embedding",
        F.array("second").alias("cells"),
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, parts, held = None, [], None
        for batch in batches:
            for here, part in batch.groupby(["first", "chunk"], sort=False):
                if here != place:
                    place, parts, held = here, [], None
                if len(entries := part[part["kind"] == 0]):
                    parts.append(entries)
                    held = None
                wanted = part[part["kind"] == 1]
                if not len(wanted) or not parts:
                    continue
                if held is None:
                    entries = pd.concat(parts)
                    held = (
                        entries["id"].to_numpy(),
                        np.stack(entries["embedding"].to_numpy()).astype(np.float64),
                        np.concatenate(entries["cells"].to_numpy()),
                    )
                for at in range(0, len(wanted), 1024):
                    found = _best(*held, wanted.iloc[at : at + 1024], k)
                    if found is not None:
                        yield found

    dealt = listed.unionByName(asked).repartition("first", "chunk")
    dealt = dealt.sortWithinPartitions("first", "chunk", "kind")
    found = dealt.mapInPandas(search, "query_id long, vec_id long, score double")
    found = found.dropDuplicates(["query_id", "vec_id", "score"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    best = result.keep(best.select("query_id", "rank", "vec_id", "score"))
    scratch.drop()
    return best
