"""Pattern packing of documents into sequences by non-negative least squares.

Everything that is decided is decided on the histogram of lengths, which has at most
as many entries as a sequence has tokens, however many documents there are: how
often to use each pattern of a few lengths, and where the residual lengths go. Only
then do documents learn their places, by their rank among those of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecare.llm.encoding import encoding
from tablecare.llm.tables import Scratch
from tablecare.session import configure

#: length classes and documents of an enumerated pattern
CLASSES, PATTERN_DOCS = 64, 4
#: pieces of one length that are ranked together
_RANKED_ROWS = 2000

#: lengths with the times each occurs in a sequence, and how many sequences are like it
Pattern = tuple[tuple[tuple[int, int], ...], int]


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that minimises |ax - b|, by active sets."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            use = np.flatnonzero(active)
            fitted = np.linalg.lstsq(a[:, use], b, rcond=None)[0]
            if (fitted > 0).all():
                x[:] = 0
                x[use] = fitted
                break
            low = fitted <= 0
            step = (x[use][low] / np.maximum(x[use][low] - fitted[low], 1e-300)).min()
            x[use] += step * (fitted - x[use])
            active[use[x[use] <= 1e-12]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def _partitions(total: int, parts: int, most: int) -> Iterator[tuple[int, ...]]:
    if total == 0:
        yield ()
    elif parts:
        for first in range(min(total, most), 0, -1):
            if first * parts < total:
                break
            for rest in _partitions(total - first, parts - 1, first):
                yield (first, *rest)


class _Lengths:
    """What is left of the histogram."""

    def __init__(self, counts: dict[int, int]):
        self.left = {length: n for length, n in counts.items() if n}
        self.order = sorted(self.left)

    def largest(self, most: int, used: list[int]) -> int | None:
        """The largest length up to ``most`` of which more than the ``used`` are left."""
        i = bisect_right(self.order, most)
        while i:
            i -= 1
            length = self.order[i]
            if self.left[length] > used.count(length):
                return length
        return None

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.order.pop(bisect_left(self.order, length))


def plan_patterns(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that hold every length as often as ``counts`` says."""
    lengths = _Lengths(counts)
    width = max(1, -(-capacity // CLASSES))
    units = capacity // width
    classes = np.zeros(units + 1)
    for length, n in lengths.left.items():
        if -(-length // width) <= units:
            classes[-(-length // width)] += n
    shapes = list(_partitions(units, PATTERN_DOCS, units))
    usable = [s for s in shapes if all(classes[part] for part in s)]
    open_bins: dict[int, list[Pattern]] = {}

    def add(pattern: dict[int, int], n: int) -> None:
        room = capacity - sum(length * times for length, times in pattern.items())
        open_bins.setdefault(room, []).append((tuple(pattern.items()), n))

    if usable:
        matrix = np.zeros((units + 1, len(usable)))
        for number, shape in enumerate(usable):
            for part in shape:
                matrix[part, number] += 1
        repeats = np.floor(nonnegative_least_squares(matrix, classes) + 1e-9).astype(np.int64)
        for number in np.argsort(-repeats, kind="stable"):
            left = int(repeats[number])
            while left:
                chosen: list[int] = []
                room = capacity
                for place, part in enumerate(usable[number]):
                    last = place == len(usable[number]) - 1
                    length = lengths.largest(room if last else min(room, part * width), chosen)
                    if length is None or length <= (part - 1) * width:
                        break
                    chosen.append(length)
                    room -= length
                if len(chosen) < len(usable[number]):
                    break
                pattern = {length: chosen.count(length) for length in chosen}
                n = min(left, *(lengths.left[length] // times for length, times in pattern.items()))
                for length, times in pattern.items():
                    lengths.take(length, n * times)
                add(pattern, n)
                left -= n
    # residuals: the longest first, each into the fullest sequence it fits
    rooms = sorted(open_bins)
    for length in reversed(list(lengths.order)):
        n = lengths.left[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                times = capacity // length
                if n // times:
                    add({length: times}, n // times)
                if n % times:
                    add({length: n % times}, 1)
                n = 0
            else:
                room = rooms[at]
                pattern, bins = open_bins[room].pop()
                times = room // length
                full = min(bins, n // times)
                some = n - full * times if full < bins else 0
                held = dict(pattern)
                # a length met again is one more run of the pattern
                if full:
                    add(held | {length: held.get(length, 0) + times}, full)
                if some:
                    add(held | {length: held.get(length, 0) + some}, 1)
                if bins - full - bool(some):
                    open_bins[room].append((pattern, bins - full - bool(some)))
                n -= full * times + some
            rooms = sorted(r for r, held in open_bins.items() if held)
    return [pattern for room in sorted(open_bins) for pattern in open_bins[room]]


class _Places:
    """Sequence and offset by length and rank among the pieces of that length."""

    def __init__(self, patterns: list[Pattern]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for pattern, bins in patterns:
            offset = 0
            for length, times in pattern:
                rank = used.get(length, 0)
                rows.append((length, rank, sequence, offset, times))
                used[length] = rank + bins * times
                offset += length * times
            sequence += bins
        self.sequences = sequence
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.keys = (table[:, 0] << 44) + table[:, 1]
        self.table = table

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = self.table[np.searchsorted(self.keys, (length << 44) + rank, "right") - 1]
        beyond = rank - row[:, 1]
        return row[:, 2] + beyond // row[:, 4], row[:, 3] + beyond % row[:, 4] * length


def document_pieces(
    docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, with_ids: bool = True
) -> DataFrame:
    """The documents as pieces of at most ``size`` ids, written and read again.

    ``row`` (a number per row of ``docs``), ``doc_id``, ``piece`` (from 0), ``start`` (ids of the
    document before it), ``length``, ``ids`` (little-endian unsigned 32-bit) and
    ``ids_crc32``; places need no ``ids``, which ``with_ids`` leaves out. ``end_id`` closes each document; null texts count as empty. Only
    documents longer than ``size`` are cut.
    """
    spark = configure(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end, step = np.array([end_id], "<u4").tobytes(), 4 * size
        with encoding(tokenizer) as known:
            yield from cut_with(known, batches, end, step)

    def cut_with(known, batches, end, step) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            encoded = known.encode(batch["text"])
            for row, ids in zip(batch.itertuples(index=False), encoded, strict=True):
                ids += end
                for piece, start in enumerate(range(0, len(ids), step)):
                    part = ids[start : start + step]
                    out.append((row.row, row.doc_id, piece, start // 4, len(part) // 4, part, zlib.crc32(part)))
            table = pd.DataFrame(out, columns=names)
            yield table if with_ids else table.drop(columns="ids")

    names = ["row", "doc_id", "piece", "start", "length", "ids", "ids_crc32"]
    held = "ids binary, " if with_ids else ""
    schema = f"row long, doc_id string, piece int, start long, length long, {held}ids_crc32 long"
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string"), "text"
    )
    pieces = numbered.mapInPandas(cut, schema)
    pieces = pieces.withColumn("doc_id", F.col("doc_id").cast("long"))
    return Scratch(spark, "pieces").keep(pieces)


def pack_pieces(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """``pieces`` with the ``sequence_id`` (from 0) and ``offset`` of each; sequences hold at
    most ``size`` tokens, without gaps. An empty table gives an empty one.

    The histogram has at most ``size`` rows, the plan a few per length. Ranks are given
    within a length in groups of some thousand rows, so that a length that a third
    of all pieces have is shared out.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    places = _Places(plan_patterns(counts, size))
    # one literal with the groups of every length, however many lengths are frequent
    listed = ",".join(str(-(-counts.get(length, 0) // _RANKED_ROWS)) for length in range(size + 1))
    groups = F.get(F.split(F.lit(listed), ",").cast("array<int>"), F.col("length").cast("int"))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("row", "piece"), groups))
    sums = dealt.groupBy("length", "_group").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("_group")) - F.col("count")
    sums = sums.select("length", "_group", before.alias("_before"))
    rank = F.row_number().over(Window.partitionBy("length", "_group").orderBy("row", "piece"))
    ranked = dealt.withColumn("_rank", rank).join(sums, ["length", "_group"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.of(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    found = place("length", F.col("_before") + F.col("_rank") - 1)
    return ranked.select(*pieces.columns, found.alias("_place")).select(
        *pieces.columns, "_place.sequence_id", "_place.offset"
    )


def packed_sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``sequence_id`` and ``ids`` (the pieces of each sequence joined in order)."""
    held = pieces.select("row", "piece", "ids").join(
        places.select("row", "piece", "sequence_id", "offset"), ["row", "piece"]
    )
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    joined = F.aggregate(
        "parts", F.lit(b""), lambda all_ids, part: F.concat(all_ids, part["ids"])
    )
    return held.groupBy("sequence_id").agg(parts).select("sequence_id", joined.alias("ids"))
