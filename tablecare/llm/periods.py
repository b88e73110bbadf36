"""Runs of periodically repeated words, found by block convolution.

A run of period q is at least four periods long, so it holds an aligned block of B
words, B the largest power of two up to q, together with the next occurrence of that
block, q words on. At every scale B the sum of squared differences between a block
and the following window is taken for all distances from B to 2B - 1 at once, by a
number-theoretic transform; where it is zero the block occurs again. Such distances
seed the extension to whole runs.

Many texts are searched as one sequence: between two of them stands a word that
occurs nowhere else, which no run can cross.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.session import configure

#: fixed values: the prime 15 * 2**27 + 1 and a primitive root of it
_PRIME, _ROOT = np.uint64(2013265921), 31
#: words that are searched as one sequence, and numbers of one batch of transforms
_WORDS, _AT_ONCE = 1 << 17, 1 << 20

Words = list[bytes]


def _residue(x: np.ndarray) -> np.ndarray:
    return x - x // _PRIME * _PRIME


def _powers(base: int, count: int) -> np.ndarray:
    """``base`` to the powers 0 to ``count`` - 1, ``count`` a power of two."""
    found = np.ones(1, np.uint64)
    while len(found) < count:
        step = np.uint64(pow(base, len(found), int(_PRIME)))
        found = np.concatenate([found, _residue(found * step)])
    return found


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The number-theoretic transform of each row; the length is a power of two."""
    count, size = rows.shape
    if size > 1 << 27:
        raise ValueError("a transform holds at most 2**27 numbers")
    root = pow(_ROOT, (int(_PRIME) - 1) // size, int(_PRIME))
    if inverse:
        root = pow(root, -1, int(_PRIME))
    turns = _powers(root, max(1, size // 2))
    # after each step axis 2 is half as long and axis 1, the finished places, twice
    data, done = rows.reshape(count, 1, size), 1
    while done < size:
        half = size // done // 2
        even, odd = data[:, :, :half], data[:, :, half:]
        turned = _residue((even + _PRIME - odd) * turns[: half * done : done])
        whole = even + odd
        whole -= (whole >= _PRIME) * _PRIME
        # even outputs before odd ones in the lowest place: digits come out reversed
        data = np.stack([whole, turned], 2).reshape(count, 2 * done, half)
        done *= 2
    data = data.reshape(count, size)[:, _reversed_bits(size)]
    if inverse:
        data = _residue(data * np.uint64(pow(size, -1, int(_PRIME))))
    return data


def _reversed_bits(size: int) -> np.ndarray:
    places = np.zeros(1, np.int64)
    while len(places) < size:
        places = np.concatenate([2 * places, 2 * places + 1])
    return places


def _zero_distances(ids: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Blocks (by start) and distances from ``size`` to 2 ``size`` - 1 at which the
    squared differences vanish. Modulo a prime no zero is lost; one that is none in
    whole numbers is found out by ``_exact``."""
    squares = _residue(ids * ids)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(squares)])
    found_starts, found_distances = [], []
    places, at_once = np.arange(size), max(1, _AT_ONCE // (2 * size))
    for at in range(0, len(starts), at_once):
        part = starts[at : at + at_once]
        window = ids[part[:, None] + size + np.arange(2 * size)]
        # the block backwards, so that the product of the transforms is a correlation
        block = np.zeros_like(window)
        block[:, 0] = ids[part]
        block[:, : size : -1] = ids[part[:, None] + places[1:]]
        product = transform(_residue(transform(block) * transform(window)), inverse=True)
        at_window = part[:, None] + size + places
        total = sums[part + size] - sums[part]
        total = total[:, None] + sums[at_window + size] - sums[at_window]
        i, j = np.nonzero(_residue(total) == _residue(2 * product[:, :size]))
        found_starts.append(part[i])
        found_distances.append(j + size)
    if not found_starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_starts), np.concatenate(found_distances)


def _chains(at, distance, size, periods, whole=True) -> tuple[np.ndarray, ...]:
    """Blocks in a row with one distance, of those rows long enough for a run: the first
    block, the distance and the number of blocks, or (not ``whole``) every block."""
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    joined = (distance[1:] == distance[:-1]) & (at[1:] == at[:-1] + size)
    heads = np.flatnonzero(np.append(True, ~joined)[: len(at)])
    blocks = np.diff(np.append(heads, len(at)))
    enough = blocks >= ((periods - 1) * distance[heads] - size + 1) // size
    if whole:
        return at[heads][enough], distance[heads][enough], blocks[enough]
    each = np.repeat(enough, blocks)
    return at[each], distance[each], blocks


def _exact(ids, starts, distances, size) -> np.ndarray:
    """Whether blocks and their occurrences are equal as whole numbers."""
    same = np.ones(len(starts), bool)
    at_once = max(1, _AT_ONCE // size)
    for at in range(0, len(starts), at_once):
        here = starts[at : at + at_once, None] + np.arange(size)
        there = here + distances[at : at + at_once, None]
        same[at : at + at_once] = (ids[here] == ids[there]).all(1)
    return same


def _matches(ids: np.ndarray, at: np.ndarray, distance: np.ndarray, reach: int, way: int):
    """How many words from ``at`` on, in direction ``way``, equal the words ``distance``
    on; ``reach`` at most. Looks at twice as many words each time."""
    count, width = np.zeros(len(at), np.int64), 1
    left = np.arange(len(at))
    while len(left) and width <= 2 * reach:
        steps = np.arange(width)
        for part in np.array_split(left, 1 + len(left) * width // _AT_ONCE):
            here = at[part, None] + way * (count[part, None] + steps)
            # words beyond the sequence are like none; its ends are never equal
            inside = (here >= 0) & (here + distance[part, None] < len(ids))
            here = np.where(inside, here, 0)
            there = np.where(inside, here + distance[part, None], 0)
            equal = inside & (ids[here] == ids[there])
            count[part] += np.where(equal.all(1), width, equal.argmin(1))
        # those that matched to the last word looked at go on
        left = left[count[left] == 2 * width - 1]
        width *= 2
    return count


def find_runs(ids: np.ndarray, lengths: np.ndarray, periods: int = 4, least: int = 6) -> pd.DataFrame:
    """All runs in texts of ``lengths`` words that stand in ``ids`` one after the other,
    words as numbers from 1: ``text``, ``start``, ``length``, ``period``.

    A run is a stretch with smallest period q, of at least ``periods`` * q words (four
    or more) and ``least`` words, that cannot be prolonged.
    """
    if periods < 4 or least < 4:
        raise ValueError("runs have four periods and four words at least")
    begins = np.cumsum(lengths) - lengths
    # how far on each word comes again; beyond its text is as good as never
    order = np.argsort(ids, kind="stable")
    gap = np.full(len(ids), len(ids))
    again = ids[order[1:]] == ids[order[:-1]]
    gap[order[:-1][again]] = (order[1:] - order[:-1])[again]
    found: list[np.ndarray] = []
    size = 1
    while (long := np.flatnonzero(lengths >= max(periods * size, least))).size:
        # the long enough texts, each closed by a word of its own, then an end
        # in which windows of the last blocks find room
        words = lengths[long]
        offsets = np.cumsum(words + 1) - words - 1
        text = np.repeat(np.arange(len(long)), words)
        places = np.arange(len(text)) + text
        total = int(places[-1]) + 2
        padded = -(-total // size) * size + 3 * size
        top = np.uint64(ids.max(initial=0) + 1)
        sequence = top + np.arange(padded, dtype=np.uint64)
        inner = np.repeat(begins[long] - offsets, words) + places
        sequence[places] = ids[inner]
        if top + np.uint64(padded) >= _PRIME:
            raise ValueError("too many words for one search")
        starts = np.arange(0, total, size)
        # a block occurs again only if each of its words does, within the window
        near = np.zeros(len(starts) * size, bool)
        near[places] = gap[inner] < 2 * size
        near = near.reshape(-1, size).all(1)
        at, distance = _zero_distances(sequence, starts[near], size)
        if len(at) and found:
            # a block that goes on through a run of a smaller period tells of that one
            known = np.concatenate(found, 1)
            known = known[:, np.isin(known[0], long)]
            first = offsets[np.searchsorted(long, known[0])] + known[1]
            order = np.argsort(first)
            ends = np.maximum.accumulate(np.append(-1, (first + known[2])[order]))
            new = ends[np.searchsorted(first[order], at, "right")] < at + size + distance
            at, distance = at[new], distance[new]
        # too few blocks in a row are no run, whether equal or only so modulo the prime
        at, distance, _ = _chains(at, distance, size, periods, whole=False)
        same = _exact(sequence, at, distance, size)
        at, distance, blocks = _chains(at[same], distance[same], size, periods)
        if len(at):
            before = _matches(sequence, at - 1, distance, size, -1)
            after = _matches(sequence, at + blocks * size, distance, size, 1)
            start = at - before
            length = before + blocks * size + after + distance
            runs = length >= np.maximum(periods * distance, least)
            where = np.searchsorted(offsets, start, "right") - 1
            place = np.stack([long[where], start - offsets[where], length, distance])
            found.append(place[:, runs])
        size *= 2
    table = np.concatenate(found, 1) if found else np.zeros((4, 0), np.int64)
    runs = pd.DataFrame(dict(zip(("text", "start", "length", "period"), table, strict=True)))
    return runs.sort_values(["text", "start", "period"], ignore_index=True)


def _described(texts: Sequence[Words]) -> Iterator[tuple]:
    """For each text the columns of ``periodic_runs`` beside its own."""
    numbers = defaultdict(count(1).__next__)
    lengths = np.array([len(words) for words in texts], np.int64)
    ids = np.fromiter(
        map(numbers.__getitem__, chain.from_iterable(texts)), np.uint64, lengths.sum()
    )
    runs = find_runs(ids, lengths)
    edges = np.searchsorted(runs["text"], np.arange(len(texts) + 1))
    rows = runs[["start", "length", "period"]].to_numpy()
    for words, low, high in zip(texts, edges[:-1], edges[1:], strict=True):
        own = rows[low:high].tolist()
        best = None
        kept = words
        if own:
            for start, length, period in own:
                # greater exponents without rounding; ties to what came first
                if best is None or length * best[2] > best[1] * period:
                    best = (start, length, period)
            dropped = np.zeros(len(words) + 1, np.int64)
            for start, length, period in own:
                dropped[start + period] += 1
                dropped[start + length] -= 1
            kept = [words[i] for i in np.flatnonzero(np.cumsum(dropped)[:-1] == 0)]
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in own)
        yield (
            len(own),
            *(best or (None, None, None)),
            best[1] * 1000 // best[2] if best else None,
            hashlib.sha256(listed.encode()).hexdigest(),
            b" ".join(kept),
            own,
        )


def periodic_runs(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    change: Callable[[int | None, Words], Words] | None = None, texts: bool = True,
) -> DataFrame:
    """The runs of each text's words: ``doc_id``, ``n_runs``; ``start``, ``length``,
    ``period`` and ``exponent_milli`` of the one with the greatest exponent (nulls without
    any); ``runs_sha256`` over all as lines ``start,length,period``; ``collapsed_sha256`` of the
    words that are left when every run keeps its first period only, joined by spaces;
    with ``texts`` also those (``collapsed``) and the ``runs`` themselves.

    Words lie between ASCII white space. A null or empty text has no words. Each row is
    described by itself, so that repeated rows give repeated rows and an empty table an
    empty one; null ids stay. Other columns are not read. ``change`` may replace the words
    of a document before they are searched.
    """
    configure(docs.sparkSession)
    names = [
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
        "collapsed_sha256", "collapsed", "runs",
    ]
    schema = (
        "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
        "runs_sha256 string, collapsed_sha256 string, collapsed binary, runs array<array<long>>"
    )
    if not texts:
        names, schema = names[:-2], schema.partition(", collapsed binary")[0]

    def rows(ids: list, held: list[Words]) -> pd.DataFrame:
        out = []
        for doc_id, (*found, collapsed, runs) in zip(ids, _described(held), strict=True):
            digest = hashlib.sha256(collapsed).hexdigest()
            out.append((doc_id, *found, digest, collapsed, runs)[: len(names)])
        table = pd.DataFrame(out, columns=names)
        for name in names[:6]:
            table[name] = table[name].astype("Int64")
        return table

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, held, words = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                own = (text or b"").split()
                own = change(doc_id, own) if change else own
                ids.append(doc_id)
                held.append(own)
                words += len(own)
                if words >= _WORDS:
                    yield rows(ids, held)
                    ids, held, words = [], [], 0
            if ids:
                yield rows(ids, held)

    wanted = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text_column).cast("binary").alias("text"),
    )
    return wanted.mapInPandas(described, schema)
