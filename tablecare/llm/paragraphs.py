"""Substring deduplication: paragraphs that occur, nearly alike, elsewhere go.

Paragraphs are lines. A paragraph of enough words is a set of word shingles, whose
MinHash signature is cut into bands; paragraphs that share a band collide, their
exact Jaccard similarity is computed, and the components of the similar ones are
the classes of which one occurrence stays.

What lines cannot show (passages over several short lines, or inside lines that
differ around them) is found in the words of whole texts: see ``repeated_passages``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.functions.columns import col
from tablecare.llm.buckets import linked
from tablecare.llm.tables import Scratch
from tablecare.session import configure

SEPARATOR = "\n"
#: bytes of paragraphs that are hashed at a time
_AT_ONCE = 1 << 20
#: an odd multiplier has an inverse modulo 2**64, so prefix sums give the hash of
#: every substring
_BASE = 0x9E3779B97F4A7C15 | 1


def tuned_bands(similarity: float, recall: float, most: int = 256) -> tuple[int, int]:
    """Bands and rows per band that find a pair of just that similarity with probability
    ``recall``: the fewest hashes with which a pair of a quarter of it meets in one case
    of twenty at most, so that buckets don't fill up as the corpus grows; else the most
    selective setting of up to ``most`` hashes."""
    settings = []
    for rows in range(1, 17):
        miss = 1 - similarity**rows
        bands = 1 if miss <= 0 else max(1, int(np.ceil(np.log(1 - recall) / np.log(miss))))
        if bands * rows <= most:
            settings.append((bands, rows))
        if 1 - (1 - (similarity / 4) ** rows) ** bands <= 0.05:
            break
    return settings[-1]


class _Powers:
    """Powers of the base and of its inverse, as many as were needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < size:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up, self.down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(
    paragraphs: list[bytes], width: int, powers: _Powers
) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of paragraphs whose words are one space apart, and
    where those of each paragraph begin. Fewer words than ``width`` are one shingle."""
    data = np.frombuffer(b" ".join(paragraphs) + b" ", np.uint8)
    up, down = powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    words = np.array([p.count(b" ") + 1 for p in paragraphs])
    after = np.cumsum(words)
    counts = np.maximum(words - width + 1, 1)
    begins = np.concatenate([[0], np.cumsum(counts)[:-1]])
    first = np.repeat(after - words - begins, counts) + np.arange(counts.sum())
    last = np.minimum(first + width, np.repeat(after, counts)) - 1
    a, b = starts[first], ends[last]
    return _mixed((sums[b] - sums[a]) * down[a]), begins


class _Reader:
    """Long paragraphs of texts, and what is hashed of them."""

    def __init__(self, shingle: int, least_words: int, bands: int, rows: int, seed: int):
        self.shingle, self.least_words, self.bands, self.rows = shingle, least_words, bands, rows
        random = np.random.default_rng(seed)
        self.factors = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = _Powers()

    def paragraphs(self, text: str | None) -> Iterator[tuple[int, bytes]]:
        for number, paragraph in enumerate((text or "").split(SEPARATOR)):
            if paragraph.count(" ") + 1 < self.least_words and len(paragraph.split()) < self.least_words:
                continue
            words = paragraph.lower().encode("utf-8", "surrogatepass").split()
            if len(words) >= self.least_words:
                yield number, b" ".join(words)

    def in_parts(self, found: list[tuple]) -> Iterator[list[tuple]]:
        part, size = [], 0
        for item in found:
            part.append(item)
            size += len(item[-1])
            if size >= _AT_ONCE:
                yield part
                part, size = [], 0
        if part:
            yield part

    def keys(self, paragraphs: list[bytes]) -> np.ndarray:
        """A key per paragraph and band."""
        hashes, begins = shingle_hashes(paragraphs, self.shingle, self.powers)
        keys = np.empty((len(paragraphs), self.bands), np.uint64)
        for band in range(self.bands):
            key = np.full(len(paragraphs), band + 1, np.uint64)
            for row in range(self.rows):
                # the hashes are mixed, so that a product orders them anew
                permuted = hashes * self.factors[band * self.rows + row]
                key = _mixed(key * np.uint64(31) + np.minimum.reduceat(permuted, begins))
            keys[:, band] = key
        return keys.view(np.int64)

    def sets(self, paragraphs: list[bytes]) -> list[np.ndarray]:
        hashes, begins = shingle_hashes(paragraphs, self.shingle, self.powers)
        return [np.unique(h).view(np.int64) for h in np.split(hashes, begins[1:])]


def _digest(paragraph: bytes) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(paragraph)


def _similar(similarity: float):
    def similar(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        sets = [*left["shingles"], *right["shingles"]]
        sizes = np.array([len(s) for s in sets])
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(place) > 1  # the others are in no intersection
        column = np.cumsum(often) - 1
        row = np.repeat(np.arange(len(sets)), sizes)
        use = often[place]
        common = np.zeros((len(left), len(right)))
        width = int(often.sum())
        for at in range(0, width, 8192):
            here = use & (column[place] >= at) & (column[place] < at + 8192)
            held = np.zeros((len(sets), min(8192, width - at)), np.float32)
            held[row[here], column[place[here]] - at] = 1
            common += held[: len(left)] @ held[len(left) :].T
        union = sizes[: len(left), None] + sizes[None, len(left) :] - common
        return common >= similarity * union

    return similar


def repeated_paragraphs(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, least_words: int = 40,
    recall: float = 0.998, seed: int = 7,
) -> tuple[DataFrame, Scratch]:
    """``doc_id``, ``paragraph`` (number of the line, from 0) and ``component_id`` of each
    paragraph to be removed, and the tables that the result reads.

    Paragraphs of fewer than ``least_words`` words are left alone. Of a class the
    occurrence with the smallest (doc_id, paragraph) stays; ``component_id`` is its
    doc_id. Within a document repeats go too. Rows with null ids or texts have no
    paragraphs here. Rows that repeat a doc_id and paragraph are one occurrence.
    """
    spark = configure(docs.sparkSession)
    result, scratch = Scratch(spark, "paragraphs"), Scratch(spark, "paragraphs-work")
    bands, rows = tuned_bands(similarity, recall)
    setting = (shingle, least_words, bands, rows, seed)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _Reader(*setting)
        for batch in batches:
            found = [
                (doc_id, number, paragraph)
                for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True)
                for number, paragraph in reader.paragraphs(text)
            ]
            for part in reader.in_parts(found):
                texts = [p[2] for p in part]
                yield pd.DataFrame(
                    {
                        "doc_id": [p[0] for p in part],
                        "paragraph": [p[1] for p in part],
                        "node": [_digest(t) for t in texts],
                        "keys": list(reader.keys(texts)),
                    }
                )

    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    found = scratch.keep(
        texts.mapInPandas(read, "doc_id long, paragraph int, node binary, keys array<long>")
    )
    place = F.struct("doc_id", "paragraph")
    nodes = found.groupBy("node").agg(F.min(place).alias("first"), F.first("keys").alias("keys"))
    index = nodes.select(F.explode("keys").alias("key"), "node")
    # most keys are alone; told by a count, before nodes are compared to find pivots
    again = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    index = scratch.keep(index.join(again, "key"))

    sets_of: list[DataFrame] = []

    def attach(members: DataFrame) -> DataFrame:
        # all members are an end of a pair that was verified
        return members.join(sets_of[0], "node")

    def _shingles(members: DataFrame) -> DataFrame:
        """The shingle sets of some nodes, from the texts that hold them first."""
        wanted = members.select("node").distinct().join(nodes.select("node", "first"), "node")
        wanted = wanted.groupBy("first.doc_id").agg(
            F.collect_list(F.struct("first.paragraph", "node")).alias("wanted")
        )

        def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            reader = _Reader(*setting)
            for batch in batches:
                held = []
                for text, nodes_here in zip(batch["text"], batch["wanted"], strict=True):
                    names = {w["paragraph"]: w["node"] for w in nodes_here}
                    held += [(names[n], p) for n, p in reader.paragraphs(text) if n in names]
                # repeated rows of a doc_id may differ in text: only what was asked for
                held = [(name, p) for name, p in held if _digest(p) == bytes(name)]
                for part in reader.in_parts(held):
                    yield pd.DataFrame(
                        {"node": [p[0] for p in part], "shingles": reader.sets([p[1] for p in part])}
                    )

        taken = texts.join(wanted, "doc_id").select("text", "wanted")
        taken = taken.mapInPandas(sets, "node binary, shingles array<long>")
        return scratch.keep(taken.dropDuplicates(["node"]))

    def verified(pairs: DataFrame) -> DataFrame:
        ends = pairs.select("node").union(pairs.select("pivot"))
        shingles = _shingles(ends)
        sets_of.append(shingles)
        left = shingles.withColumnRenamed("shingles", "left")
        right = shingles.select(F.col("node").alias("pivot"), F.col("shingles").alias("right"))
        common = F.size(F.array_intersect("left", "right"))
        both = pairs.join(left, "node").join(right, "pivot")
        union = F.size("left") + F.size("right") - common
        return both.where(common >= F.lit(similarity) * union).select("node", "pivot")

    reached = linked(index, verified, attach, _similar(similarity), scratch)
    rooted = nodes.select("node", "first").join(reached, "node", "left")
    rooted = scratch.keep(rooted.select("node", "first", F.coalesce("root", "node").alias("root")))
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept"))
    classes = rooted.join(kept, "root").select("node", "kept")
    removed = found.select("doc_id", "paragraph", "node").join(classes, "node")
    removed = removed.where(place != F.col("kept"))
    removed = result.keep(
        removed.select("doc_id", "paragraph", F.col("kept.doc_id").alias("component_id")).distinct()
    )
    scratch.drop()
    return removed, result


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """All rows and columns of ``docs``, repeated paragraphs taken out of ``text``, and
    the arrays ``removed_paragraphs`` and ``removed_components`` (empty if none).

    Null and empty texts stay what they are, as do rows with a null id. Both added
    names replace columns of the same name. Settings: see ``repeated_paragraphs``.
    """
    removed, _ = repeated_paragraphs(docs, **settings)
    lines = _lines_by_doc(removed)
    found = _rows(docs).join(lines, F.col("row.doc_id") == F.col("of_lines"), "left")
    cut = _cutter()(F.when(F.col("of_lines").isNotNull(), F.col("row.text")), *_numbers(), F.array().cast(_SPANS))
    return _with_cuts(docs, found.withColumn("cut", cut), ["removed_paragraphs", "removed_components"])


def _rows(docs: DataFrame) -> DataFrame:
    """The rows as structs, so that no other name clashes with a column of theirs."""
    return docs.select(F.struct(*(col(c) for c in docs.columns)).alias("row"))


def _lines_by_doc(removed: DataFrame) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct("paragraph", "component_id")))
    return removed.groupBy(F.col("doc_id").alias("of_lines")).agg(lines.alias("lines"))


def _with_cuts(docs: DataFrame, found: DataFrame, added: list[str]) -> DataFrame:
    """``docs`` with the text that is left and the columns ``added``, from ``row`` and ``cut``."""
    types = {"removed_paragraphs": "array<int>", "removed_components": "array<long>", "cut_passages": _CUTS}
    new = {"text": F.coalesce("cut.text", "row.text")}
    new |= {name: F.coalesce(F.col("cut")[name], F.array().cast(types[name])) for name in added}
    names = [*docs.columns, *(n for n in added if n not in docs.columns)]
    return found.select(*(new.get(c, F.col("row")[c]).alias(c) for c in names))


# --- passages ---------------------------------------------------------------------

_WORD = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: words that a passage has at least
PASSAGE = 50
#: words of the runs that a passage with changes is put together from, of a seed, and
#: seeds of a run: the smallest hash of so many neighbours is selected, so that equal
#: runs have an equal seed selected
_RUN, _SEED = 24, 16
_NEIGHBOURS = _RUN - _SEED + 1
#: words that may differ between two runs of a passage
_GAP = 8
#: times that a seed is selected, after which its runs are dealt by their own hash
HOT_SEED = 1000


def _stretches(text: str, removed: list[int]) -> Iterator[tuple[int, list[str]]]:
    """The lines that stay, neighbours together, after the number of their first one."""
    gone, lines, at = set(removed), [], 0
    for number, line in enumerate(text.split(SEPARATOR)):
        if number in gone:
            if lines:
                yield at, lines
            lines = []
        else:
            at = at if lines else number
            lines.append(line)
    if lines:
        yield at, lines


def _words(text: str, removed: list[int]) -> tuple[list[bytes], np.ndarray]:
    """The stretches long enough for a run, their words one space apart, and the
    position of each one's first word. Between stretches positions skip a passage."""
    found, starts, at = [], [], 0
    for _, lines in _stretches(text, removed):
        words = SEPARATOR.join(lines).lower().encode("utf-8", "surrogatepass").split()
        if len(words) >= _RUN:
            found.append(b" ".join(words))
            starts.append(at)
        at += len(words) + PASSAGE
    return found, np.array(starts, np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the first smallest of each ``width`` values in a row, by doubling."""
    at, reach = np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        left, right = at[:-step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        reach += step
    return at


class _Runs:
    """The words of some texts, one behind another, and the hashes of their runs."""

    def __init__(self, texts: list[str], removed: list[list[int]], powers: _Powers):
        held, places, owners = [], [], []
        for number, (text, gone) in enumerate(zip(texts, removed, strict=True)):
            stretches, starts = _words(text, gone)
            held += stretches
            places += starts.tolist()
            owners += [number] * len(stretches)
        data = np.frombuffer(b" ".join(held) + b" ", np.uint8)
        up, self._down = powers.upto(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])
        self._ends = np.flatnonzero(data == 32) if held else np.zeros(0, np.int64)
        self._begins = np.concatenate([[0], self._ends[:-1] + 1])[: len(self._ends)]
        counts = np.array([s.count(b" ") + 1 for s in held], np.int64)
        after = np.cumsum(counts)
        #: of each word its text, its position there and the words up to its stretch's end
        self.owner = np.repeat(np.array(owners, np.int64), counts)
        self.at = np.arange(len(self._ends)) - np.repeat(after - counts - np.array(places, np.int64), counts)
        self.room = np.repeat(after, counts) - np.arange(len(self._ends))

    def hashes(self, width: int) -> np.ndarray:
        """Of the run from each word on, as by ``shingle_hashes``; the largest number
        where the stretch ends before."""
        found = np.full(len(self._ends), np.iinfo(np.uint64).max)
        count = max(0, len(found) - width + 1)
        a, b = self._begins[:count], self._ends[width - 1 :]
        whole = self.room[:count] >= width
        found[:count][whole] = _mixed((self._sums[b] - self._sums[a]) * self._down[a])[whole]
        return found

    def seeds(self) -> tuple[np.ndarray, np.ndarray]:
        """Selected words, in order, and the hashes of the seeds that begin there."""
        hashes = self.hashes(_SEED)
        if len(hashes) < _RUN:
            return np.zeros(0, np.int64), hashes[:0]
        least = _least(hashes, _NEIGHBOURS)
        marked = np.zeros(len(hashes), bool)
        marked[least[self.room[: len(least)] >= _RUN]] = True
        chosen = np.flatnonzero(marked)
        return chosen, hashes[chosen]

    def words_at(self, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The words with these positions in these texts."""
        wide = int(max(self.at.max(initial=0), at.max(initial=0))) + 1
        return np.searchsorted(self.owner * wide + self.at, owner * wide + at)

    def segments(self, again: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The runs of _RUN and of PASSAGE words whose smallest seed is marked in ``again``:
        the width, first words, hashes, and the places of the smallest seeds."""
        seeds = self.hashes(_SEED)
        inner, short = PASSAGE - _RUN + 1, None
        for width in (_RUN, PASSAGE):
            if len(seeds) < width:
                return
            least = _least(seeds, width - _SEED + 1)
            use = (self.room[: len(least)] >= width) & again[least]
            if short is None:
                short = np.concatenate([[0], np.cumsum(use)])
            else:  # all runs of a repeated passage are repeated
                use &= short[inner : inner + len(use)] - short[: len(use)] == inner
            first = np.flatnonzero(use)
            hashes = self.hashes(width)[first]
            yield width, first, hashes if width == _RUN else _mixed(hashes), least[first]


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Rows from, and up to, that have about as many bytes as are hashed at a time."""
    at, held = 0, 0
    for n, size in enumerate(sizes, 1):
        held += size
        if held >= _AT_ONCE or n == len(sizes):
            yield at, n
            at, held = n, 0


def _first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of runs that occur before, and where, from segments in the order of key,
    doc_id and position. What is known of a key is carried from batch to batch."""
    known = {n: np.zeros(0, np.int64) for n in ("hash", "doc_id", "at")}
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, docs, ofs, starts, widths = (_column(batch, n) for n in ("key", "doc_id", "of", "at", "width"))
        lists = batch.column("hashes")
        offsets = lists.offsets.to_numpy()
        counts = np.diff(offsets)
        hashes = lists.values.to_numpy()[offsets[0] : offsets[-1]]
        row = np.repeat(np.arange(len(counts)), counts)
        at = starts[row] + np.arange(len(row)) - (offsets[:-1] - offsets[0])[row]
        if last is not None and keys[0] != last:
            known = {n: v[:0] for n, v in known.items()}
        before = len(known["hash"])
        hashes = np.concatenate([known["hash"], hashes])
        doc = np.concatenate([known["doc_id"], docs[row]])
        place = np.concatenate([known["at"], at])
        order = np.argsort(hashes, kind="stable")
        new = np.append(True, hashes[order[1:]] != hashes[order[:-1]])
        first = np.empty(len(order), np.int64)
        first[order] = order[new][np.cumsum(new) - 1]
        last = keys[-1]
        held = np.concatenate([np.full(before, keys[0] == last), (keys == last)[row]])
        held &= first == np.arange(len(first))
        following = {"hash": hashes[held], "doc_id": doc[held], "at": place[held]}
        of, there = doc[first][before:], place[first][before:]
        use = np.flatnonzero((docs[row] != of) | (at != there))
        known = following
        if not len(use):
            continue
        row, at, of, there = row[use], at[use], of[use], there[use]
        change = (np.diff(row) != 0) | (np.diff(at) != 1) | (np.diff(of) != 0) | (np.diff(there) != 1)
        begins = np.concatenate([[0], np.flatnonzero(change) + 1])
        here = row[begins]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": docs[here], "of": ofs[here], "width": widths[here], "at": at[begins].astype(np.int32),
                "runs": np.diff(np.append(begins, len(row))).astype(np.int32), "first": of[begins],
                "there": there[begins].astype(np.int32),
            }
        )


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def _doc_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each document, from its stretches of runs, which stand together."""
    names = ("doc_id", "of", "width", "at", "runs", "first", "there")
    rest = [np.zeros(0, np.int64) for _ in names]
    for last, batch in _and_last(batches):
        if batch is not None:
            rest = [np.concatenate([r, _column(batch, n)]) for r, n in zip(rest, names, strict=True)]
        change = (np.diff(rest[0]) != 0) | (np.diff(rest[1]) != 0)
        edges = [0, *(np.flatnonzero(change) + 1).tolist()]
        if last:
            edges.append(len(rest[0]))
        found = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            doc_id, of = int(rest[0][a]), int(rest[1][a])
            width, at, runs, first, there = (r[a:b] for r in rest[2:])
            inside = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
            width, at, first, there = (np.repeat(v, runs) for v in (width, at, first, there))
            spans = _spans(doc_id, width, at + inside, first, there + inside)
            if spans:
                found.append({"doc_id": doc_id, "of": of, "spans": [dict(zip(_SPAN, s, strict=True)) for s in spans]})
        rest = [r[edges[-1] :] for r in rest]
        if found:
            yield pa.RecordBatch.from_pylist(found, schema=_DOC_SPANS)


def _and_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    for batch in batches:
        yield False, batch
    yield True, None


_SPAN = ("begin", "end", "component_id")
_DOC_SPANS = pa.schema(
    {
        "doc_id": pa.int64(), "of": pa.int64(),
        "spans": pa.list_(pa.struct(dict(zip(_SPAN, (pa.int32(), pa.int32(), pa.int64()), strict=True)))),
    }
)


def _spans(
    doc_id: int, width: np.ndarray, at: np.ndarray, of: np.ndarray, there: np.ndarray
) -> list[tuple[int, int, int]]:
    """Begin, end and first document of what goes, from the runs of a document that
    occur before: width, position, first doc_id and position there."""
    spans = []
    long = width == PASSAGE
    # where a run overlaps its own first occurrence, that stays whole
    own = np.where((of == doc_id) & long, there + PASSAGE, at)
    spans += zip(np.maximum(at, own)[long], at[long] + PASSAGE, of[long], strict=True)
    short = ~long & ((of != doc_id) | (at - there >= PASSAGE))
    at, of, there = at[short], of[short], there[short]
    if len(at):
        order = np.lexsort((at, of))
        at, of, there = at[order], of[order], there[order]
        shift = at - there
        apart = (np.diff(of) != 0) | (np.diff(at) > _RUN + _GAP) | (abs(np.diff(shift)) > _GAP)
        begins = np.concatenate([[0], np.flatnonzero(apart) + 1])
        ends = np.concatenate([begins[1:], [len(at)]]) - 1
        fresh = np.concatenate([[_RUN], np.minimum(np.diff(at), _RUN)])
        fresh[begins] = _RUN
        covered = np.add.reduceat(fresh, begins)
        begin, end, first = at[begins], at[ends] + _RUN, of[begins]
        use = (end - begin >= PASSAGE) & (covered >= 0.8 * (end - begin))
        use &= abs(shift[ends] - shift[begins]) <= 0.2 * (end - begin)
        begin = np.where(first == doc_id, np.maximum(begin, there[ends] + _RUN), begin)
        spans += zip(begin[use], end[use], first[use], strict=True)
    joined: list[list[int]] = []
    for begin, end, first in sorted((int(b), int(e), int(f)) for b, e, f in spans if b < e):
        if joined and begin <= joined[-1][1]:
            joined[-1][1] = max(end, joined[-1][1])
            joined[-1][2] = min(first, joined[-1][2])
        else:
            joined.append([begin, end, first])
    return [tuple(s) for s in joined]


def _cut(text: str, removed: list[int], components: list[int], spans: list[tuple[int, int, int]]) -> dict:
    """The text without lines and spans, the lines wholly gone, and what was cut."""
    kept, cuts, gone, at = [], [], dict(zip(removed, components, strict=True)), 0
    # spans are in order and apart, so that lines and spans are gone through together
    spans, ahead = sorted(spans), 0
    for first_line, lines in _stretches(text, removed):
        for number, line in enumerate(lines, first_line):
            if ahead == len(spans):
                kept.append(line)
                continue
            words = list(_WORD.finditer(line))
            here, end = [], at + len(words)
            while ahead < len(spans) and spans[ahead][0] < end:
                b, e, f = spans[ahead]
                if e > at:
                    here.append((max(b, at) - at, min(e, end) - at, f))
                if e > end:
                    break
                ahead += 1
            at = end
            cuts += [(number, b, e - b, f) for b, e, f in here]
            if here and sum(e - b for b, e, _ in here) == len(words):
                gone[number] = here[0][2]
                continue
            for b, e, _ in reversed(here):
                after = words[e].start() if e < len(words) else len(line)
                before = words[b].start() if e < len(words) or not b else words[b - 1].end()
                line = line[:before] + line[after:]
            kept.append(line)
        at += PASSAGE
    return {
        "text": SEPARATOR.join(kept),
        "removed_paragraphs": sorted(gone),
        "removed_components": [gone[n] for n in sorted(gone)],
        "cut_passages": [dict(zip(("paragraph", "word", "words", "component_id"), c, strict=True)) for c in cuts],
    }


_CUTS = "array<struct<paragraph:int,word:int,words:int,component_id:long>>"
_SPANS = "array<struct<begin:int,end:int,component_id:long>>"
_AGAIN = "doc_id long, of long, width int, at int, runs int, first long, there int"


def _numbers() -> tuple[Column, Column]:
    """The removed lines and their components, empty if none."""
    return (
        F.coalesce(F.col("lines.paragraph"), F.array().cast("array<int>")),
        F.coalesce(F.col("lines.component_id"), F.array().cast("array<long>")),
    )


def _cutter():
    @F.pandas_udf(f"text string, removed_paragraphs array<int>, removed_components array<long>, cut_passages {_CUTS}")
    def cut(text: pd.Series, numbers: pd.Series, components: pd.Series, spans: pd.Series) -> pd.DataFrame:
        names = ["text", "removed_paragraphs", "removed_components", "cut_passages"]
        rows = [
            dict.fromkeys(names) if t is None
            else _cut(t, n, c, [(s["begin"], s["end"], s["component_id"]) for s in held])
            for t, n, c, held in zip(text, numbers, components, spans, strict=True)
        ]
        return pd.DataFrame(rows, columns=names, dtype=object)

    return cut


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, Scratch]:
    """``doc_id``, ``of`` (XXH64 of the text) and ``spans`` of words (``begin``, ``end``,
    ``component_id``) that occur in an earlier place, and the tables that these read.

    ``docs`` has ``doc_id``, ``text`` and ``removed``, the numbers of lines not to be read.
    Words are compared in lower case, line breaks are white space. A run of PASSAGE
    words goes wherever it occurs after its smallest (doc_id, position); so does one with
    changes, if runs of _RUN words found first in one document, in the same order, cover 0.8 of
    it and no gap is longer than _GAP words. A first occurrence that the repeat overlaps
    stays whole.

    One in five runs of _SEED words is selected by content. Only runs whose smallest seed is
    selected twice are hashed at every word. Equal runs have an equal smallest seed, so
    neighbours that share it travel as one row to where that seed is dealt. The runs of
    seeds selected over HOT_SEED times are dealt one by one, by their own hash.
    """
    spark = configure(docs.sparkSession)
    result, scratch = Scratch(spark, "passages"), Scratch(spark, "passages-work")
    texts = docs.where("doc_id is not null and text is not null")
    texts = texts.select("doc_id", F.xxhash64("text").alias("of"), "text", "removed")

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            docs_, ofs = _column(batch, "doc_id"), _column(batch, "of")
            held, removed = batch.column("text").to_pylist(), batch.column("removed").to_pylist()
            for a, b in _parts([len(t) for t in held]):
                runs = _Runs(held[a:b], removed[a:b], powers)
                chosen, keys = runs.seeds()
                row = a + runs.owner[chosen]
                at = runs.at[chosen].astype(np.int32)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": docs_[row], "of": ofs[row], "at": at, "key": keys.view(np.int64)}
                )

    every = scratch.keep(texts.mapInArrow(seeds, "doc_id long, of long, at int, key long"))
    often = every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    often = often.select("key", (F.col("n") > HOT_SEED).alias("hot"))
    wanted = every.join(often, "key")
    wanted = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("of", "at", "hot")).alias("seeds"))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = _Powers()
        for batch in batches:
            docs_, ofs = _column(batch, "doc_id"), _column(batch, "of")
            held, removed = batch.column("text").to_pylist(), batch.column("removed").to_pylist()
            lists = batch.column("seeds")
            offsets = lists.offsets.to_numpy()
            owner = np.repeat(np.arange(len(held)), np.diff(offsets))
            marks = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            seed_of, seed_at, hot = (marks.field(n).to_numpy(zero_copy_only=False) for n in ("of", "at", "hot"))
            own = seed_of == ofs[owner]  # rows of one id may differ in text
            for a, b in _parts([len(t) for t in held]):
                runs = _Runs(held[a:b], removed[a:b], powers)
                here = own & (owner >= a) & (owner < b)
                places = runs.words_at(owner[here] - a, seed_at[here].astype(np.int64))
                again = np.zeros(len(runs.at), bool)
                often_ = again.copy()
                again[places] = True
                often_[places] = hot[here]
                for width, first, hashes, least in runs.segments(again):
                    if not len(first):
                        continue
                    alone = often_[least]
                    change = (np.diff(first) != 1) | (np.diff(least) != 0) | alone[1:]
                    begins = np.concatenate([[0], np.flatnonzero(change) + 1])
                    key = np.where(alone, hashes, runs_key(runs, least))[begins].view(np.int64)
                    row = a + runs.owner[first[begins]]
                    lists = pa.ListArray.from_arrays(
                        np.append(begins, len(first)).astype(np.int32), pa.array(hashes.view(np.int64))
                    )
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key": key, "doc_id": docs_[row], "of": ofs[row],
                            "at": runs.at[first[begins]].astype(np.int32),
                            "width": np.full(len(row), width, np.int32), "hot": alone[begins], "hashes": lists,
                        }
                    )

    def runs_key(runs: _Runs, least: np.ndarray) -> np.ndarray:
        return runs.hashes(_SEED)[least]

    taken = texts.join(wanted, "doc_id").select("doc_id", "of", "text", "removed", "seeds")
    taken = scratch.keep(
        taken.mapInArrow(
            segments, "key long, doc_id long, of long, at int, width int, hot boolean, hashes array<long>"
        )
    )
    dealt = taken.where("not hot").drop("hot").repartition("key").sortWithinPartitions("key", "doc_id", "at")
    again = dealt.mapInArrow(_first_runs, _AGAIN)

    place = F.struct("doc_id", "at")
    alone = taken.where("hot").drop("hot", "hashes")
    firsts = alone.groupBy("width", "key").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    alone = alone.join(firsts.where("first != last"), ["width", "key"]).where(place != F.col("first"))
    alone = alone.select(
        "doc_id", "of", "width", "at", F.lit(1).alias("runs"),
        F.col("first.doc_id").alias("first"), F.col("first.at").alias("there"),
    )
    by_doc = again.union(alone).repartition("doc_id").sortWithinPartitions("doc_id", "of")
    schema = f"doc_id long, of long, spans {_SPANS}"
    passages = result.keep(by_doc.mapInArrow(_doc_spans, schema))
    scratch.drop()
    return passages, result


def without_passages(docs: DataFrame, **settings) -> DataFrame:
    """As ``without_repeats``, and repeated passages of what is left are taken out of
    ``text``, and the arrays ``removed_paragraphs`` (lines that are gone),
    ``removed_components`` and ``cut_passages`` (``paragraph``, first ``word``, number of
    ``words`` and ``component_id`` of what passages took out of lines), empty if none.

    Null and empty texts stay what they are, as do rows with a null id. The added
    names replace columns of the same name. Settings: see ``repeated_paragraphs``;
    passages: see ``repeated_passages``.

    The rows are dealt by doc_id once. What is found of a document meets its text there,
    by joins on doc_id alone, so that texts are not shuffled again.
    """
    spark = configure(docs.sparkSession)
    rows = _rows(docs).select(F.col("row.doc_id").alias("doc_id"), "row")
    rows = Scratch(spark, "passages-rows").dealt(rows, "doc_id")
    texts = rows.select("doc_id", F.col("row.text").alias("text"))
    removed, _ = repeated_paragraphs(texts, **settings)
    by_doc = _lines_by_doc(removed).withColumnRenamed("of_lines", "doc_id")
    read = texts.join(by_doc, "doc_id", "left").select("doc_id", "text", _numbers()[0].alias("removed"))
    passages, _ = repeated_passages(read)
    passages = passages.groupBy("doc_id").agg(F.collect_list(F.struct("of", "spans")).alias("passages"))
    found = rows.join(by_doc, "doc_id", "left").join(passages, "doc_id", "left")
    own = F.filter("passages", lambda p: p["of"] == F.xxhash64(F.col("row.text")))
    spans = F.coalesce(F.get(own, F.lit(0))["spans"], F.array().cast(_SPANS))
    touched = F.col("lines").isNotNull() | (F.size(spans) > 0)
    cut = _cutter()(F.when(touched, F.col("row.text")), *_numbers(), spans)
    added = ["removed_paragraphs", "removed_components", "cut_passages"]
    return _with_cuts(docs, found.withColumn("cut", cut), added)
