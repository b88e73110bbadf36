"""Collocations of words, counted in a dictionary of overlapping chunks.

Texts are parsed at content: where a window of words has a hash divisible by a fixed
number a chunk ends, and the next one begins with that window again. Equal passages
give equal chunks wherever they stand, so the different chunks with their frequencies
(the dictionary of a prefix-free parse) hold every phrase of the corpus. Phrases are
counted inside the different chunks, weighted by frequency; those that lie wholly in
the window a chunk shares with the one before belong to that one.

Most phrases are rare. So words are counted with the dictionary, then hashes of pairs of
frequent words, and only phrases all of whose pairs may be frequent are counted as text.
Frequent words and pairs go to the tasks as a bit map of bounded size; a bit set by
chance costs work, not rightness.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecare.llm.tables import Scratch
from tablecare.session import configure

#: a chunk ends at one of so many windows
_CHUNK = 96
#: bits of the map of frequent phrases, whatever the corpus
_MOST_BITS = 1 << 27
#: words of chunks that are counted together in a task
_WORDS = 1 << 18
#: parts of a group that are ranked by themselves first
_PARTS = 32

#: stands for all separators of pieces, which no phrase goes over
_END = b"."
_TO_END = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b".........")

_ONE, _SIX, _LOW = np.uint64(1), np.uint64(6), np.uint64(63)
#: hashes have 48 bits: as they only say what may be frequent, chance hits do no harm.
#: From each of these on the map takes bits.
_CUT, _PROBES = np.uint64(16), (0, 10, 21)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # odd constants


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z only) with ``_END`` between pieces."""
    marked = (text or b"").lower().translate(_TO_END)
    return marked.replace(_END, b" . ").split()


def _mixed(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    both = (hashes * _MIX[0]) ^ (following + _MIX[1])
    both ^= both >> np.uint64(32)
    both *= _MIX[1]
    return both ^ both >> np.uint64(29)


class _Batch:
    """Word sequences as one array of word numbers, with the hash of each word."""

    def __init__(self, sequences: list[list[bytes]], seed: int = 0):
        from xxhash import xxh3_64_intdigest

        numbers = defaultdict(count().__next__)
        numbers[_END]  # gets zero
        self.lengths = np.array([len(s) for s in sequences], np.int64)
        self.ids = np.fromiter(
            map(numbers.__getitem__, chain.from_iterable(sequences)), np.int64, self.lengths.sum()
        )
        self.words = list(numbers)
        hashes = (xxh3_64_intdigest(word, seed) for word in self.words)
        self.hashes = np.fromiter(hashes, np.uint64, len(self.words))


def chunked(sequences: list[list[bytes]], window: int, modulus: int = _CHUNK) -> list[list[bytes]]:
    """The chunks of each sequence, as texts with a space between words. The first begins
    with a window of ``_END``, every other one with the last window of the one before."""
    padded = [[_END] * window + s for s in sequences]
    batch = _Batch(padded)
    hashes = batch.hashes[batch.ids]
    windows = hashes.copy()
    for step in range(1, window):
        windows[step:] = _mixed(windows[step:], hashes[:-step])
    ends = np.cumsum(batch.lengths)
    cuts = np.flatnonzero(windows % np.uint64(modulus) == 0) + 1
    out = []
    for begin, end, words in zip(ends - batch.lengths, ends, padded, strict=True):
        own = cuts[np.searchsorted(cuts, begin + window, "right") : np.searchsorted(cuts, end)]
        edges = [window, *(own - begin).tolist(), len(words)]
        out.append(
            [
                b" ".join(words[low - window : high])
                for low, high in zip(edges[:-1], edges[1:], strict=True)
                if high > low
            ]
        )
    return out


def _seed(lang: str) -> int:
    """Equal words of two groups have different hashes."""
    return zlib.crc32(lang.encode())


class _Phrases:
    """The phrases in chunks of one group, each known by the place of its last word."""

    def __init__(self, lang: str, chunks: list[bytes], weights: np.ndarray, window: int):
        self.batch = _Batch([c.split(b" ") for c in chunks], _seed(lang))
        lengths = self.batch.lengths
        self.ids, self.weights = self.batch.ids, np.repeat(weights, lengths)
        begins = np.cumsum(lengths) - lengths
        # a phrase belongs to the chunk that has its last word behind the first window
        self.own = np.arange(len(self.ids)) - np.repeat(begins, lengths) >= window

    def last_places(self, size: int) -> np.ndarray:
        """Where phrases of ``size`` words end. The window in front of a chunk's own words
        is long enough for them to begin in the same chunk."""
        good = self.own.copy()
        for step in range(size):
            good[step:] &= self.ids[: len(good) - step] > 0
        return np.flatnonzero(good)

    def hashes(self, places: np.ndarray, size: int) -> np.ndarray:
        found = self.batch.hashes[self.ids[places]]
        for step in range(1, size):
            found = _mixed(found, self.batch.hashes[self.ids[places - step]])
        return found >> _CUT

    def keys(self, places: np.ndarray, size: int) -> np.ndarray:
        """Numbers that are equal for equal phrases only."""
        bound = len(self.batch.words)
        found, top = self.ids[places], bound
        for step in range(1, size):
            if top * bound >= 1 << 63:
                found = np.unique(found, return_inverse=True)[1]
                top = len(found)
            found, top = found * bound + self.ids[places - step], top * bound
        return found

    def texts(self, places: np.ndarray, size: int) -> list[bytes]:
        words = self.batch.words
        columns = [
            [words[i] for i in self.ids[places - step].tolist()] for step in reversed(range(size))
        ]
        return list(map(b" ".join, zip(*columns, strict=True)))


def _summed(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Different values, a place of each, and the sum of their weights."""
    order = np.argsort(values)
    values = values[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    sums = np.add.reduceat(weights[order], first) if len(first) else weights[:0]
    return values[first], order[first], sums


def phrase_counts(
    docs: DataFrame, group: Column, text: Column, most: int, least: int, scratch: Scratch
) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``size`` and ``f`` of the phrases of up to ``most`` words that occur
    ``least`` times or more in a group (``lang``), overlaps included, and ``lang``, ``n`` (words)."""
    window = max(1, most - 1)
    source = docs.select(group.alias("lang"), text.cast("binary").alias("text"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                for lang, part in batch.iloc[at : at + 500].groupby("lang"):
                    texts = [tokens(t) for t in part["text"]]
                    chunks = Counter(chain.from_iterable(chunked(texts, window)))
                    words = Counter(chain.from_iterable(texts))
                    words.pop(_END, None)
                    for word, found in ((False, chunks), (True, words)):
                        yield pd.DataFrame(
                            {"lang": lang, "word": word, "text": found.keys(), "n": found.values()}
                        )

    parsed = source.mapInPandas(parse, "lang string, word boolean, text binary, n long")
    parsed = scratch.keep(parsed.groupBy("lang", "word", "text").agg(F.sum("n").alias("n")))
    dictionary = parsed.where("not word").select("lang", F.col("text").alias("chunk"), "n")
    words = parsed.where("word").select("lang", F.col("text").alias("phrase"), F.col("n").alias("f"))
    totals = scratch.keep(words.groupBy("lang").agg(F.sum("f").alias("n")))
    words = words.where(F.col("f") >= least).withColumn("size", F.lit(1))

    def word_hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            pairs = zip(batch["phrase"], batch["lang"], strict=True)
            found = [xxh3_64_intdigest(word, _seed(lang)) for word, lang in pairs]
            found = np.array(found, np.uint64) >> _CUT
            yield pd.DataFrame({"hash": found.view(np.int64)})

    frequent = words.select("lang", "phrase").mapInPandas(word_hashes, "hash long")
    word_bits = _bit_map(scratch.keep(frequent))

    def batched(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[str, _Phrases]]:
        held: dict[str, list] = defaultdict(list)
        sizes: dict[str, int] = defaultdict(int)
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                held[lang].append(rows)
                sizes[lang] += int(rows["chunk"].map(len).sum()) // 6
                if sizes[lang] >= _WORDS:
                    yield lang, _Phrases(lang, *_columns(held.pop(lang)), window)
                    sizes[lang] = 0
        for lang, rows in held.items():
            yield lang, _Phrases(lang, *_columns(rows), window)

    def _columns(parts: list[pd.DataFrame]) -> tuple[list[bytes], np.ndarray]:
        rows = pd.concat(parts)
        return rows["chunk"].tolist(), rows["n"].to_numpy(np.int64)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, phrases in batched(batches):
            places = phrases.last_places(2)
            for step in (0, 1):  # a pair is no more frequent than its words
                places = places[_in_map(word_bits, phrases.hashes(places - step, 1))]
            values, _, sums = _summed(phrases.hashes(places, 2), phrases.weights[places])
            yield pd.DataFrame({"hash": values.view(np.int64), "n": sums})

    pairs = dictionary.mapInPandas(hashed, "hash long, n long")
    pairs = pairs.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    pair_bits = _bit_map(scratch.keep(pairs.select("hash")))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for lang, phrases in batched(batches):
            for size in range(2, most + 1):
                places = phrases.last_places(size)
                for step in range(size - 1):  # nor a phrase than its pairs
                    places = places[_in_map(pair_bits, phrases.hashes(places - step, 2))]
                _, first, sums = _summed(phrases.keys(places, size), phrases.weights[places])
                found = phrases.texts(places[first], size)
                yield pd.DataFrame({"lang": lang, "size": size, "phrase": found, "f": sums})

    texts = dictionary.mapInPandas(counted, "lang string, size int, phrase binary, f long")
    texts = texts.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    found = texts.where(F.col("f") >= least).unionByName(words)
    return scratch.keep(found.withColumn("phrase", F.col("phrase").cast("string"))), totals


def _bit_map(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes: 16 bits each, 16 MB at most."""
    size = min(_MOST_BITS, 1 << max(10, (16 * hashes.count()).bit_length()))
    probes = F.array(*[F.shiftright("hash", p).bitwiseAND(size - 1) for p in _PROBES])
    one = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    rows = hashes.select(F.explode(probes).alias("bit"))
    rows = rows.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    rows = rows.toPandas()
    found = np.zeros(size // 64, np.uint64)
    found[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return found


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    there, last = np.ones(len(hashes), bool), np.uint64(64 * len(bits) - 1)
    for probe in _PROBES:
        bit = hashes >> np.uint64(probe) & last
        there &= bits[bit >> _SIX] >> (bit & _LOW) & _ONE > 0
    return there


def collocations(
    docs: DataFrame, text_column: str = "text", group_column: str = "lang", most: int = 3,
    least: int = 10, top: int = 2000, absorbed: int = 50,
) -> DataFrame:
    """The ``top`` phrases of two to ``most`` words of each group by mutual information.

    Texts (null: empty) are split at ``.,;:!?`` and line breaks into pieces, and those at
    spaces and tabs into words, A-Z in lower case. A phrase that occurs ``a`` >= ``least``
    times is cut after its first k words; with ``l`` and ``r`` occurrences of the two parts
    the score is floor(1000000 a a / (l r)) of the cut where that is lowest, the first of
    equal ones. Phrases inside a longer one that occurs at least ``absorbed`` percent as often
    are left out. Best score first, then the more frequent, then by bytes.

    Columns ``lang`` (null: ``und``), ``rank`` from 1, ``phrase``, ``a``, ``l``, ``r``, ``n`` (words of
    the group) and ``score``. Every row counts, repeated ones too; ids play no part; groups
    without a phrase give no row, an empty table none. Other columns are not read.
    """
    spark = configure(docs.sparkSession)
    result, scratch = Scratch(spark, "phrases"), Scratch(spark, "phrases-work")
    group = F.coalesce(F.col(group_column).cast("string"), F.lit("und"))
    counts, totals = phrase_counts(docs, group, F.col(text_column), most, least, scratch)
    phrases = counts.where("size > 1").withColumn("words", F.split("phrase", " "))

    def part(first: Column, size: Column) -> Column:
        return F.array_join(F.slice("words", first, size), " ")

    k, size = F.col("k"), F.col("size")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
        "lang", "phrase", F.col("f").alias("a"), "k",
        part(F.lit(1), k).alias("left"), part(k + 1, size - k).alias("right"),
    )
    parts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    cuts = cuts.join(parts, ["lang", "left"])
    parts = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    cuts = cuts.join(parts, ["lang", "right"])
    a, l, r = (F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r"))
    product = F.lit(1_000_000).cast("decimal(7,0)") * (a * a)
    score = F.call_function("div", product, l * r).cast("long").alias("score")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut"))

    inner = phrases.where("size > 2").select(
        "lang", "f", "words", "size",
        F.explode(F.sequence(F.lit(2), size - 1)).alias("k"),
    )
    inner = inner.withColumn("first", F.explode(F.sequence(F.lit(1), size - k + 1))).select(
        "lang", part(F.col("first"), k).alias("phrase"), "f"
    )
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))
    )
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]

    def ranked(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
        return rows.withColumn("rank", rank).where(F.col("rank") <= top)

    # a group of any size reaches the task that ranks it as the best of its parts
    dealt = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS)))
    best = ranked(ranked(dealt, "lang", "part"), "lang")
    found = best.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )
    found = result.keep(found)
    scratch.drop()
    return found
