"""Repeated strings by merging the Burrows-Wheeler transforms of shards.

Suffixes are dealt out by content: of each string of ``length`` bytes the window of a
quarter of that with the smallest hash is its key, equal strings have equal keys. The
starts of one key that stand in a row make a segment. Keys that occur once are done
with; where all segments of a key are the same they are repeated whole. The segments of
other keys are sorted and transformed in small shards. Transforms of a task are merged
by refining their interleave: each round passes once over the merged transform and
places every suffix behind the symbol in front of it, so that after h rounds suffixes
are in the order of their first h symbols, whatever comes after. Nothing is sorted
again. Boundaries that a round adds give the common prefixes of neighbours; suffixes
between boundaries after the last round are the repeated strings.

A symbol is a string of up to 50 bytes, each byte starts a suffix. So 400 bytes take
8 rounds instead of 400.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecare.llm.tables import Scratch
from tablecare.session import configure

#: longest symbol, suffixes of a shard and (about) of a merge
_SYMBOL, _SHARD, _MERGE = 50, 1 << 16, 1 << 19
#: starts of a long text that are looked at together
_PART = 1 << 20
#: bytes of the different segments of a key that are merged in one task; the starts of
#: keys that have more are counted over the cluster
KEY_BYTES = 1 << 20

_ODD = 0x9E3779B97F4A7C15  # fixed value: 2**64 divided by the golden ratio


@lru_cache(maxsize=2)
def _bytes_as_numbers() -> np.ndarray:
    return np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2)


@lru_cache(maxsize=2)
def _powers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    both = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        steps = np.full(count, base, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes in a row."""
    powers, inverse = _powers(1 << max(16, (len(data) - 1).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_bytes_as_numbers()[data] + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    found = (sums[width:] - sums[:-width]) * inverse[: len(data) - width + 1]
    found ^= found >> np.uint64(31)
    found *= np.uint64(_ODD)
    return found ^ found >> np.uint64(29)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` values in a row: the end of one block of that
    width and the beginning of the next hold every window."""
    blocks = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max)
    blocks[: len(values)] = values
    blocks = blocks.reshape(-1, width)
    up = np.minimum.accumulate(blocks, 1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(down[:count], up[width - 1 : width - 1 + count])


def segments(text: bytes, length: int) -> tuple[np.ndarray, ...]:
    """First start, number of starts, key and hash of each segment, and whether a string
    may occur in it twice. Long texts are read in parts, whose edges end segments too."""
    parts = [
        _segments(text, at, min(at + _PART, len(text) - length + 1), length)
        for at in range(0, len(text) - length + 1, _PART)
    ]
    return parts[0] if len(parts) == 1 else tuple(map(np.concatenate, zip(*parts, strict=True)))


def _segments(text: bytes, at: int, upto: int, length: int) -> tuple[np.ndarray, ...]:
    from xxhash import xxh3_64_intdigest

    gram = max(1, length // 4)
    hashes = window_hashes(np.frombuffer(text, np.uint8, upto - at + length - 1, at), gram)
    width = length - gram + 1
    keys = _window_minima(hashes, width)
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    starts = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    contents = np.empty(len(first), np.uint64)
    inner = np.empty(len(first), bool)
    spans = zip(first.tolist(), (first + starts).tolist(), keys, strict=True)
    for i, (low, high, key) in enumerate(spans):
        contents[i] = xxh3_64_intdigest(text[at + low : at + high - 1 + length])
        inner[i] = np.count_nonzero(hashes[low : high - 1 + width] == key) > 1
    return at + first, starts, keys.view(np.int64), contents.view(np.int64), inner


def _stable_order(keys: np.ndarray, bound: int) -> np.ndarray:
    """``argsort`` of numbers below ``bound``, two bytes at a time: linear and stable."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    shift = 16
    while bound >> shift:
        digits = (keys >> shift & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digits[order], kind="stable")]
        shift += 16
    return order


def _dense(keys: np.ndarray, order: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Ranks of ``keys`` (and ``more``), given their order; equal ones share a rank."""
    new = np.zeros(len(keys), bool)
    for values in (keys, *more):
        ordered = values[order]
        new[1:] |= ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(new)
    return ranks


def shard_order(symbols: np.ndarray, stride: int) -> np.ndarray:
    """The suffixes of a shard in order; what follows a symbol is ``stride`` further on.

    The symbols that end a string differ from all others, so no suffix is the prefix of
    another one. Ranks by 1, 2, 4 ... symbols until all differ.
    """
    bound = int(symbols.max()) + 1
    order = _stable_order(symbols, bound)
    ranks = _dense(symbols, order)
    while ranks[order[-1]] + 1 < len(symbols):
        behind = np.zeros(len(symbols), np.int64)
        behind[: len(symbols) - stride] = ranks[stride:]
        order = _stable_order(behind, len(symbols))
        order = order[_stable_order(ranks[order], len(symbols))]
        ranks = _dense(ranks, order, behind)
        stride *= 2
    return order


def merged(
    transforms: list[np.ndarray], bound: int, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Merge transforms (the symbol in front of each suffix of a shard, in order of the
    suffixes) by refining their interleave ``rounds`` times.

    Returns for each place of the merged order the shard its suffix is from and the
    symbols it shares with the one before, counted up to ``rounds``.
    """
    sizes = [len(t) for t in transforms]
    symbols = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    block = np.zeros(len(symbols), np.int64)
    common = np.zeros(len(symbols), np.int64)
    for _ in range(rounds):
        in_front = np.empty_like(symbols)
        # every shard's suffixes keep their order in all interleaves
        in_front[np.argsort(shard, kind="stable")] = symbols
        order = _stable_order(in_front, bound)
        shard, in_front, before = shard[order], in_front[order], block[order]
        same = (in_front[1:] == in_front[:-1]) & (before[1:] == before[:-1])
        common[1:] += same
        block = np.cumsum(np.append(0, ~same))
    return shard, common


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """Per text whether the ``length`` bytes from each start on also start elsewhere in
    the texts. All have ``length`` bytes or more."""
    stride = max(n for n in range(1, _SYMBOL + 1) if length % n == 0)
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    # one node per byte and one for the end of each text; the last ``stride`` nodes have
    # no whole symbol, each of them ends one of the strings the text is read as
    nodes = sizes + 1
    ends = np.cumsum(nodes)
    begins = ends - nodes
    byte_begins = np.cumsum(sizes) - sizes
    grams = window_hashes(data, stride)
    own = np.concatenate([np.arange(b, b + n - stride + 1) for b, n in zip(byte_begins, sizes, strict=True)])
    filled = np.ones(ends[-1], bool)
    closing = (ends[:, None] - stride + np.arange(stride)).ravel()
    filled[closing] = False
    grams = grams[own]
    order = np.argsort(grams)
    symbols = np.empty(ends[-1], np.int64)
    symbols[closing] = np.arange(len(closing))
    symbols[filled] = len(closing) + _dense(grams, order)
    bound = len(symbols) + 1
    in_front = np.empty_like(symbols)
    in_front[stride:] = symbols[:-stride]
    # what is in front of a string's first symbol is its end
    heads = (begins[:, None] + np.arange(stride)).ravel()
    lengths = np.repeat(nodes, stride) - 1 - np.tile(np.arange(stride), len(texts))
    in_front[heads] = symbols[heads + lengths // stride * stride]
    orders, transforms, at = [], [], 0
    while at < len(texts):
        room = begins[at] + _SHARD
        upto = max(at + 1, int(np.searchsorted(ends, room, "right")))
        low, high = begins[at], ends[upto - 1]
        order = low + shard_order(symbols[low:high], stride)
        orders.append(order)
        transforms.append(in_front[order])
        at = upto
    shard, common = merged(transforms, bound, length // stride)
    node = np.empty(len(symbols), np.int64)
    node[np.argsort(shard, kind="stable")] = np.concatenate(orders)
    shared = common >= length // stride
    shared |= np.append(shared[1:], False)
    marked = np.zeros(len(symbols), bool)
    marked[node[shared]] = True
    return [marked[b : b + n - length + 1] for b, n in zip(begins, sizes, strict=True)]


def _ranges(marks: np.ndarray) -> list[list[int]]:
    """``[from, up to]`` of the stretches that are true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marks.view(np.int8), [0]])))
    return edges.reshape(-1, 2).tolist()


def _cut(text: bytes, ranges: list, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs and what is left, for ranges of repeated starts."""
    kept, removed, spans, end = [], 0, 0, 0
    for low, high in sorted((int(a), int(b) - 1 + length) for a, b in ranges):
        if low > end or not spans:
            kept.append(text[end:low])
            spans += 1
            removed += high - low
            end = high
        elif high > end:
            removed += high - end
            end = high
    kept.append(text[end:])
    return removed, spans, b"".join(kept)


def without_repeated_strings(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 400,
    key_bytes: int = KEY_BYTES,
) -> DataFrame:
    """Each text as UTF-8 bytes without those that lie in a string of ``length`` bytes
    which also starts anywhere else, in the same or another row.

    Columns ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and
    ``kept`` (binary, as a cut may fall inside a character). Strings are judged on the
    texts as given. Null texts count as empty, texts shorter than ``length`` stay whole.
    Repeated rows are copies of each other like any other texts; rows with a null id keep
    it. An empty table gives an empty one. Other columns are not read.

    ``key_bytes`` bounds what one task holds of one key and changes no result.
    """
    spark = configure(docs.sparkSession)
    result, scratch = Scratch(spark, "repeats"), Scratch(spark, "repeats-work")
    source = docs.select(
        F.col(id_column).alias("doc_id"),
        # names a row, or several that are the same
        F.xxhash64(F.col(id_column)).alias("d"),
        F.xxhash64(F.col(text_column)).alias("t"),
        F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")).alias("text"),
    )
    long = source.where(F.octet_length("text") >= length)

    def segmented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                parts = []
                for row in batch.iloc[at : at + 1000].itertuples(index=False):
                    found = segments(row.text, length)
                    count = len(found[0])
                    parts.append((np.full(count, row.d), np.full(count, row.t), *found))
                names = ("d", "t", "low", "starts", "key", "content", "inner")
                columns = map(np.concatenate, zip(*parts, strict=True))
                yield pd.DataFrame(dict(zip(names, columns, strict=True)))

    schema = "d long, t long, low long, starts long, key long, content long, inner boolean"
    listed = scratch.keep(long.select("d", "t", "text").mapInPandas(segmented, schema))
    keys = listed.groupBy("key").agg(
        F.count("*").alias("n"),
        (F.min("content") != F.max("content")).alias("varied"),
        F.bool_or("inner").alias("inner"),
    )
    keys = keys.where("n > 1 or inner").select(
        "key", (F.col("varied") | (F.col("n") == 1)).alias("varied")
    )
    found = scratch.keep(listed.drop("inner").join(keys, "key"))
    whole = found.where("not varied").select(
        "d", "t", "low", (F.col("low") + F.col("starts")).alias("high")
    )
    varied = found.where("varied")
    # all of one row: none of the columns is ever null
    one = [F.first(c).alias(c) for c in ("d", "t", "low", "starts")]
    distinct = scratch.keep(
        varied.groupBy("key", "content").agg(F.count("*").alias("n"), *one)
    )
    load = distinct.groupBy("key").agg(
        F.sum(F.col("starts") + length).alias("bytes"), F.count("*").alias("m")
    )
    load = load.select("key", (F.col("bytes") > key_bytes).alias("spread"))
    wanted = distinct.join(load, "key").groupBy("d", "t").agg(
        F.collect_list(F.struct("key", "content", "low", "starts", "spread")).alias("parts")
    )

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(1)
        for batch in batches:
            batch["text"] = [pack.compress(t) for t in batch["text"]]
            yield batch

    # compressed for the shuffle; of rows that are the same, one
    texts = long.select("d", "t", "text").mapInPandas(packed, "d long, t long, text binary")
    texts = texts.groupBy("d", "t").agg(F.first("text").alias("text"))

    def cut_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                for row in batch.iloc[at : at + 256].itertuples(index=False):
                    text = unpack.decompress(row.text)
                    for part in row.parts:
                        low = part["low"]
                        string = text[low : low + part["starts"] - 1 + length]
                        out.append((part["key"], part["content"], part["spread"], string))
                yield pd.DataFrame(out, columns=["key", "content", "spread", "string"])

    schema = "key long, content long, spread boolean, string binary"
    strings = scratch.keep(texts.join(wanted, ["d", "t"]).mapInPandas(cut_out, schema))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                if size >= _MERGE and row.key != held[-1][0]:
                    yield from _marked(held)
                    held, size = [], 0
                held.append((row.key, row.content, row.string))
                size += len(row.string)
        if held:
            yield from _marked(held)

    def _marked(held: list[tuple]) -> Iterator[pd.DataFrame]:
        marks = repeated_starts([string for _, _, string in held], length)
        out = [(k, c, _ranges(m)) for (k, c, _), m in zip(held, marks, strict=True) if m.any()]
        yield pd.DataFrame(out, columns=["key", "content", "ranges"])

    schema = "key long, content long, ranges array<array<long>>"
    by_key = strings.where("not spread").select("key", "content", "string")
    merged_ranges = by_key.repartition("key").sortWithinPartitions("key").mapInPandas(merge, schema)
    spread = strings.where("spread")
    # one row per content, so that no join makes more rows than there are segments
    if not spread.isEmpty():
        merged_ranges = merged_ranges.union(_spread_ranges(spread, length, key_bytes, scratch))
    copies = distinct.where("n > 1").select(
        "key", "content", F.array(F.array(F.lit(0).cast("long"), "starts")).alias("ranges")
    )
    partial = merged_ranges.join(copies, ["key", "content"], "left_anti").union(copies)
    partial = scratch.keep(partial)
    moved = F.transform(
        "ranges", lambda r: F.struct((F.col("low") + r[0]).alias("low"), (F.col("low") + r[1]).alias("high"))
    )
    places = varied.join(partial, ["key", "content"]).select("d", "t", moved.alias("ranges"))
    whole = whole.select("d", "t", F.array(F.struct("low", "high")).alias("ranges"))
    # rows that are the same give the same ranges
    ranges = whole.union(places).groupBy("d", "t").agg(
        F.flatten(F.collect_set("ranges")).alias("ranges")
    )
    ranges = result.keep(ranges)
    scratch.drop()

    def finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(0, len(batch), 256):
                out = []
                for row in batch.iloc[at : at + 256].itertuples(index=False):
                    text = unpack.decompress(row.text)
                    parts = [] if row.ranges is None else [(p["low"], p["high"]) for p in row.ranges]
                    out.append((row.doc_id, len(text), *_cut(text, parts, length)))
                yield pd.DataFrame(
                    out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
                )

    id_type = source.schema["doc_id"].dataType.simpleString()

    rows = source.mapInPandas(packed, f"doc_id {id_type}, d long, t long, text binary")
    return rows.join(ranges, ["d", "t"], "left").select("doc_id", "text", "ranges").mapInPandas(
        finished,
        f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary",
    )


#: a string of a chunk: its digest, the segment and start of it, whether it is there again
_ENTRY = np.dtype([("a", "<u8"), ("b", "<u8"), ("content", "<i8"), ("first", "<i4"), ("again", "?")])
#: entries of a bucket, about
_BUCKET = 1 << 16


def _spread_ranges(strings: DataFrame, length: int, key_bytes: int, scratch: Scratch) -> DataFrame:
    """Repeated starts of segments of very many forms, as ranges: a row per segment.

    The segments of a key are dealt to chunks. Each chunk compares the digests of its
    strings, then sends each different one once to a bucket, many to a row; a bucket finds
    those of several chunks. So a string of all segments is no load for one task.
    """
    sizes = strings.groupBy("key").agg(F.sum(F.octet_length("string")).alias("bytes"))
    chunks = F.ceil(F.col("bytes") / key_bytes).cast("int")
    buckets = F.ceil(F.col("bytes") / _BUCKET).cast("long")
    sizes = sizes.select("key", chunks.alias("chunks"), buckets.alias("buckets"))
    dealt = strings.join(sizes, "key").select(
        "key", F.pmod(F.xxhash64("content"), "chunks").alias("part"), "buckets", "content", "string"
    )

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[list]:
        """The rows of each key and part, which stand in a row."""
        held: list = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and (held[-1].key, held[-1].part) != (row.key, row.part):
                    yield held
                    held = []
                held.append(row)
        if held:
            yield held

    def counted(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """In order of the digests; the first of each, and how many share the digest."""
        entries = entries[np.lexsort((entries["b"], entries["a"]))]
        new = (entries["a"][1:] != entries["a"][:-1]) | (entries["b"][1:] != entries["b"][:-1])
        heads = np.flatnonzero(np.append(True, new))
        counts = np.diff(np.append(heads, len(entries)))
        return entries, heads, np.repeat(counts, counts)

    def split(entries: np.ndarray, by: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(by, kind="stable")
        heads = np.flatnonzero(np.diff(by[order], prepend=by[order[:1]] - 1))
        for places in np.split(order, heads[1:]):
            yield int(by[places[0]]), entries[places]

    def marks(key: int, entries: np.ndarray) -> list[tuple]:
        if not len(entries):
            return []
        found = split(entries, entries["content"])
        return [(key, None, content, held["first"].tobytes()) for content, held in found]

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for rows in grouped(batches):
            starts = [len(row.string) - length + 1 for row in rows]
            digests = b"".join(
                xxh3_128_digest(row.string[i : i + length])
                for row, count in zip(rows, starts, strict=True)
                for i in range(count)
            )
            entries = np.zeros(sum(starts), _ENTRY)
            entries["a"], entries["b"] = np.frombuffer(digests, "<u8").reshape(-1, 2).T
            entries["content"] = np.repeat([row.content for row in rows], starts)
            entries["first"] = np.concatenate([np.arange(count) for count in starts])
            entries, heads, counts = counted(entries)
            entries["again"] = counts > 1
            key, once = rows[0].key, entries[heads]
            bucket = (once["a"] % np.uint64(rows[0].buckets)).astype(np.int64)
            sent = [(key, number, None, held.tobytes()) for number, held in split(once, bucket)]
            out = marks(key, entries[entries["again"]]) + sent
            keys, parts, contents, held = zip(*out, strict=True)
            parts, contents = (pd.array(c, dtype="Int64") for c in (parts, contents))
            yield pd.DataFrame({"key": keys, "part": parts, "content": contents, "held": held})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in grouped(batches):
            entries, _, counts = counted(np.frombuffer(b"".join(row.held for row in rows), _ENTRY))
            out = marks(rows[0].key, entries[~entries["again"] & (counts > 1)])
            yield pd.DataFrame([(k, c, h) for k, _, c, h in out], columns=["key", "content", "held"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ranges = []
            for held in batch["held"]:
                firsts = np.sort(np.frombuffer(b"".join(held), "<i4")).astype(np.int64)
                edges = np.flatnonzero(np.diff(firsts) != 1) + 1
                ranges.append([[int(run[0]), int(run[-1]) + 1] for run in np.split(firsts, edges)])
            yield batch[["key", "content"]].assign(ranges=ranges)

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition("key", "part").sortWithinPartitions("key", "part")

    schema = "key long, part long, content long, held binary"
    found = scratch.keep(by_part(dealt).mapInPandas(compared, schema))
    across = by_part(found.where("part is not null").select("key", "part", "held"))
    across = across.mapInPandas(met, "key long, content long, held binary")
    here = found.where("part is null").select("key", "content", "held")
    each = here.union(across).groupBy("key", "content").agg(F.collect_list("held").alias("held"))
    return each.mapInPandas(joined, "key long, content long, ranges array<array<long>>")


def repeated_string_digests(docs: DataFrame, length: int = 400) -> DataFrame:
    """``without_repeated_strings`` with a sha256 (``kept_sha256``) in place of the bytes."""
    cleaned = without_repeated_strings(docs, length=length)
    return cleaned.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )

