"""SimHash near-duplicates by an inverted index of byte positions.

A fingerprint has eight bytes. Two fingerprints that differ in at most four bits
agree in at least four of the eight positions. The index therefore lists each
fingerprint under (positions, bytes) for sets of three positions, chosen so that
any four positions contain one of the sets; twenty sets do. Under one byte alone a
list would hold every 256th fingerprint and pairs would grow with the square of
the corpus; under three it holds every 16,777,216th. Of pairs that meet, the
positions with equal bytes are tallied, pairs with fewer than the guaranteed number
are dropped, and the differing bits of the others are counted.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm.buckets import linked
from tablecare.llm.tables import Scratch
from tablecare.session import configure

#: shingles whose bits are counted at a time
_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of a text, as an unsigned number; 0 without words.

    Words are what lies between ASCII white space, A-Z in lower case; shingles are
    hashed by XXH64, each as often as it occurs; a bit is 1 if it is set in more than
    half of the hashes. A text of fewer words than a shingle is one shingle.
    """
    from xxhash import xxh64_intdigest

    # the lower case and the split of bytes know ASCII letters and white space only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    width = min(shingle, len(words))
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), _AT_ONCE):
        spans = zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE], strict=True)
        hashes = np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], ">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes(), "big")


def fingerprints(text: Column, shingle: int = 4) -> Column:
    """The fingerprints of a text column as signed 64-bit numbers."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return of(text)


def index_positions(matches: int, size: int = 3) -> list[tuple[int, ...]]:
    """Sets of ``size`` of the eight byte positions such that any ``matches`` positions
    contain one of them."""
    if not size <= matches <= 8:
        raise ValueError("the distance leaves too few equal bytes to index by")
    if (matches, size) == (4, 3):
        # three parts in a ring: triples within a part, or two of a part and one of
        # the next; four positions always contain such a triple
        part = [0, 0, 0, 1, 1, 1, 2, 2]

        def chosen(triple: tuple[int, ...]) -> bool:
            parts = sorted(part[i] for i in triple)
            if parts[0] == parts[2]:
                return True
            twice = parts[1]
            once = parts[0] if parts[1] == parts[2] else parts[2]
            return len(set(parts)) == 2 and once == (twice + 1) % 3

        return [t for t in combinations(range(8), 3) if chosen(t)]
    open_sets = set(combinations(range(8), matches))
    positions = []
    while open_sets:
        best = max(
            combinations(range(8), size),
            key=lambda t: sum(set(t) <= set(s) for s in open_sets),
        )
        positions.append(best)
        open_sets = {s for s in open_sets if not set(best) <= set(s)}
    return positions


def _byte(fp: Column, position: int) -> Column:
    return F.shiftright(fp, 8 * position).bitwiseAND(255)


def _posting(fp: Column, number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("long")
    for position in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(fp, position))
    return key


def simhash_components(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    shingle: int = 4, max_distance: int = 4,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``, the smallest id
    reachable over fingerprints that differ in at most ``max_distance`` bits (5 at most).

    Null and empty texts have fingerprint zero and are linked like any other. Rows
    with a null id get the component of their fingerprint but never name one, so it is
    null if it has no other rows. Repeated rows give repeated rows, an empty table an
    empty one. Other columns are not read.

    Exact copies are one node from the start, whatever their number, so that only
    distinct fingerprints are indexed.
    """
    spark = configure(docs.sparkSession)
    result, scratch = Scratch(spark, "simhash"), Scratch(spark, "simhash-work")
    prints = result.keep(
        docs.select(
            F.col(id_column).alias("doc_id"),
            fingerprints(F.col(text_column), shingle).alias("fp"),
        )
    )
    matches = 8 - max_distance
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    postings = [
        _posting(F.col("fp"), number, positions)
        for number, positions in enumerate(index_positions(matches))
    ]
    index = nodes.select(F.explode(F.array(*postings)).alias("key"), F.col("fp").alias("node"))

    def verified(pairs: DataFrame) -> DataFrame:
        differing = F.col("node").bitwiseXOR(F.col("pivot"))
        tally = sum((_byte(differing, i) == 0).cast("int") for i in range(8))
        return pairs.where((tally >= matches) & (F.bit_count(differing) <= max_distance))

    def similar(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        a, b = (t["node"].to_numpy(np.int64).view(np.uint64) for t in (left, right))
        differing = a[:, None] ^ b[None, :]
        tally = (differing.view(np.uint8).reshape(*differing.shape, 8) == 0).sum(2)
        return (tally >= matches) & (np.bitwise_count(differing) <= max_distance)

    reached = linked(index, verified, lambda members: members, similar, scratch)
    rooted = nodes.join(reached.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = scratch.keep(rooted)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = result.keep(rooted.join(named, "root").select("fp", "component_id"))
    scratch.drop()
    return prints.join(classes, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents whose id names their component, all columns.

    Of repeated rows with one id one stays. Rows with a null id have no identity to
    be a copy by, and stay.
    """
    found = simhash_components(docs)
    counts = found.agg(
        F.count("doc_id").alias("rows"), F.count_distinct("doc_id").alias("ids")
    ).first()
    gone = found.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    if counts["rows"] == counts["ids"]:
        return kept.select(docs.columns)
    unnamed = kept.where(F.col("doc_id").isNull())
    named = kept.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return named.union(unnamed).select(docs.columns)
