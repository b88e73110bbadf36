"""Token ids as files: frequency ranks in byte-aligned lengths, control bytes apart.

Ids are replaced by their rank, the most frequent first, so that most take one byte.
Two bits of a control byte give the length, 1 to 4, of each of four values; the
control bytes of a block stand before its data bytes, and both are decoded at once
by a table from control byte to lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecare.llm.encoding import encoder
from tablecare.llm.tables import Scratch
from tablecare.session import configure

#: values after which a block is closed; a document is never cut
BLOCK_VALUES = 1 << 20
#: control byte -> lengths of its four values
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    lengths = 1 + (values > 0xFF).astype(np.uint8)
    width = 4 if len(values) and values.max() > 0xFFFF else 2
    if width > 2:
        lengths += values > 0xFFFF
        lengths += values > 0xFFFFFF
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = lengths - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(width) < lengths[:, None]
    held = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    return control.astype(np.uint8).tobytes(), held[used].tobytes()


def unpack_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    ends = np.cumsum(lengths)
    at = ends - lengths
    held = np.frombuffer(data + b"\0\0\0", np.uint8)
    values = held[at].astype(np.uint32)
    for more in (1, 2, 3):
        longer = np.flatnonzero(lengths > more)
        if not len(longer):
            break
        values[longer] |= held[at[longer] + more].astype(np.uint32) << np.uint32(8 * more)
    return values


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0) -> None:
    """Encode whole texts and write their ids, each document closed by ``end_id``.

    ``path`` gets ``blocks``, a Parquet folder per range of doc_ids in ascending order
    (``part``), whose rows are blocks of whole documents in ascending order, and
    ``ranks``, the id of each rank. Null texts count as empty. Null doc_ids come first;
    rows that repeat a doc_id stand in the order of their texts. Other columns are not
    read. An empty table writes empty ones.

    One range shuffle brings the texts in order; they are encoded once, into a table of
    ids, from which the frequencies and then the blocks come without a shuffle. The
    ranks have at most a row per id of the vocabulary.
    """
    spark = configure(docs.sparkSession)
    scratch = Scratch(spark, "ids")
    texts = docs.select("doc_id", "text").repartitionByRange("doc_id")
    texts = texts.sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, end, place = encoder(tokenizer), np.array([end_id], "<u4").tobytes(), 0
        counts, part = np.zeros(0, np.int64), -1
        for batch in batches:
            if not len(batch):
                continue
            ids = [i + end for i in known.encode(batch["text"])]
            values = np.frombuffer(b"".join(ids), "<u4")
            yield pd.DataFrame(
                {
                    "part": batch["part"],
                    "place": np.arange(place, place + len(batch)),
                    "doc_id": batch["doc_id"],
                    "ids": _narrowed(ids, values),
                    "wide": bool(values.max() > 0xFFFF),
                }
            )
            place += len(batch)
            here = np.bincount(values)
            if len(here) > len(counts):
                counts, here = here, counts
            counts[: len(here)] += here
            part = batch["part"].iloc[0]
        # the counts of the range follow its documents
        tally = counts.astype("<i8").tobytes()
        yield pd.DataFrame({"part": [part], "place": [-1], "doc_id": [None], "ids": [tally], "wide": [True]})

    typed = texts.withColumn("doc_id", F.col("doc_id").cast("string"))
    encoded = scratch.keep(
        typed.mapInPandas(encode, "part int, place long, doc_id string, ids binary, wide boolean")
    )

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for held in batch["ids"]:
                counts = np.frombuffer(held, "<i8")
                used = np.flatnonzero(counts)
                yield pd.DataFrame({"id": used, "count": counts[used]})

    tallies = encoded.where("place < 0").select("ids")
    encoded = encoded.where("place >= 0")
    counts = tallies.mapInPandas(tally, "id long, count long")
    counts = counts.groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    counts = counts.sort_values(["count", "id"], ascending=[False, True])
    by_rank = counts["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank))
    ranks = pd.DataFrame({"rank": np.arange(len(by_rank)), "id": by_rank})
    spark.createDataFrame(ranks, "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in batch.itertuples(index=False):
                # a task may read pieces of several parts
                follows = held and held[-1][0] == row.part and held[-1][1] + 1 == row.place
                if held and (not follows or size >= BLOCK_VALUES):
                    yield _block(held, rank_of)
                    held, size = [], 0
                ids = _values(row.ids, row.wide)
                held.append((row.part, row.place, row.doc_id, ids))
                size += len(ids)
        if held:
            yield _block(held, rank_of)

    schema = "part int, place long, doc_ids array<string>, sizes array<long>, control binary, data binary"
    written = encoded.mapInPandas(blocks, schema)
    written.write.option("compression", "zstd").partitionBy("part").parquet(f"{path}/blocks")
    scratch.drop()


def _narrowed(ids: list[bytes], values: np.ndarray) -> list[bytes]:
    """The ids of each document in two bytes, if all fit."""
    if values.max() > 0xFFFF:
        return ids
    ends = (np.cumsum([len(i) for i in ids]) // 2).tolist()
    held = values.astype("<u2").tobytes()
    return [held[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _values(ids: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(ids, "<u4" if wide else "<u2")


def _block(held: list[tuple], rank_of: np.ndarray) -> pd.DataFrame:
    control, data = pack_values(rank_of[np.concatenate([h[3] for h in held])])
    return pd.DataFrame(
        {
            "part": [held[0][0]],
            "place": [held[0][1]],
            "doc_ids": [[h[2] for h in held]],
            "sizes": [[len(h[3]) for h in held]],
            "control": [control],
            "data": [data],
        }
    )


def _documents(spark: SparkSession, path: str, digest: bool) -> DataFrame:
    by_rank = spark.read.parquet(f"{path}/ranks").orderBy("rank").toPandas()["id"].to_numpy(np.uint32)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                sizes = np.asarray(row.sizes)
                ids = by_rank[unpack_values(row.control, row.data, int(sizes.sum()))].astype("<u4")
                ends = 4 * np.cumsum(sizes)
                held = memoryview(ids.tobytes())
                spans = [held[b - 4 * n : b] for n, b in zip(sizes.tolist(), ends.tolist(), strict=True)]
                out = {
                    "part": np.full(len(sizes), row.part, np.int32),
                    "place": row.place + np.arange(len(sizes)),
                    "doc_id": row.doc_ids,
                }
                if digest:
                    out |= {"n_tokens": sizes, "ids_crc32": [zlib.crc32(span) for span in spans]}
                else:
                    out["ids"] = [bytes(span) for span in spans]
                yield pd.DataFrame(out)

    schema = "place long, doc_ids array<string>, sizes array<long>, control binary, data binary, part int"
    rows = spark.read.schema(schema).parquet(f"{path}/blocks")
    values = "n_tokens long, ids_crc32 long" if digest else "ids binary"
    out = rows.mapInPandas(decode, f"part int, place long, doc_id string, {values}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of ``write_ids``: ``part`` and ``place``, which give their order,
    ``doc_id`` and ``ids`` (little-endian unsigned 32-bit)."""
    return _documents(spark, path, digest=False)


def id_digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32`` of
    each document, from the ids decoded from the files."""
    rows = Scratch(spark, "id-digests").keep(_documents(spark, path, digest=True))
    # one row per range of doc_ids, then a running sum within each range
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("sum"))
    before = F.sum("sum").over(Window.orderBy("part")) - F.col("sum")
    parts = parts.select("part", before.alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place"))
    start = F.col("before") + inside - F.col("n_tokens")
    return rows.join(F.broadcast(parts), "part").select(
        "doc_id", start.cast("long").alias("start"), "n_tokens", "ids_crc32"
    )
