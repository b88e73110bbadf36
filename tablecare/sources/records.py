"""The records of delimited text: lines, joined where quotes hold line breaks.

Files are read line by line and split like any text. Within a split one pass follows
the quotes and joins lines. Whether a split begins inside quotes depends on all that is
in front of it; so a first pass, where one is needed, notes for each split how it ends
if it begins outside or inside, and windows over these few rows compose the
beginnings of all. The ends of records that began in an earlier split are put behind
them by a shuffle of these pieces alone. Blank lines are records too.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecare.functions.columns import ROW_ORDER
from tablecare.sources.files import is_utf8, split_bytes, utf8_or_fail

_MARK = "﻿"


def ends_inside(line: str, inside: bool, separator: str) -> bool:
    """Whether a quoted field is open at the end of a line that begins in one or not.

    A quote opens a field only as its first character, elsewhere it is a character like
    any other (``5" pipe``). Inside a quoted field two quotes are one.
    """
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            # behind the closing quote up to the separator quotes mean nothing
            at = line.find(separator, at + 1)
            if at < 0:
                return False
            at, inside = at + 1, False
        quote = line.find('"', at)
        if quote < 0:
            return False
        if quote == at or line[quote - 1] == separator:
            at, inside = quote + 1, True
        else:
            at = line.find(separator, quote)
            if at < 0:
                return False
            at += 1


def cells(record: str, separator: str) -> list[str]:
    """The fields of one record, for headers."""
    return next(csv.reader(io.StringIO(record, newline=""), delimiter=separator), [])


def text_lines(
    spark: SparkSession, paths: list[str], encoding: str | None, recursive: bool
) -> DataFrame:
    """``path``, ``block`` (where its split begins) and ``value`` of every line.

    Bytes that are no UTF-8 fail the job unless a charset is named; with UTF-8 named they
    are replaced.
    """
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    value = F.col("value")
    if encoding is None:
        value = utf8_or_fail(value)
    elif is_utf8(encoding):
        value = F.make_valid_utf8(value)
    else:
        value = F.decode(value.cast("binary"), encoding)
    return reader.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        value.alias("value"),
    )


def may_split(spark: SparkSession, largest: int) -> bool:
    """Whether Spark may read a file of that size in several splits."""
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    return largest > min(split_bytes(spark), split_bytes(spark, cost))


def _split() -> Column:
    return F.xxhash64("path", "block")


@dataclass(frozen=True)
class Beginnings:
    """Of each split (by hash) the place of the split in which the record began that it
    begins inside of, or none."""

    owners: dict[int, int | None]


def _unmarked(values: list[str], at_start: bool) -> list[str]:
    if at_start and values and values[0].startswith(_MARK):
        return [values[0][1:], *values[1:]]
    return values


def _quoted(values: pa.Array) -> list[int]:
    found = pc.match_substring(values, '"').to_numpy(zero_copy_only=False)
    return np.flatnonzero(found).tolist()


def _runs(splits: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(splits)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(splits)], strict=True)


def split_beginnings(lines: DataFrame, separator: str) -> Beginnings:
    """One pass over all lines; a file that ends inside quotes is refused."""

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, outside, inside, closes = None, False, True, False

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"path": [place[0]], "block": [place[1]], "outside": [outside],
                 "inside": [inside], "closes": [closes]}
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            for low, high in _runs(batch.column("split").to_numpy()):
                here = batch.column("path")[low].as_py(), batch.column("block")[low].as_py()
                values = batch.column("value").slice(low, high - low)
                begins = here != place
                if begins:
                    if place is not None:
                        yield told()
                    place, outside, inside, closes = here, False, True, False
                for n in _quoted(values):
                    line = values[n].as_py()
                    if not n and begins and not here[1] and line.startswith(_MARK):
                        line = line[1:]
                    inside_next = ends_inside(line, inside, separator)
                    same = outside == inside
                    outside = inside_next if same else ends_inside(line, outside, separator)
                    inside = inside_next
                    closes = closes or not inside
        if place is not None:
            yield told()

    schema = "path string, block long, outside boolean, inside boolean, closes boolean"
    told = lines.select("path", "block", _split().alias("split"), "value")
    told = told.mapInArrow(transitions, schema)
    # beginnings compose: the last split that ends alike whatever its beginning, and
    # how many since then turn it round
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = (F.col("outside") & ~F.col("inside")).cast("int")
    told = told.withColumn("turns", F.sum(turns).over(order))
    fixed = F.when(F.col("outside") == F.col("inside"), F.struct("outside", "turns"))
    told = told.withColumns(
        {
            "fixed": F.last(fixed, ignorenulls=True).over(before),
            "turned": F.coalesce(F.lag("turns").over(order), F.lit(0)),
        }
    )
    start = F.coalesce(F.col("fixed.outside"), F.lit(False)).cast("int")
    since = F.col("turned") - F.coalesce(F.col("fixed.turns"), F.lit(0))
    told = told.withColumn("begins", (start + since) % 2 == 1)
    told = told.withColumn("ends", F.when(F.col("begins"), F.col("inside")).otherwise(F.col("outside")))
    # a split that is inside one record from its beginning to its end owns nothing
    own = F.when(~F.col("begins") | F.col("closes"), F.col("block"))
    told = told.select(
        "path", _split().alias("split"), "begins", "ends",
        F.last(own, ignorenulls=True).over(before).alias("owner"),
        F.lead("block").over(order).isNull().alias("last"),
    )
    rows = told.select(
        "split", F.when(F.col("begins"), F.col("owner")).alias("owner"),
        F.when(F.col("last") & F.col("ends"), F.col("path")).alias("open"),
    ).collect()  # a row per split, as many as Spark's own list of them has
    for row in rows:
        if row["open"]:
            raise ValueError(f"a quote is never closed in {row['open']}")
    return Beginnings({row["split"]: row["owner"] for row in rows})


def text_records(
    lines: DataFrame, separator: str, header: list[str] | None, joined: bool = True,
    beginnings: Beginnings | None = None, row_order: bool = False, cut: bool = False,
) -> DataFrame:
    """``value`` of every record, the header of each file left out, which has to be ``header``.

    ``joined`` joins lines inside quotes. Without ``beginnings`` every split begins outside of
    them, and a quote that is open at its end fails the job or, with ``cut``, costs the
    record it opened. ``row_order`` adds the position of the record in its file set.
    """
    owners = beginnings.owners if beginnings else None
    whole = joined and owners is not None
    placed = row_order or whole

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple = ()
        split = number = owner = opened = None
        waiting = inside = False  # for the header; in quotes
        held: list[str] = []  # lines of a record that is not complete

        def batch_of(values, numbers, owner=None) -> pa.RecordBatch:
            count = len(values)
            columns = {"value": values}
            if placed:
                columns |= {"path": pa.repeat(place[0], count), "block": pa.repeat(place[1], count)}
            if row_order:
                columns["row"] = numbers
            if whole:
                columns["owner"] = pa.array([owner] * count, pa.int64())
            return pa.RecordBatch.from_pydict(columns)

        def rest() -> Iterator[pa.RecordBatch]:
            """What is open at the end of a split."""
            if held and owners is None and not cut:
                raise ValueError(f"a quote is never closed; it opens {held[0][:80]!r}")
            if held and owners is not None:
                mine = owner if opened is None else place[1]
                yield batch_of(["\n".join(held)], [opened or 0], mine)

        for batch in batches:
            if not batch.num_rows:
                continue
            for low, high in _runs(batch.column("split").to_numpy()):
                here = batch.column("split")[low].as_py()
                values = batch.column("value").slice(low, high - low)
                if here != split:
                    yield from rest()
                    held, opened, number, split = [], None, 0, here
                    first = batch.column("first")[low].as_py()
                    waiting = first and header is not None
                    if placed:
                        place = batch.column("path")[low].as_py(), batch.column("block")[low].as_py()
                    if owners is not None:
                        if here not in owners:
                            raise ValueError("files were split anew between two reads; read again")
                        owner = owners[here]
                    inside = owner is not None if whole else False
                    if first:
                        values = pa.array(_unmarked(values.to_pylist(), True), pa.string())
                quoted = _quoted(values) if joined else []
                start, number = number, number + len(values)
                if not waiting and not inside and not held:
                    opening = next((n for n in quoted if ends_inside(values[n].as_py(), False, separator)), None)
                    if opening is None:
                        yield batch_of(values, pa.array(range(start, number), pa.int64()))
                        continue
                texts, numbers = [], []
                some = set(quoted)
                for n, line in enumerate(values.to_pylist()):
                    was = inside
                    if n in some:
                        inside = ends_inside(line, inside, separator)
                    if not was and not inside:
                        texts.append(line)
                        numbers.append(start + n)
                        continue
                    if not was:
                        opened = start + n
                    held.append(line)
                    if not inside:
                        text = "\n".join(held)
                        if opened is None:  # it began in an earlier split
                            yield batch_of([text], [0], owner)
                        else:
                            texts.append(text)
                            numbers.append(opened)
                        held, opened = [], None
                if waiting:
                    filled = next((n for n, text in enumerate(texts) if text.strip("\r")), None)
                    if filled is not None:
                        found = cells(texts[filled].rstrip("\r"), separator)
                        if found != header:
                            raise ValueError(f"the headers of files differ: {found}, not {header}")
                        texts, numbers = texts[filled + 1 :], numbers[filled + 1 :]
                        waiting = False
                    else:
                        texts, numbers = [], []
                if texts:
                    yield batch_of(texts, numbers)
        yield from rest()

    columns = [_split().alias("split"), (F.col("block") == 0).alias("first"), "value"]
    schema = "value string"
    if placed:
        columns += ["path", "block"]
        schema += ", path string, block long"
    schema += ", row long" * row_order + ", owner long" * whole
    found = lines.select(*columns).mapInArrow(records, schema)
    if whole:
        pieces = found.where("owner is not null").groupBy("path", "owner")
        # the piece in the owner's own split is the first
        firsts = {"row": F.min_by("row", "block").alias("row")} if row_order else {}
        parts = F.sort_array(F.collect_list(F.struct("block", "value")))
        stitched = pieces.agg(
            F.concat_ws("\n", F.transform(parts, lambda p: p["value"])).alias("value"), *firsts.values()
        ).withColumnRenamed("owner", "block")
        names = ["value", *(["path", "block", "row"] if row_order else [])]
        found = found.where("owner is null").select(names).unionByName(stitched.select(names))
    ended = F.substring("value", F.lit(1), F.length("value") - 1)
    value = F.when(F.endswith("value", F.lit("\r")), ended).otherwise(F.col("value"))
    order = {ROW_ORDER: F.struct("path", "block", "row")} if row_order else {}
    return found.withColumn("value", value).withColumns(order).select("value", *order)


def first_record(lines: DataFrame, separator: str) -> str | None:
    """The first record of one file that is not blank; it may span lines."""
    wanted = 1
    while True:
        values = [row["value"] for row in lines.where("block = 0").select("value").take(wanted)]
        record, inside = "", False
        for number, line in enumerate(_unmarked(values, True)):
            if not inside and not record and not line.strip("\r"):
                continue
            record = f"{record}\n{line}" if inside else line
            inside = ends_inside(line, inside, separator)
            if not inside:
                return record.removesuffix("\r")
        if len(values) < wanted:
            return record.removesuffix("\r") or None
        wanted *= 8
