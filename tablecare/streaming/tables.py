"""Recipes over streams of table files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tablecare.functions.columns import col, visible
from tablecare.session import configure
from tablecare.sinks.table import file_form, file_options
from tablecare.sources.delimited import Header, text_options, text_rows
from tablecare.sources.formats import SEPARATORS, check_format
from tablecare.sources.typing import apply_types, fail_on_late

_EVENT_TIME = "__event_time__"


def read_stream(
    spark: SparkSession,
    path: str,
    fmt: str,
    schema: T.StructType,
    glob: str | None = None,
    max_files_per_trigger: int | None = None,
    multiline: bool = True,
) -> DataFrame:
    """New files of a folder as a stream. Streams need their types beforehand.

    A text row with surplus fields or with a value of another type fails the
    stream, as it fails a batch.
    """
    configure(spark)
    reader = spark.readStream
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if check_format(fmt) == "parquet":
        return reader.schema(schema).parquet(path)
    if fmt == "jsonl":
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    if fmt not in SEPARATORS:
        raise ValueError(f"{fmt!r} files cannot be streamed")
    separator = SEPARATORS[fmt]
    reader = reader.options(**text_options(separator, multiline))
    rows = text_rows(reader, path, Header(schema.names, exact=True), separator)
    types = {
        f.name: f.dataType.simpleString()
        for f in schema
        if not isinstance(f.dataType, T.StringType)
    }
    return apply_types(fail_on_late(rows, types), types)


def dedup_first(
    df: DataFrame, columns: Sequence[str], event_time: str, delay: str
) -> DataFrame:
    """Keep the first arrival of each key, and remember a key for ``delay``.

    State is bounded by the watermark: a key may return after its watermark has
    passed. Datetimes without a zone count as UTC.
    """
    # a watermark needs a timestamp with zone, which our datetimes are not
    timed = df.withColumn(_EVENT_TIME, col(event_time).cast("timestamp"))
    timed = timed.withWatermark(_EVENT_TIME, delay)
    return timed.dropDuplicatesWithinWatermark(list(columns)).drop(_EVENT_TIME)


def write_stream(
    df: DataFrame, path: str, fmt: str, checkpoint: str
) -> DataStreamWriter:
    """Append a cleaned stream to a folder; call ``start`` on the result."""
    if check_format(fmt) not in ("parquet", "jsonl", *SEPARATORS):
        raise ValueError(f"{fmt!r} files cannot be written from a stream")
    table = df.select(*[col(c) for c in visible(df)])
    writer = file_form(table, fmt).writeStream.outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    return file_options(writer, fmt).option("path", path)
