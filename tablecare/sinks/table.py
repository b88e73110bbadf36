"""K1 to K6: write a table in any format."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.columns import col, visible
from tablecare.functions.text import as_text, iso_seconds
from tablecare.session import configured
from tablecare.sinks.publish import publish
from tablecare.sources.charset import allow_charset
from tablecare.sources.formats import SEPARATORS, check_format, format_of

_DATETIMES = (T.TimestampType, T.TimestampNTZType)
_FRACTIONS = (T.DoubleType, T.FloatType)


def default_destination(path: str) -> str:
    """``<stem>-normalized<suffix>`` beside the input."""
    source = PurePosixPath(path)
    # pathlib would fold the slashes of a URI such as hdfs://host/x
    head = path[: len(path.rstrip("/")) - len(source.name)]
    return f"{head}{source.stem}-normalized{source.suffix}"


def whole_seconds(df: DataFrame) -> DataFrame:
    """K5: datetime columns as ``yyyy-MM-ddTHH:mm:ss`` text."""
    return df.select(
        *[
            iso_seconds(col(f.name)).alias(f.name)
            if isinstance(f.dataType, _DATETIMES)
            else col(f.name)
            for f in df.schema
        ]
    )


def _plain_fractions(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            as_text(col(f.name), f.dataType).alias(f.name)
            if isinstance(f.dataType, _FRACTIONS)
            else col(f.name)
            for f in df.schema
        ]
    )


@configured
def write_table(
    df: DataFrame,
    path: str,
    fmt: str | None = None,
    overwrite: bool = False,
    single_file: bool = False,
    encoding: str | None = None,
) -> None:
    """Write a folder of part files; an existing one is an error by default.

    Text formats carry datetimes as whole seconds, Parquet keeps real types.
    ``single_file`` funnels the result through one task: small results only.
    """
    fmt = check_format(fmt) if fmt else format_of(path)
    table = df.select(*[col(c) for c in visible(df)])
    if fmt == "xlsx":
        from tablecare.sinks.workbook import write_workbooks

        write_workbooks(table, path, overwrite=overwrite, single_file=single_file)
        return
    if single_file:
        table = table.coalesce(1)
    publish(
        df.sparkSession,
        path,
        overwrite,
        lambda folder: _writer(table, fmt, encoding).save(folder),
    )


def file_form(table: DataFrame, fmt: str) -> DataFrame:
    """The values of a table as files of the format hold them."""
    if fmt == "parquet":
        return table
    table = whole_seconds(table)
    return _plain_fractions(table) if fmt in SEPARATORS else table


def file_options(writer, fmt: str):
    """Format and options of a batch or stream writer."""
    if fmt == "parquet":
        return writer.format("parquet")
    if fmt == "jsonl":
        return writer.format("json").option("ignoreNullFields", "false")
    return (
        writer.format("csv")
        .option("header", "true")
        .option("sep", SEPARATORS[fmt])
        .option("escape", '"')
        # the writer would trim edge spaces by default
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
    )


def _one_column_lines(table: DataFrame, separator: str) -> DataFrame:
    """The lines of a one-column text table, with a header in each part: the CSV writer
    leaves out rows that are nothing but a null."""
    name = table.columns[0]

    def field(text: Column) -> Column:
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        plain = ~text.rlike("^$|[\"\r\n]") & ~F.contains(text, F.lit(separator))
        return F.when(plain, text).otherwise(quoted)

    doubled = name.replace('"', '""')
    special = not name or any(c in name for c in ('"', "\r", "\n", separator))
    first = f'"{doubled}"' if special else name

    def under_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [first]})
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"value": batch.column(0)})

    text = F.coalesce(field(col(name).cast("string")), F.lit(""))
    return table.select(text.alias("value")).mapInArrow(under_header, "value string")


def _writer(table: DataFrame, fmt: str, encoding: str | None) -> DataFrameWriter:
    if fmt in SEPARATORS and len(table.columns) == 1 and not encoding:
        return _one_column_lines(file_form(table, fmt), SEPARATORS[fmt]).write.format("text")
    writer = file_options(file_form(table, fmt).write, fmt)
    if fmt == "parquet":
        return writer
    if encoding:
        allow_charset(table.sparkSession, encoding)
        writer = writer.option("encoding", encoding)
    return writer
