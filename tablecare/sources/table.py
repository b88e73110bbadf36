"""One entry point for all sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablecare.functions.columns import ROW_ORDER
from tablecare.session import configure
from tablecare.sources.delimited import read_delimited
from tablecare.sources.files import Paths, as_list, parquet_order
from tablecare.sources.formats import SEPARATORS, check_format, format_of
from tablecare.sources.jsonlines import read_json_lines
from tablecare.sources.workbook import read_workbooks


def read_parquet(
    spark: SparkSession, path: Paths, row_order: bool = False, recursive: bool = False
) -> DataFrame:
    """Types as stored."""
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.parquet(*as_list(path))
    return df.withColumn(ROW_ORDER, parquet_order()) if row_order else df


def read_table(
    spark: SparkSession,
    path: Paths,
    fmt: str | None = None,
    row_order: bool = False,
    **options,
) -> DataFrame:
    """Read a table from a file, folder, glob or list of them.

    The format follows the suffix unless ``fmt`` names it. ``row_order`` keeps
    the hidden source position, which keep-first and keep-last need. Options are
    those of the format's own reader.
    """
    configure(spark)
    fmt = check_format(fmt) if fmt else format_of(as_list(path))
    if fmt in SEPARATORS:
        return read_delimited(spark, path, SEPARATORS[fmt], row_order, **options)
    reader = {
        "jsonl": read_json_lines,
        "parquet": read_parquet,
        "xlsx": read_workbooks,
    }[fmt]
    return reader(spark, path, row_order, **options)
