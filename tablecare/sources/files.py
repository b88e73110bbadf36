"""What a path, glob or folder tree holds, and where each row came from."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Paths = str | Sequence[str]


def as_list(path: Paths) -> list[str]:
    return [path] if isinstance(path, str) else list(path)


def list_files(spark: SparkSession, path: Paths, recursive: bool = False) -> DataFrame:
    """``path, length`` of every file: a listing, the content is never read."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(as_list(path)).select("path", "length")


def literal_path(path: str) -> str:
    """A listed path for Spark to open as it is, not as a glob pattern."""
    return re.sub(r"([*?\[\]{}\\])", r"\\\1", path)


def split_bytes(spark: SparkSession, size: str | None = None) -> int:
    """Largest piece of a file Spark gives to one task; or another size in bytes."""
    text = (size or spark.conf.get("spark.sql.files.maxPartitionBytes")).lower().rstrip("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    return int(text) if text.isdigit() else int(text[:-1]) * units[text[-1]]


def text_order() -> Column:
    """Row position in a text file set: file, split, running number.

    The running number grows inside a split, whatever else its task reads.
    """
    return F.struct(*text_order_fields())


def text_order_fields() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ]


def utf8_or_fail(value: Column) -> Column:
    """Lines of a text file as they are; bytes that are no UTF-8 fail the job."""
    hint = F.lit(" holds bytes that are no UTF-8; see charset_census and name a charset")
    message = F.concat(F.col("_metadata.file_path"), hint)
    return F.when(F.is_valid_utf8(value), value).otherwise(F.raise_error(message))


def is_utf8(charset: str) -> bool:
    return charset.upper().replace("_", "-") in ("UTF-8", "UTF8")


def parquet_order() -> Column:
    return F.struct(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.row_index").alias("row"),
    )
