"""S3: one JSON object per line."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.columns import ROW_ORDER
from tablecare.sources.charset import allow_charset, is_wide, transcode_lines
from tablecare.sources.files import (
    Paths,
    as_list,
    is_utf8,
    text_order,
    text_order_fields,
    utf8_or_fail,
)


def _reader(
    spark: SparkSession, encoding: str | None, recursive: bool
) -> DataFrameReader:
    reader = spark.read.option("mode", "FAILFAST")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if encoding and not is_wide(encoding):
        allow_charset(spark, encoding)
        reader = reader.option("encoding", encoding).option("lineSep", "\n")
    return reader


def _lines(
    reader: DataFrameReader, paths: list[str], encoding: str | None, group: int
) -> DataFrame:
    """``at`` (place among all groups) and ``value`` of every line, in its charset."""
    value = F.col("value")
    if encoding is None:
        value = utf8_or_fail(value)
    elif not is_wide(encoding) and not is_utf8(encoding):
        value = F.decode(value.cast("binary"), encoding)
    at = F.struct(F.lit(group).alias("group"), *text_order_fields()).alias("at")
    return reader.text(paths).select(at, value.alias("value"))


def _keys(lines: DataFrame) -> tuple[dict[str, str], bool]:
    """The type of each key, in the order of the files and lines that show them first,
    and whether these types are those of Spark's own reader.

    Not so where a line is no plain object, an object is empty, or all numbers are
    integral and some are no longs: decimals do not tell 2.0 from 2.
    """
    entries = F.from_json("value", "map<string,variant>")
    found = (
        lines.select("at", "value", entries.alias("entries"))
        .select(
            "at",
            (F.col("entries").isNull() & (F.trim("value") != "")).alias("odd"),
            F.posexplode_outer("entries").alias("pos", "key", "entry"),
        )
        .groupBy("key")
        .agg(
            F.min(F.struct("at", "pos")).alias("first"),
            F.expr("schema_of_variant_agg(entry)").alias("type"),
            F.count_if("odd").alias("odd"),
        )
        .orderBy("first")
        .select("key", "type", "odd")
        .collect()
    )
    types = {row["key"]: row["type"] for row in found if row["key"] is not None}
    doubtful = any(re.search(r"DECIMAL\(\d+, ?0\)|OBJECT<>", t) for t in types.values())
    return types, not doubtful and not any(row["odd"] for row in found)


def _read_type(text: str) -> T.DataType:
    """The type in which the JSON reader yields what a variant schema describes."""
    objects = re.sub(r"(`(?:[^`]|``)*`)|OBJECT<", lambda m: m[1] or "STRUCT<", text)
    return _plain(T.StructType.fromDDL(f"x {objects}")[0].dataType)


def _plain(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _plain(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_plain(kind.elementType))
    if isinstance(kind, T.DecimalType):
        return T.DoubleType()
    return T.StringType() if isinstance(kind, T.VariantType | T.NullType) else kind


def _merged(schemas: list[T.StructType]) -> T.StructType:
    """One schema for several file groups: numbers widen, other differences are text."""
    types: dict[str, T.DataType] = {}
    for field in (f for schema in schemas for f in schema):
        known = types.setdefault(field.name, field.dataType)
        if known != field.dataType:
            numbers = {type(known), type(field.dataType)} <= {T.LongType, T.DoubleType}
            types[field.name] = T.DoubleType() if numbers else T.StringType()
    return T.StructType([T.StructField(n, t) for n, t in types.items()])


def read_json_lines(
    spark: SparkSession,
    path: Paths,
    row_order: bool = False,
    schema: T.StructType | str | None = None,
    encoding: str | None = None,
    charsets: dict[str, list[str]] | None = None,
    recursive: bool = False,
    sampling_ratio: float | None = None,
) -> DataFrame:
    """Read JSON lines; a malformed line fails the job.

    Without ``schema`` one aggregate over the data (or over ``sampling_ratio`` of its
    lines) learns the types and the order of the keys, and fails on bytes that are no
    UTF-8 unless a charset is named. Date-like text stays text, nested values become
    arrays and structs. Columns keep the order of their first appearance. ``charsets``
    maps a charset to the paths written in it and replaces ``path``/``encoding``.
    """
    groups = {
        # line by line, Spark reads no wide charset
        c: [transcode_lines(spark, paths, c)] if is_wide(c) else paths
        for c, paths in (charsets or {encoding: as_list(path)}).items()
    }
    readers = {c: _reader(spark, c, recursive) for c in groups}
    if schema is None:
        lines = reduce(
            DataFrame.unionByName,
            [_lines(readers[c], paths, c, n) for n, (c, paths) in enumerate(groups.items())],
        )
        if sampling_ratio is not None:
            lines = lines.sample(sampling_ratio, seed=0)
        types, certain = _keys(lines)
        if certain:
            merged = T.StructType([T.StructField(n, _read_type(t)) for n, t in types.items()])
        else:
            for reader in readers.values():
                if sampling_ratio is not None:
                    reader.option("samplingRatio", str(sampling_ratio))
            merged = _merged([readers[c].json(paths).schema for c, paths in groups.items()])
        names = [n for n in types if n in merged.names]
        names += [n for n in merged.names if n not in types]
        schema = T.StructType([merged[n] for n in names])
    order = {ROW_ORDER: text_order()} if row_order else {}
    return reduce(
        DataFrame.unionByName,
        [
            readers[c].schema(schema).json(paths).withColumns(order)
            for c, paths in groups.items()
        ],
    )
