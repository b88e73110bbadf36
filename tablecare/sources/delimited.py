"""Comma and tab separated text, over files, globs and trees."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader

from tablecare.functions.columns import ROW_ORDER, col
from tablecare.functions.text import count_outside_quotes
from tablecare.sources.charset import allow_charset, is_wide
from tablecare.sources.files import (
    Paths,
    as_list,
    list_files,
    literal_path,
    split_bytes,
    text_order,
)
from tablecare.sources.records import (
    Beginnings,
    cells,
    first_record,
    may_split,
    split_beginnings,
    text_lines,
    text_records,
)
from tablecare.sources.typing import (
    TYPING_ROWS,
    apply_types,
    fail_on_late,
    infer_types,
    late_columns,
)

_CORRUPT = "__corrupt__"

LATE_CHOICES = ("scan", "fail")
FALLBACK_CHOICES = ("file", "column")


def text_options(separator: str, multiline: bool) -> dict[str, str]:
    """How delimited text is written, for batch and stream readers."""
    return {
        "sep": separator,
        "quote": '"',
        "escape": '"',
        # a sentinel that never occurs, so that quoted "" stays an empty string
        "nullValue": "\u0000",
        "multiLine": str(multiline).lower(),
    }


def _reader(
    spark: SparkSession,
    separator: str,
    multiline: bool,
    encoding: str | None,
    recursive: bool,
) -> DataFrameReader:
    reader = spark.read.options(**text_options(separator, multiline))
    if encoding:
        reader = reader.option("encoding", encoding)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader


@dataclass(frozen=True)
class Header:
    """Column names, and whether they are exactly what the header line says."""

    names: list[str]
    exact: bool


def _header(
    spark: SparkSession, files: DataFrame, separator: str, encoding: str | None
) -> tuple[Header, list[str]]:
    """Names from the first file, and what its header says; empty and repeated names get
    names of their own."""
    file = files.where("length > 0").orderBy("path").first()
    if file is None:
        raise ValueError("no header line found: there is no file with content")
    path = literal_path(file["path"])
    if is_wide(encoding):
        found = _reader(spark, separator, True, encoding, False).csv(path).first()
    else:
        record = first_record(text_lines(spark, [path], encoding, False), separator)
        found = record and cells(record, separator)
    if not found:
        raise ValueError(f"no header line found in {file['path']}")
    names: list[str] = []
    for i, cell in enumerate(found, start=1):
        name = base = cell or f"unnamed_{i}"
        copies = 0
        while name in names:
            name, copies = f"{base}_duplicated_{copies}", copies + 1
        names.append(name)
    return Header(names, exact=names == list(found)), list(found)


def record_rows(records: DataFrame, names: list[str], separator: str) -> DataFrame:
    """All-text rows of records. A row with more fields than the header fails the job, a
    shorter one is padded with null. A blank line is a null where there is one column and
    no row where there are more."""
    single = len(names) == 1
    if not single:
        records = records.where("value != ''")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _CORRUPT])
    options = text_options(separator, True) | {"columnNameOfCorruptRecord": _CORRUPT}
    surplus = count_outside_quotes(F.col("value"), separator) >= len(names)
    parsed = records.select(
        F.from_csv("value", schema, options).alias("_row"),
        # quotes that are characters like any other make the quick count an upper bound
        F.when(F.contains("value", F.lit(separator)), surplus).otherwise(F.lit(False)).alias("_many"),
        "value",
        # keeps the filter below from being pushed under the parser, which would run twice
        F.monotonically_increasing_id().alias("_at"),
        *[c for c in records.columns if c != "value"],
    )
    corrupt = F.col("_row")[_CORRUPT]
    error = F.raise_error(
        F.concat(
            F.lit(f"a row has more than {len(names)} fields; its first field is: "),
            F.coalesce(F.col("_row")[names[0]], F.lit("")),
        )
    )
    fits = F.when(corrupt.isNotNull() & F.col("_many"), error).otherwise(F.col("_at") >= 0)
    checked = parsed.where(fits)
    blank = F.col("value") == ""
    return checked.select(
        *[
            (F.when(~blank, F.col("_row")[n]) if single else F.col("_row")[n]).alias(n)
            for n in names
        ],
        *[col(c) for c in records.columns if c != "value"],
    )


def text_rows(
    reader: DataFrameReader | DataStreamReader,
    path: str | list[str],
    header: Header,
    separator: str,
    row_order: bool = False,
) -> DataFrame:
    """All-text rows; a row with more fields than the header fails the job."""
    names = header.names
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in [*names, _CORRUPT])
    rows = (
        reader.option("header", "true")
        # headers of all files must agree; never map columns by position alone
        .option("enforceSchema", str(not header.exact).lower())
        # a row's surplus fields must be seen whichever columns are used
        .option("columnPruning", "false")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .schema(schema)
        .csv(path)
    )
    if row_order:
        rows = rows.withColumn(ROW_ORDER, text_order())
    # short rows land in the corrupt column as well; they are padded with null
    surplus = count_outside_quotes(F.col(_CORRUPT), separator) >= len(names)
    error = F.raise_error(
        F.concat(
            F.lit(f"a row has more than {len(names)} fields; its first field is: "),
            F.coalesce(col(names[0]), F.lit("")),
        )
    )
    return rows.where(F.when(surplus, error).otherwise(F.lit(True))).drop(_CORRUPT)


def _window(
    spark: SparkSession, files: DataFrame, rows_of, splittable: bool, limit: int
) -> DataFrame:
    """The leading rows in path order, read from the leading files only."""
    there, wanted = files.count(), 1
    while True:
        leading = files.orderBy("path").limit(wanted).collect()
        chosen = [literal_path(file["path"]) for file in leading]
        size = sum(file["length"] for file in leading)
        rows = rows_of(chosen, max((file["length"] for file in leading), default=0))
        # more files only while those so far do not fill the window
        if len(chosen) >= there or rows.limit(limit).count() >= limit:
            break
        wanted *= 8
    if len(chosen) > 1:
        return rows.orderBy(ROW_ORDER).limit(limit).drop(ROW_ORDER)
    if not splittable or size <= split_bytes(spark):
        return rows.limit(limit).drop(ROW_ORDER)
    # one file in many splits: ``take`` reads from the first one on and stops
    # when it has enough, where ``limit`` would read some of every split
    taken = rows.drop(ROW_ORDER).take(limit)
    return spark.createDataFrame(taken, rows.drop(ROW_ORDER).schema)


def read_delimited(
    spark: SparkSession,
    path: Paths,
    separator: str,
    row_order: bool = False,
    types: str | dict[str, str] = "infer",
    late: str = "scan",
    fallback: str = "file",
    multiline: bool | None = None,
    encoding: str | None = None,
    charsets: dict[str, list[str]] | None = None,
    recursive: bool = False,
    typing_rows: int = TYPING_ROWS,
) -> DataFrame:
    """Read delimited text with a header line.

    ``types`` is ``"infer"``, ``"string"`` or a type name per column.
    ``late`` says how values that contradict inferred types are found: ``"scan"``
    looks at all rows first, ``"fail"`` lets the job that reads them fail.
    Quotes may hold line breaks, and files are split all the same: where files are large
    enough for that, one pass over the lines finds the splits that begin inside quotes.
    ``multiline=False`` spares it and takes each line for a record. The headers of all files
    have to be the same. ``charsets`` maps a charset to the paths
    written in it (see ``sources.charset``) and replaces ``path``/``encoding``.
    """
    if late not in LATE_CHOICES or fallback not in FALLBACK_CHOICES:
        raise ValueError(f"late is one of {LATE_CHOICES}, fallback of {FALLBACK_CHOICES}")
    groups = charsets or {encoding: as_list(path)}
    for charset in groups:
        allow_charset(spark, charset)
    lead_charset = next(iter(groups))
    # listed once, for all that is asked about the files
    files = {c: list_files(spark, p, recursive) for c, p in groups.items()}
    header, said = _header(spark, files[lead_charset], separator, lead_charset)
    beginnings: dict[str | None, Beginnings] = {}

    def find_beginnings() -> None:
        for charset, paths in groups.items():
            largest = files[charset].agg(F.max("length")).first()[0] or 0
            if not is_wide(charset) and may_split(spark, largest):
                lines = text_lines(spark, paths, charset, recursive)
                beginnings[charset] = split_beginnings(lines, separator)

    def rows_of(charset, paths, deep, order, known=None):
        if is_wide(charset):
            reader = _reader(spark, separator, True, charset, deep)
            return text_rows(reader, paths, header, separator, order)
        lines = text_lines(spark, paths, charset, deep)
        records = text_records(lines, separator, said, multiline is not False, known, order)
        return record_rows(records, header.names, separator)

    def all_rows() -> DataFrame:
        return reduce(
            DataFrame.unionByName,
            [
                rows_of(c, paths, recursive, row_order, beginnings.get(c))
                for c, paths in groups.items()
            ],
        )

    if multiline is not False:
        find_beginnings()
    if types == "string":
        return all_rows()
    if isinstance(types, dict):
        return apply_types(fail_on_late(all_rows(), types), types)

    def leading(paths: list[str], largest: int) -> DataFrame:
        """The rows of some files; of split ones those in front, if they are enough."""
        if is_wide(lead_charset) or multiline is False or not may_split(spark, largest):
            return rows_of(lead_charset, paths, False, True)
        lines = text_lines(spark, paths, lead_charset, False)
        first = text_records(lines.where("block = 0"), separator, said, row_order=True, cut=True)
        rows = record_rows(first, header.names, separator)
        if rows.limit(typing_rows).count() >= typing_rows:
            return rows
        known = split_beginnings(lines, separator)
        return rows_of(lead_charset, paths, False, True, known)

    splittable = not is_wide(lead_charset)
    window = _window(spark, files[lead_charset], leading, splittable, typing_rows)
    inferred = infer_types(window)
    rows = all_rows()
    if late == "fail":
        return apply_types(fail_on_late(rows, inferred), inferred)
    misfits = late_columns(rows, inferred)
    if misfits and fallback == "file":
        inferred = {}
    for name in misfits:
        inferred.pop(name, None)
    return apply_types(rows, inferred)
