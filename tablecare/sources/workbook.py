"""Folders of ``.xlsx`` workbooks, one task per group of files.

A workbook is a zip of XML that cannot be split, and a sheet holds at most
1,048,576 rows, so the unit of work is the file. Rows stream out of the XML in
batches; no sheet is held in memory whole.
"""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.functions.columns import ROW_ORDER
from tablecare.session import scratch_path
from tablecare.sources.files import Paths, as_list

_BATCH_ROWS = 5000

# Fixed values of the workbook format: number formats that mean a date or time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_EPOCH_1900 = datetime.datetime(1899, 12, 30)
_EPOCH_1904 = datetime.datetime(1904, 1, 1)
_FALSE_LEAP_DAY = 60  # the 1900 calendar counts a 29 February that never was

# Kinds of a cell value, and the column type that a set of kinds gives.
_TEXT, _WHOLE, _NUMBER, _BOOLEAN, _DATETIME, _EMPTY = "s", "i", "f", "b", "d", "-"
_COLUMN_TYPES = (
    ({_WHOLE}, "bigint"),
    ({_WHOLE, _NUMBER}, "double"),
    ({_BOOLEAN}, "boolean"),
    ({_DATETIME}, "timestamp_ntz"),
)

Cell = tuple[str, str | None]


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _unescape(text: str) -> str:
    # the format writes characters XML cannot hold as _x0001_
    return re.sub(
        r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m.group(1), 16)), text
    )


def _text_of(element: ElementTree.Element) -> str:
    """Text of a string item without its phonetic hints."""
    parts = []
    for child in element:
        name = _local(child.tag)
        if name == "t":
            parts.append(child.text or "")
        elif name == "r":
            parts += [t.text or "" for t in child if _local(t.tag) == "t"]
    return _unescape("".join(parts))


class Workbook:
    """The parts of one workbook that reading a table needs."""

    def __init__(self, content: bytes):
        self._zip = zipfile.ZipFile(io.BytesIO(content))
        self._names = set(self._zip.namelist())
        root = self._xml("xl/workbook.xml")
        links = {
            link.get("Id"): link.get("Target")
            for link in self._xml("xl/_rels/workbook.xml.rels")
            if link.get("Type", "").endswith("/worksheet")
        }
        self.sheets: dict[str, str] = {}
        self._epoch = _EPOCH_1900
        for element in root.iter():
            if _local(element.tag) == "workbookPr":
                if element.get("date1904") in ("1", "true"):
                    self._epoch = _EPOCH_1904
            elif _local(element.tag) == "sheet":
                link = next(v for k, v in element.items() if _local(k) == "id")
                if link in links:
                    target = links[link]
                    self.sheets[element.get("name")] = (
                        target.lstrip("/") if target.startswith("/") else f"xl/{target}"
                    )
        self._shared = self._shared_strings()
        self._date_styles = self._find_date_styles()

    def _xml(self, name: str) -> ElementTree.Element:
        return ElementTree.fromstring(self._zip.read(name))

    def _shared_strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self._names:
            return []
        root = self._xml("xl/sharedStrings.xml")
        return [_text_of(item) for item in root if _local(item.tag) == "si"]

    def _find_date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self._names:
            return set()
        root = self._xml("xl/styles.xml")
        dates = set(_DATE_FORMATS)
        styles: list[int] = []
        for part in root:
            if _local(part.tag) == "numFmts":
                for fmt in part:
                    # what is quoted, escaped or in brackets is not a field
                    code = re.sub(
                        r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]',
                        "",
                        fmt.get("formatCode", ""),
                    )
                    if re.search(r"[dmyhs]", code, re.IGNORECASE):
                        dates.add(int(fmt.get("numFmtId")))
            elif _local(part.tag) == "cellXfs":
                styles = [int(style.get("numFmtId", "0")) for style in part]
        return {i for i, number in enumerate(styles) if number in dates}

    def _moment(self, serial: float) -> str:
        if self._epoch is _EPOCH_1900 and serial < _FALSE_LEAP_DAY:
            serial += 1
        milliseconds = round(serial * 86_400_000)
        moment = self._epoch + datetime.timedelta(milliseconds=milliseconds)
        return moment.isoformat(timespec="milliseconds")

    def _cell(self, element: ElementTree.Element) -> Cell:
        kind = element.get("t", "n")
        value = None
        for child in element:
            if _local(child.tag) == "is":
                return _TEXT, _text_of(child)
            if _local(child.tag) == "v":
                value = child.text
        if value is None or kind == "e":
            return _EMPTY, None
        if kind == "s":
            return _TEXT, self._shared[int(value)]
        if kind == "str":
            return _TEXT, _unescape(value)
        if kind == "b":
            return _BOOLEAN, "true" if value == "1" else "false"
        if kind == "d":
            return _DATETIME, value.removesuffix("Z")
        if int(element.get("s", "0")) in self._date_styles:
            return _DATETIME, self._moment(float(value))
        if re.fullmatch(r"-?\d{1,18}", value):
            return _WHOLE, str(int(value))
        return _NUMBER, repr(float(value))

    def rows(self, sheet: str) -> Iterator[list[Cell]]:
        """Rows with at least one value; each cell stands at its column."""
        with self._zip.open(self.sheets[sheet]) as stream:
            for _, element in ElementTree.iterparse(stream):
                if _local(element.tag) != "row":
                    continue
                cells: list[Cell] = []
                for child in element:
                    letters = re.match(r"[A-Z]*", child.get("r", "")).group()
                    at = 0
                    for letter in letters:
                        at = at * 26 + ord(letter) - 64
                    at = at - 1 if letters else len(cells)
                    cells += [(_EMPTY, None)] * (at - len(cells))
                    cells.append(self._cell(child))
                element.clear()
                if any(text is not None for _, text in cells):
                    yield cells


def _open(path: str, content: bytes) -> Workbook:
    try:
        return Workbook(content)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as problem:
        raise ValueError(f"{path} is not a readable workbook: {problem}") from problem


def _pick(path: str, book: Workbook, sheet: str | None) -> str:
    if sheet is None and book.sheets:
        return next(iter(book.sheets))
    if sheet not in book.sheets:
        raise ValueError(f"{path} has no sheet {sheet!r}; it has {list(book.sheets)}")
    return sheet


def _header(cells: list[Cell]) -> list[str]:
    names: list[str] = []
    for i, (_, text) in enumerate(cells, start=1):
        name = text if text else f"unnamed_{i}"
        if name in names:
            raise ValueError(f"column name {name!r} occurs twice")
        names.append(name)
    return names


def _files(spark: SparkSession, path: Paths, recursive: bool) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    return reader.load(as_list(path)).select("path", "content")


def list_sheets(spark: SparkSession, path: Paths, recursive: bool = False) -> DataFrame:
    """``path, position, sheet`` of every sheet."""

    def sheets(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                names = list(_open(path, content).sheets)
                yield pd.DataFrame(
                    {"path": path, "position": range(1, len(names) + 1), "sheet": names}
                )

    schema = "path string, position int, sheet string"
    return _files(spark, path, recursive).mapInPandas(sheets, schema)


def _headers(files: DataFrame, sheet: str | None) -> list[str]:
    """All column names of the set; files may lack some or order them anew."""

    def headers(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                book = _open(path, content)
                first = next(book.rows(_pick(path, book, sheet)), [])
                yield pd.DataFrame({"path": [path], "names": [_header(first)]})

    found = files.mapInPandas(headers, "path string, names array<string>")
    # one row per different layout, not per file
    layouts = found.groupBy("names").agg(F.min("path").alias("path")).orderBy("path")
    names = [n for row in layouts.toLocalIterator() for n in row["names"]]
    return list(dict.fromkeys(names))


def _rows(files: DataFrame, sheet: str | None, names: list[str]) -> DataFrame:
    """``path, row, kinds, cells``: cells as text, aligned to ``names``."""

    def aligned(path: str, content: bytes):
        book = _open(path, content)
        rows = book.rows(_pick(path, book, sheet))
        header = _header(next(rows, []))
        at = [header.index(n) if n in header else None for n in names]
        for number, cells in enumerate(rows, start=1):
            padded = cells + [(_EMPTY, None)] * (len(header) - len(cells))
            if len(padded) > len(header):
                raise ValueError(f"{path}: row {number} has more cells than the header")
            picked = [(_EMPTY, None) if i is None else padded[i] for i in at]
            kinds = "".join(kind for kind, _ in picked)
            yield path, number, kinds, [text for _, text in picked]

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = aligned(path, content)
                while chunk := list(islice(rows, _BATCH_ROWS)):
                    yield pd.DataFrame(chunk, columns=["path", "row", "kinds", "cells"])

    schema = "path string, row bigint, kinds string, cells array<string>"
    return files.mapInPandas(parse, schema)


def _infer(rows: DataFrame, names: list[str]) -> dict[str, str]:
    """Types from the kinds of all cells: one aggregate over a short column."""
    kinds = rows.agg(
        *[
            F.collect_set(F.substring("kinds", i, 1)).alias(f"kinds_{i}")
            for i in range(1, len(names) + 1)
        ]
    ).first()
    types = {}
    for name, found in zip(names, kinds):
        filled = set(found) - {_EMPTY}
        for allowed, type_name in _COLUMN_TYPES:
            if filled and filled <= allowed:
                types[name] = type_name
                break
    return types


def read_workbooks(
    spark: SparkSession,
    path: Paths,
    row_order: bool = False,
    sheet: str | None = None,
    types: str | dict[str, str] = "infer",
    recursive: bool = False,
) -> DataFrame:
    """Read the same sheet (by default the first) of every workbook as one table.

    The first filled row names the columns. With inferred types the parsed rows
    are written once to the shared scratch folder, since parsing is by far the
    dearest part, and both the types and the table come from there.
    """
    files = _files(spark, path, recursive)
    names = _headers(files, sheet)
    if not names:
        raise ValueError(f"no workbook with a header row found in {path}")
    rows = _rows(files, sheet, names)
    if types == "infer":
        staged = scratch_path(spark, "workbooks")
        rows.write.parquet(staged)
        rows = spark.read.parquet(staged)
        types = _infer(rows, names)
    elif types == "string":
        types = {}
    columns = [
        F.get("cells", F.lit(i)).cast(types.get(name, "string")).alias(name)
        for i, name in enumerate(names)
    ]
    if row_order:
        columns.append(F.struct("path", "row").alias(ROW_ORDER))
    return rows.select(*columns)
