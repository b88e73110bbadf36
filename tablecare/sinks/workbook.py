"""Workbook folders: every task writes its rows as ``.xlsx`` files."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import chain, islice
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.columns import col
from tablecare.functions.text import as_text, has_text_form
from tablecare.sinks.publish import publish

# Fixed values of the workbook format.
MAX_SHEET_ROWS = 1_048_576
MAX_CELL_CHARACTERS = 32_767
_UNIX_EPOCH_SERIAL = 25569  # 1970-01-01 in days
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_CONTENT = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'

# Cell styles of this writer: plain, datetime, date.
_STYLES = (
    f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="2">'
    '<numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm:ss.000"/>'
    '<numFmt numFmtId="165" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
    "<fonts><font/></fonts><fills><fill/></fills><borders><border/></borders>"
    '<cellStyleXfs><xf/></cellStyleXfs><cellXfs><xf numFmtId="0"/>'
    '<xf numFmtId="164" applyNumberFormat="1"/>'
    '<xf numFmtId="165" applyNumberFormat="1"/></cellXfs></styleSheet>'
)
_DATETIME_STYLE, _DATE_STYLE = 1, 2


def _cell_text(c: Column, dtype: T.DataType) -> tuple[Column, str]:
    """A column as the text of its cells, and the kind of these cells."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        days = F.unix_micros(c.cast("timestamp")) / F.lit(86_400_000_000.0)
        return (days + _UNIX_EPOCH_SERIAL).cast("string"), "datetime"
    if isinstance(dtype, T.DateType):
        days = F.date_diff(c, F.lit("1970-01-01").cast("date")) + _UNIX_EPOCH_SERIAL
        return days.cast("string"), "date"
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("string"), "boolean"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        # not-a-number and infinity have no cell value
        finite = ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
        return F.when(finite, c.cast("string")), "number"
    if isinstance(dtype, T.NumericType):
        return c.cast("string"), "number"
    if has_text_form(dtype):
        return as_text(c, dtype), "text"
    if isinstance(dtype, T.BinaryType):
        return F.base64(c), "text"
    return F.to_json(c) if not isinstance(dtype, T.NullType) else c.cast("string"), "text"


def _xml_text(text: str) -> str:
    if len(text) > MAX_CELL_CHARACTERS:
        raise ValueError(f"a cell holds at most {MAX_CELL_CHARACTERS} characters")
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    text = re.sub(
        "[\x00-\x08\x0b-\x1f\ufffe\uffff]", lambda m: f"_x{ord(m.group()):04X}_", text
    )
    return f'<is><t xml:space="preserve">{escape(text)}</t></is>'


def _cell_xml(text: str | None, kind: str) -> str:
    if text is None:
        return "<c/>"
    if kind == "text":
        return f'<c t="inlineStr">{_xml_text(text)}</c>'
    if kind == "boolean":
        return f'<c t="b"><v>{text}</v></c>'
    style = {"datetime": _DATETIME_STYLE, "date": _DATE_STYLE}.get(kind, 0)
    return f'<c s="{style}"><v>{text}</v></c>'


def _row_xml(values, kinds) -> str:
    return f"<row>{''.join(map(_cell_xml, values, kinds))}</row>"


def _workbook(
    names: list[str], kinds: list[str], rows: Iterator[tuple], sheet: str
) -> tuple[bytes, int]:
    """One workbook with the header and frozen first row and column."""
    parts = {
        "[Content_Types].xml": (
            f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types">'
            '<Default Extension="rels" ContentType="application/vnd.openxmlformats-'
            'package.relationships+xml"/>'
            f'<Override PartName="/xl/workbook.xml" ContentType="{_CONTENT}.sheet.main+xml"/>'
            f'<Override PartName="/xl/styles.xml" ContentType="{_CONTENT}.styles+xml"/>'
            '<Override PartName="/xl/worksheets/sheet1.xml" '
            f'ContentType="{_CONTENT}.worksheet+xml"/></Types>'
        ),
        "_rels/.rels": (
            f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship '
            f'Id="r1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/>'
            "</Relationships>"
        ),
        "xl/workbook.xml": (
            f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>'
            f'<sheet name={quoteattr(sheet)} sheetId="1" r:id="r1"/></sheets></workbook>'
        ),
        "xl/_rels/workbook.xml.rels": (
            f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship '
            f'Id="r1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/>'
            f'<Relationship Id="r2" Type="{_OFFICE}/styles" Target="styles.xml"/>'
            "</Relationships>"
        ),
        "xl/styles.xml": _STYLES,
    }
    content = io.BytesIO()
    count = 0
    with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as out:
            pane = '<pane xSplit="1" ySplit="1" topLeftCell="B2" state="frozen"/>'
            views = f'<sheetViews><sheetView workbookViewId="0">{pane}</sheetView></sheetViews>'
            out.write(f'{_HEAD}<worksheet xmlns="{_MAIN}">{views}<sheetData>'.encode())
            out.write(_row_xml(names, ["text"] * len(names)).encode())
            for values in rows:
                out.write(_row_xml(values, kinds).encode())
                count += 1
            out.write(b"</sheetData></worksheet>")
    return content.getvalue(), count


def _save(folder: str, name: str, content: bytes) -> None:
    """Write under a name of this attempt, then move: repeats do no harm."""
    if "://" in folder or folder.startswith("file:"):
        file_system, root = pyarrow.fs.FileSystem.from_uri(folder)
    else:
        file_system, root = pyarrow.fs.LocalFileSystem(), folder
    file_system.create_dir(root, recursive=True)
    context = TaskContext.get()
    attempt = f"{root}/_{name}-{context.taskAttemptId() if context else 'driver'}"
    with file_system.open_output_stream(attempt) as out:
        out.write(content)
    file_system.move(attempt, f"{root}/{name}")


def write_workbooks(
    df: DataFrame,
    path: str,
    overwrite: bool = False,
    single_file: bool = False,
    sheet: str = "data",
    rows_per_file: int = MAX_SHEET_ROWS - 1,
) -> None:
    """Write a folder of workbooks, each with at most ``rows_per_file`` rows.

    Datetimes and dates are real date cells, nested columns become JSON text.
    """
    prepared = {f.name: _cell_text(col(f.name), f.dataType) for f in df.schema}
    names, kinds = list(prepared), [kind for _, kind in prepared.values()]
    table = df.select(*[text.alias(name) for name, (text, _) in prepared.items()])
    if single_file:
        table = table.coalesce(1)

    def save(folder: str):
        def files(batches):
            values = (
                (None if pd.isna(v) else v for v in row)
                for batch in batches
                for row in batch.itertuples(index=False, name=None)
            )
            partition = TaskContext.get().partitionId()
            number = 0
            while (first := next(values, None)) is not None:
                rows = chain([first], islice(values, rows_per_file - 1))
                content, count = _workbook(names, kinds, rows, sheet)
                name = f"part-{partition:05d}-{number:05d}.xlsx"
                _save(folder, name, content)
                number += 1
                yield pd.DataFrame({"name": [name], "rows": [count]})

        return files

    def write(staging: str) -> None:
        written = table.mapInPandas(save(staging), "name string, rows bigint")
        if not written.agg(F.sum("rows")).first()[0]:
            empty, _ = _workbook(names, kinds, iter(()), sheet)
            _save(staging, "part-00000-00000.xlsx", empty)

    # these files have no commit of their own, so the folder is moved as a whole
    publish(df.sparkSession, path, overwrite, write, staged=True)
