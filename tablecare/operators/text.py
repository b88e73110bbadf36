"""Trim, combine and split text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.functions.columns import (
    append_columns,
    col,
    dtype_of,
    replace_columns,
    visible,
)
from tablecare.functions.text import (
    as_text,
    piece_count,
    pieces,
    split_ready,
    trim_collapse as trim_collapse_text,
)
from tablecare.session import configured

MAX_WIDTH = 1000
_PIECES = "__pieces__"


def _text(df: DataFrame, column: str) -> Column:
    return as_text(col(column), dtype_of(df, column))


@configured
def trim_collapse(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strip edges and collapse white space runs; listed columns become text."""
    return replace_columns(df, {c: trim_collapse_text(_text(df, c)) for c in columns})


@configured
def combine_columns(
    df: DataFrame, columns: Sequence[str], new_name: str, separator: str = " "
) -> DataFrame:
    """Append ``new_name``: the listed columns joined in order, nulls skipped."""
    joined = F.concat_ws(separator, *[_text(df, c) for c in columns])
    return append_columns(df, visible(df), [joined.alias(new_name)])


def piece_names(column: str, width: int) -> list[str]:
    return [f"{column}_{i}" for i in range(1, width + 1)]


@configured
def split_width(
    df: DataFrame, column: str, delimiter: str = "", trimmed: bool = False
) -> int:
    """Pieces of the longest split, at least 1: one small aggregate job."""
    ready = split_ready(_text(df, column), delimiter, trimmed)
    return df.agg(F.max(piece_count(ready, delimiter))).first()[0] or 1


@configured
def split_column(
    df: DataFrame,
    column: str,
    delimiter: str = "",
    width: int | None = None,
    max_width: int = MAX_WIDTH,
    trimmed: bool = False,
) -> DataFrame:
    """Replace ``column`` by pieces ``{column}_1..k`` at the end of the table.

    A blank delimiter splits on white space runs, any other on exactly these
    characters. Without ``width`` the data is scanned once for the longest
    split. With ``width``, a longer split fails the job instead of losing text.
    ``max_width`` bounds the columns made. ``trimmed`` says that ``trim_collapse`` has been applied to the column already.
    """
    given = width is not None
    if width is None:
        width = split_width(df, column, delimiter, trimmed)
    if width > max_width:
        raise ValueError(
            f"splitting {column!r} needs {width} columns, more than max_width={max_width}"
        )
    keep = [c for c in visible(df) if c != column]
    names = piece_names(column, width)
    clash = sorted(set(names) & set(keep))
    if clash:
        raise ValueError(f"split pieces already exist as columns: {clash}")
    parts = pieces(split_ready(_text(df, column), delimiter, trimmed), delimiter)
    if given:
        too_long = F.raise_error(
            F.concat(
                F.lit(f"column {column!r} splits into more than {width} pieces: "),
                F.size(parts).cast("string"),
            )
        )
        parts = F.when(F.size(parts) > width, too_long).otherwise(parts)
    # the array in a projection of its own: built once for all its pieces
    split = append_columns(df, keep, [parts.alias(_PIECES)])
    return append_columns(
        split, keep, [F.get(_PIECES, F.lit(i)).alias(n) for i, n in enumerate(names)]
    )
