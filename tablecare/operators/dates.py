"""Messy dates to real datetimes and dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablecare.functions.columns import col, replace_columns
from tablecare.functions.dates import with_datetime
from tablecare.session import configured


@configured
def date_normalize(
    df: DataFrame,
    column: str,
    day_first: bool = False,
    formats: Sequence[str] = (),
    trimmed: bool = False,
) -> DataFrame:
    """Replace ``column`` by its UTC datetime in milliseconds; unreadable is null."""
    return with_datetime(df, column, day_first, formats, trimmed)


@configured
def date_only(
    df: DataFrame,
    column: str,
    day_first: bool = False,
    formats: Sequence[str] = (),
    trimmed: bool = False,
) -> DataFrame:
    """Replace ``column`` by its UTC calendar date; unreadable is null."""
    parsed = with_datetime(df, column, day_first, formats, trimmed)
    return replace_columns(parsed, {column: col(column).cast("date")})
