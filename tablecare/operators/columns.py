"""Remove and rename columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablecare.functions.columns import col
from tablecare.session import configured


@configured
def remove_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns; they leave the scan as well."""
    gone = set(columns)
    return df.select(*[col(c) for c in df.columns if c not in gone])


@configured
def rename_single(df: DataFrame, column: str, new_name: str) -> DataFrame:
    """Rename one column where it stands."""
    return df.select(
        *[col(c).alias(new_name) if c == column else col(c) for c in df.columns]
    )
