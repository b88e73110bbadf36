"""Deduplicate rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablecare.functions.columns import ROW_ORDER, col, dtype_of, hidden, visible
from tablecare.session import configured

KEEP_CHOICES = ("first", "last")
_RANK = "__rank__"


def _order_columns(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    if order_by:
        # ties are broken by the other columns, so that the choice is repeatable
        others = [c for c in visible(df) if c not in order_by]
        comparable = [c for c in others if not _holds_map(dtype_of(df, c))]
        return [col(c) for c in [*order_by, *comparable]]
    if not hidden(df):
        raise ValueError(
            "rows of a DataFrame have no order: pass order_by, ending in a unique "
            "column, or read the table with row order"
        )
    # compared field by field, which keeps the sort inside generated code
    fields = df.schema[ROW_ORDER].dataType.fieldNames()
    return [F.col(f"{ROW_ORDER}.{f}") for f in fields]


def _holds_map(kind: T.DataType) -> bool:
    return "map<" in kind.simpleString() or kind.simpleString() == "variant"


@configured
def dedup_rows(
    df: DataFrame,
    columns: Sequence[str] = (),
    keep: str = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per key; no columns means the whole row is the key.

    Null keys are equal to each other. ``first`` and ``last`` follow ``order_by``
    if given (ties: the other columns), else the source order the table was read with.
    """
    if keep not in KEEP_CHOICES:
        raise ValueError(f"keep must be one of {KEEP_CHOICES}, not {keep!r}")
    names = visible(df)
    keys = list(dict.fromkeys(columns)) or names
    _check_keys(df, keys)
    if set(keys) == set(names):
        return _distinct_rows(df, names, keep)
    order = _order_columns(df, order_by)
    if keep == "last":
        order = [c.desc() for c in order]
    # Spark keeps only the leading row of each key per task before the shuffle,
    # so a key with a third of all rows sends one row per task.
    leading = Window.partitionBy(*[col(k) for k in keys]).orderBy(*order)
    return (
        df.withColumn(_RANK, F.row_number().over(leading))
        .where(F.col(_RANK) == 1)
        .drop(_RANK)
    )


def _distinct_rows(df: DataFrame, names: list[str], keep: str) -> DataFrame:
    """Copies of whole rows cannot be told apart, so no order is needed."""
    if not hidden(df):
        return df.dropDuplicates()
    pick = F.min if keep == "first" else F.max
    grouped = df.groupBy(*[col(c) for c in names])
    return grouped.agg(pick(ROW_ORDER).alias(ROW_ORDER))


def _check_keys(df: DataFrame, keys: Sequence[str]) -> None:
    maps = [k for k in keys if isinstance(dtype_of(df, k), T.MapType)]
    if maps:
        raise ValueError(f"map columns cannot be compared: {maps}")
