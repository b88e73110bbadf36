"""Column naming and the hidden row-order column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Position of a row in its source, attached by the file sources on request.
# Never visible to recipes, profiles or sinks.
ROW_ORDER = "__row_order__"


def col(name: str) -> Column:
    """The column called exactly ``name``, whatever characters it contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def visible(df: DataFrame) -> list[str]:
    """All column names a user sees, in table order."""
    return [c for c in df.columns if c != ROW_ORDER]


def hidden(df: DataFrame) -> list[str]:
    return [ROW_ORDER] if ROW_ORDER in df.columns else []


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def replace_columns(df: DataFrame, exprs: dict[str, Column]) -> DataFrame:
    """Swap columns in place: one projection, order of columns unchanged."""
    return df.select(
        *[exprs[c].alias(c) if c in exprs else col(c) for c in df.columns]
    )


def append_columns(
    df: DataFrame, keep: Iterable[str], new: list[Column]
) -> DataFrame:
    """``keep`` in order, then ``new``, then the hidden order column."""
    return df.select(*[col(c) for c in keep], *new, *[col(c) for c in hidden(df)])
