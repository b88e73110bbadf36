"""Column types of text tables, decided from the leading rows.

Types come from the first 10,000 rows. A later value that does not fit turns
**every** column into text (``fallback="file"``) or only its own
(``fallback="column"``).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.functions.columns import col, visible

TYPING_ROWS = 10_000  # fixed size of the typing window
LATE_VALUE = "LATE_VALUE"

# Literals that count as a number or boolean. A bare cast would also take
# ' 12 ', '12d', or '1' as boolean.
_LONG = r"^-?\d+$"
_SHORT_LONG = r"^-?\d{1,18}$"  # in range whatever its digits are
_DOUBLE = r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$|^[-+]?(?:inf|NaN)$"
_BOOLEAN = r"^(?i:true|false)$"

# One bit per kind of value, and the column type for a set of kinds.
_WHOLE, _FRACTION, _TRUTH, _OTHER = 1, 2, 4, 8
_COLUMN_TYPES = {
    _WHOLE: "bigint",
    _FRACTION: "double",
    _WHOLE | _FRACTION: "double",
    _TRUTH: "boolean",
}

# Up to here a guard names each column, beyond it loops over arrays of columns.
_FEW_COLUMNS = 16


def _fits(c: Column, type_name: str) -> Column:
    if type_name == "bigint":
        long = c.rlike(_LONG) & c.try_cast("bigint").isNotNull()
        return c.rlike(_SHORT_LONG) | long
    if type_name == "double":
        return c.rlike(_DOUBLE)
    if type_name == "boolean":
        return c.rlike(_BOOLEAN)
    return c.try_cast(type_name).isNotNull()


def _cells(rows: DataFrame, names: list[str]) -> DataFrame:
    """``position, text`` of every filled cell: expressions over it stay as small
    for a thousand columns as for one."""
    array = F.array(*[col(n) for n in names])
    cells = rows.select(F.posexplode(array).alias("position", "text"))
    return cells.where(F.col("text").isNotNull())


def infer_types(rows: DataFrame) -> dict[str, str]:
    """Type name per column that is not text, from an all-text table."""
    names, text = visible(rows), F.col("text")
    kind = (
        F.when(_fits(text, "bigint"), _WHOLE)
        .when(_fits(text, "double"), _FRACTION)
        .when(_fits(text, "boolean"), _TRUTH)
        .otherwise(_OTHER)
    )
    found = _cells(rows, names).groupBy("position").agg(F.bit_or(kind).alias("kinds"))
    return {
        names[row["position"]]: _COLUMN_TYPES[row["kinds"]]
        for row in found.orderBy("position").collect()  # one row per column
        if row["kinds"] in _COLUMN_TYPES
    }


def late_columns(rows: DataFrame, types: dict[str, str]) -> list[str]:
    """Typed columns with a misfit anywhere, from one pass over all rows."""
    if not types:
        return []
    names, text = list(types), F.col("text")
    wanted = F.get(F.array(*[F.lit(t) for t in types.values()]), F.col("position"))
    fits = F
    for type_name in set(types.values()):
        fits = fits.when(F.col("type") == type_name, _fits(text, type_name))
    misfits = _cells(rows, names).withColumn("type", wanted).where(~fits)
    found = misfits.select("position").distinct().orderBy("position").collect()
    return [names[row["position"]] for row in found]


def apply_types(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    return rows.select(
        *[
            col(c).try_cast(types[c]).alias(c) if c in types else col(c)
            for c in rows.columns
        ]
    )


def _misfit(type_name: str) -> Callable[[Column], Column]:
    return lambda c: c.isNotNull() & ~_fits(c, type_name)


def _any_misfit(types: dict[str, str]) -> Column:
    if len(types) <= _FEW_COLUMNS:
        misfits = [_misfit(t)(col(n)) for n, t in types.items()]
    else:
        by_type: dict[str, list[Column]] = {}
        for name, type_name in types.items():
            by_type.setdefault(type_name, []).append(col(name))
        misfits = [F.exists(F.array(*cs), _misfit(t)) for t, cs in by_type.items()]
    return reduce(Column.__or__, misfits)


def fail_on_late(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Make the job itself fail on a misfit, so that no extra pass is needed."""
    if not types:
        return rows
    error = F.raise_error(F.lit(f"{LATE_VALUE}: a value is not of the type of its column"))
    return rows.where(F.when(_any_misfit(types), error).otherwise(F.lit(True)))
