"""A1 and A2: one row per column with its type, nulls and date likelihood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablecare.functions.columns import ROW_ORDER, col, dtype_of, hidden, visible
from tablecare.functions.dates import with_datetime
from tablecare.session import configured

# Fixed values of the date-candidate rule.
DATE_MIN_VALUES = 3
DATE_MIN_RATIO = 0.5

# Fixed type classes, by Spark type.
_TYPE_CLASSES = (
    ((T.TimestampType, T.TimestampNTZType), "dt"),
    ((T.DateType,), "day"),
    ((T.StringType,), "str"),
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "int"),
    ((T.FloatType, T.DoubleType, T.DecimalType), "dec"),
    ((T.BooleanType,), "t/f"),
)

PROFILE_SCHEMA = (
    "column_name string, type_class string, null_count bigint, date_candidate boolean"
)


def type_class(dtype: T.DataType) -> str:
    for types, name in _TYPE_CLASSES:
        if isinstance(dtype, types):
            return name
    return "oth"


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(dtype_of(df, name), T.StringType)


def _filled(text: Column) -> Column:
    # at least one character that is not white space
    return text.rlike(r"(?U)\S")


def _judged(df: DataFrame) -> DataFrame:
    """Whether ``text`` is filled, and its date if it is one, in its place."""
    filled = df.withColumn("filled", _filled(F.col("text")))
    # blanks become null, which passes through date parsing without any work
    return with_datetime(
        filled.withColumn("text", F.when(F.col("filled"), F.col("text"))), "text"
    )


def _date_flag() -> Column:
    """Whether enough of the filled values in a group are dates."""
    values, dates = F.count_if("filled"), F.count("text")
    return (values >= DATE_MIN_VALUES) & (dates / values >= DATE_MIN_RATIO)


@configured
def profile(
    df: DataFrame, date_sample: int | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """Type class, null count and date flag of every column, in table order.

    The table is read once: text cells, and the nulls of other columns, are counted
    by column before anything is shuffled.
    By default dates are judged on all values. With ``date_sample`` only the
    first so many filled values of each text column count, in ``order_by`` or
    source order.
    """
    spark, names = df.sparkSession, visible(df)
    if not names:
        return spark.createDataFrame([], PROFILE_SCHEMA)
    text = [n for n in names if _is_text(df, n)]
    judged = text if date_sample is None else []
    others = [n for n in names if n not in judged]
    cells = F.array(*[col(n) for n in judged]).cast("array<string>")
    if others:
        # null stays null, anything else becomes a blank, which counts nowhere; rows
        # without any null among these columns add no cells for them
        marks = [F.when(col(n).isNotNull(), F.lit("")) for n in others]
        some_null = F.concat(*marks).isNull()
        none = F.array().cast("array<string>")
        cells = F.concat(cells, F.when(some_null, F.array(*marks)).otherwise(none))
    # one row of blanks, so that columns without cells are there as well
    blanks = spark.range(1).select(F.array_repeat(F.lit(""), len(names)).alias("c"))
    cell = F.posexplode("c").alias("place", "text")
    found = (
        _judged(df.select(cells.alias("c")).union(blanks).select(cell))
        .groupBy("place")
        .agg(
            # a null cell is neither filled nor blank
            F.count_if(F.col("filled").isNull()).alias("null_count"),
            _date_flag().alias("date_candidate"),
        )
    )
    described = F.array(
        *[
            F.struct(
                F.lit(names.index(n)).alias("position"),
                F.lit(n).alias("column_name"),
                F.lit(type_class(dtype_of(df, n))).alias("type_class"),
            )
            for n in [*judged, *others]
        ]
    )
    result = found.withColumn("is", F.get(described, F.col("place"))).select(
        "is.*", "null_count", "date_candidate"
    )
    if date_sample is not None and text:
        flags = _sampled_flags(df, text, date_sample, order_by)
        result = result.drop("date_candidate").join(flags, "column_name", "left")
    # as many rows as the table has columns
    return (
        result.coalesce(1)
        .sortWithinPartitions("position")
        .select(
            "column_name",
            "type_class",
            "null_count",
            F.coalesce("date_candidate", F.lit(False)).alias("date_candidate"),
        )
    )


def _sampled_flags(
    df: DataFrame, text: list[str], sample: int, order_by: Sequence[str]
) -> DataFrame:
    """The table is read once; each task passes on its first cells of a column only."""
    if not order_by and not hidden(df):
        raise ValueError("a sample of the first values needs order_by or row order")
    order = [col(c) for c in order_by] or [F.col(ROW_ORDER)]
    keys = [key.alias(f"key{i}") for i, key in enumerate(order)]
    cell = F.posexplode(F.array(*[col(n) for n in text])).alias("place", "text")
    cells = df.select(cell, *keys).where(_filled(F.col("text")))
    in_order = Window.partitionBy("place").orderBy(*[f"key{i}" for i in range(len(order))])
    ranked = cells.withColumn("rank", F.row_number().over(in_order))
    leading = ranked.where(F.col("rank") <= sample).select("place", "text")
    flags = _judged(leading).groupBy("place").agg(_date_flag().alias("date_candidate"))
    names = F.array(*[F.lit(n) for n in text])
    return flags.select(
        F.get(names, F.col("place")).alias("column_name"), "date_candidate"
    )
