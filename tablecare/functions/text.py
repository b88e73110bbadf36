"""Text expressions. Everything here is a built-in Spark expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unicode white space: plain \s would miss the no-break space and its kin.
_RUNS = r"(?U)\s+"

# The characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Doubles whose text Spark writes with an exponent although their plain decimal
# form is short: 1e-5 <= |x| < 1e16. decimal(38,22) holds this range exactly.
_PLAIN_DOUBLE = "decimal(38,22)"

_NON_TEXT = (T.ArrayType, T.MapType, T.StructType, T.NullType, T.BinaryType)


def has_text_form(dtype: T.DataType) -> bool:
    """Whether a column of this type has one obvious text form."""
    return not isinstance(dtype, _NON_TEXT)


def as_text(c: Column, dtype: T.DataType) -> Column:
    """Cast to string; doubles from 1e-5 up to 1e16 come out without exponent."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(
            c.cast("string").cast(_PLAIN_DOUBLE).cast("string"), r"(\.\d+?)0+$", "$1"
        )
        size = F.abs(c)
        exponent = ((size >= 1e7) & (size < 1e16)) | ((size >= 1e-5) & (size < 1e-3))
        return F.when(exponent, plain).otherwise(c.cast("string"))
    return c.cast("string")


def iso_seconds(c: Column) -> Column:
    """A datetime as ``yyyy-MM-ddTHH:mm:ss``, truncated, never rounded."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def strip_edges(c: Column) -> Column:
    return F.trim(c, F.lit(WHITE_SPACE))


def trim_collapse(c: Column) -> Column:
    """Strip both edges and turn each run of white space into one space."""
    # collapse first: F.trim removes plain spaces only
    return F.trim(F.regexp_replace(c, _RUNS, " "))


def is_blank_delimiter(delimiter: str) -> bool:
    return delimiter.strip() == ""


def split_ready(text: Column, delimiter: str, trimmed: bool = False) -> Column:
    """Text prepared for splitting: edges always go; blank mode collapses."""
    if is_blank_delimiter(delimiter):
        return F.nullif(text if trimmed else trim_collapse(text), F.lit(""))
    return text if trimmed else strip_edges(text)


def literal_pattern(delimiter: str) -> str:
    """A regex that matches exactly ``delimiter``.

    One character is escaped with a backslash at most, because Java splits on
    such patterns without the regex engine; longer ones are quoted whole.
    """
    if len(delimiter) == 1:
        return "\\" + delimiter if delimiter in ".$|()[{^?*+\\" else delimiter
    return r"\Q" + delimiter.replace(r"\E", r"\E\\E\Q") + r"\E"


def pieces(ready: Column, delimiter: str) -> Column:
    """Array of pieces; trailing empty pieces are kept."""
    exact = " " if is_blank_delimiter(delimiter) else delimiter
    return F.split(ready, literal_pattern(exact), -1)


def piece_count(ready: Column, delimiter: str) -> Column:
    """Number of pieces without building them (null for null)."""
    exact = " " if is_blank_delimiter(delimiter) else delimiter
    gone = F.length(ready) - F.length(F.replace(ready, F.lit(exact), F.lit("")))
    return (gone / F.lit(len(exact))).cast("int") + 1


def count_outside_quotes(record: Column, separator: str) -> Column:
    """Separators of one raw delimited record that are not inside quotes."""
    # a doubled quote ends one quoted part and begins the next
    bare = F.regexp_replace(record, r'"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit("")))
