"""Dates and datetimes out of messy text, with built-in expressions only.

A value is first cleaned, then rewritten to ``y-M-d[ time]`` by the first shape
that fits, then cast. Only fully matched shapes reach the cast: unguarded, Spark
would read ``12:30`` or ``now`` as the current day and ``12345`` as a year.

Shapes, in order (``time`` is optional everywhere):

* ``2022-03-22``, ``2022/3/22``, ``2022.03.22``; ``T``, space or comma, time
* ``2022-Mar-22``
* ``20220322`` and ``20220322T101559``
* ``Mar 1, 2019``, ``March 1st 2019``, ``Sept. 5 2021``
* ``1 Mar 2019``, ``1-Mar-2019``, ``1st of March, 2019``
* ``3/22/2022``, ``3-22-2022``, ``3.22.2022``: month first unless
  ``day_first``; the other order is used where the preferred one cannot be

A leading weekday name is dropped. Times are 24 hour or am/pm, with optional
seconds and fraction, and an optional zone (``Z``, ``UTC``, ``GMT``, ``+02:00``);
without a zone they are UTC. Two-digit years are not guessed: they give null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare.functions.columns import col, dtype_of, replace_columns
from tablecare.functions.text import as_text, trim_collapse

_TEXT = "__text__"

_MONTH_NAMES = (
    r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?"
    r"|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
# a full month name or its abbreviation, of which the first letters are caught
_MONTH = rf"(?={_MONTH_NAMES}(?![a-z]))([a-z]{{3}})[a-z]*\.?"
# (position + 2) / 3 is the month number
_MONTH_LETTERS = "janfebmaraprmayjunjulaugsepoctnovdec"
_WEEKDAY_LETTERS = "montuewedthufrisatsun"

_WEEKDAY = (
    r"(?i)^(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?[.,]? "
)
_ZONE = r"(?:z|utc|gmt|[+-]\d{1,2}(?::?\d{2})?)"
_TIME = (
    r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?"
    rf"(?: ?[ap]\.?m\.?(?: ?(?:z|utc|gmt))?| ?{_ZONE})?"
)
_REST = rf"(?:(?:t|,? (?:at )?)({_TIME}))?$"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"

# One pattern per shape, with the replacement that reorders it to `y-M-d time`.
# A reordered text matches none of the other patterns any more.
_YMD = (rf"(?i)^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){_REST}", "$1-$3-$4 $5")
_COMPACT = (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
_COMPACT_TIME = (
    r"(?i)^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})z?$",
    "$1-$2-$3 $4:$5:$6",
)
_MDY = (rf"(?i)^(0?[1-9]|1[0-2])([-/.])(\d{{1,2}})\2(\d{{4}}){_REST}", "$4-$1-$3 $5")
_DMY = (rf"(?i)^(\d{{1,2}})([-/.])(0?[1-9]|1[0-2])\2(\d{{4}}){_REST}", "$4-$3-$1 $5")
_MONTH_DAY = (rf"(?i)^{_MONTH}[ -]?{_DAY}(?:, ?| |-)(\d{{4}}){_REST}", "$3-$1-$2 $4")
_DAY_MONTH = (
    rf"(?i)^{_DAY}(?: of)?[ -]?{_MONTH}(?:, ?| |-)(\d{{4}}){_REST}",
    "$3-$2-$1 $4",
)

# No shape has more than ten words, however much white space is between them.
_FEW_WORDS = r"(?U)^\s*+(?:\S++\s++){0,10}+\S*+$"

_HALF_DAY = r"(?i) ?([ap])\.?m\.?(?: ?(?:z|utc|gmt))?$"
_HALF_DAY_FORMAT = "y-M-d h:mm[:ss][.SSSSSSSSS] a"


def _starts(letters: str) -> list[str]:
    return [letters[i : i + 3] for i in range(0, len(letters), 3)]


def _rewrite(text: Column, *shapes: tuple[str, str]) -> Column:
    for pattern, order in shapes:
        text = F.regexp_replace(text, pattern, order)
    return text


def _spread(cleaned: Column, day_first: bool) -> Column:
    """``y-M-d[ time]`` or ``y-Mon-d[ time]`` of the shape that fits.

    Cheap tests pick the one or two shapes that are possible; text that fits
    none of them stays as it is and is refused by ``_cast``.
    """
    numeric = (_DMY, _MDY) if day_first else (_MDY, _DMY)
    start = F.lower(F.substring(cleaned, 1, 3))
    fifth = F.substring(cleaned, 5, 1)
    word = ~F.ascii(cleaned).between(ord("0"), ord("9"))
    named = F.when(
        start.isin(*_starts(_MONTH_LETTERS)), _rewrite(cleaned, _MONTH_DAY)
    ).when(
        start.isin(*_starts(_WEEKDAY_LETTERS)),
        _rewrite(cleaned, (_WEEKDAY, ""), _MONTH_DAY, _DAY_MONTH),
    )
    iso = cleaned.rlike(r"^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d|$)")
    return (
        F.when(word, named)
        .when((fifth == "-") & iso, cleaned)
        .when(
            fifth.isin("-", "/", ".") & cleaned.rlike(r"^\d{4}"),
            _rewrite(cleaned, _YMD),
        )
        .when(cleaned.rlike(r"^\d{1,2}[-/.]\d"), _rewrite(cleaned, *numeric))
        .when(cleaned.rlike(r"^\d{8}"), _rewrite(cleaned, _COMPACT, _COMPACT_TIME))
        .otherwise(_rewrite(cleaned, _DAY_MONTH))
    )


def _canonical(spread: Column) -> Column:
    """``2019-Mar-1`` to ``2019-3-1``; everything else as it is."""
    position = F.instr(F.lit(_MONTH_LETTERS), F.lower(F.substring(spread, 6, 3)))
    # null, and so no date, unless the letters are those of one month
    number = F.when(position % 3 == 1, ((position + 2) / 3).cast("int").cast("string"))
    swapped = F.concat(F.left(spread, F.lit(5)), number, F.substr(spread, F.lit(9)))
    letter = F.substring(spread, 6, 1) >= "A"
    return F.when(letter, swapped).otherwise(spread)


def _cast(canonical: Column) -> Column:
    """Timestamp of ``y-M-d[ time[zone]]`` text; anything else is null."""
    half_day = F.try_to_timestamp(
        F.upper(F.regexp_replace(canonical, _HALF_DAY, " $1m")),
        F.lit(_HALF_DAY_FORMAT),
    )
    # the cast wants seconds before a zone, and minutes in an offset
    zoned = _rewrite(
        canonical,
        (r"(?i) ?(?:z|utc|gmt)$", "Z"),
        (r"([ T]\d{1,2}:\d{2}) ?(Z|[+-][\d:]+)$", "$1:00$2"),
        (r"([+-]\d{1,2})$", "$1:00"),
    )
    date = r"^\d{4}-\d{1,2}-\d{1,2}"
    return (
        F.when(
            canonical.rlike(rf"{date}(?:[T ](?:\d{{1,2}}:\d{{2}}[\d:.]*)?)?$"),
            canonical.try_cast("timestamp"),
        )
        .when(canonical.rlike(rf"(?i){date}[T ].*m\.?(?: ?(?:z|utc|gmt))?$"), half_day)
        .when(
            canonical.rlike(rf"(?i){date}[T ][\d:.]+ ?{_ZONE}$"),
            zoned.try_cast("timestamp"),
        )
    )


def _brief(text: Column) -> Column:
    """Prose is turned away after its first words instead of being cleaned whole."""
    return F.when((F.octet_length(text) <= 64) | text.rlike(_FEW_WORDS), text)


def _milliseconds(moment: Column) -> Column:
    """Datetime without zone, rounded down to milliseconds also before 1970."""
    return F.timestamp_millis(F.unix_millis(moment)).cast("timestamp_ntz")


def with_datetime(
    df: DataFrame,
    column: str,
    day_first: bool = False,
    formats: Sequence[str] = (),
    trimmed: bool = False,
) -> DataFrame:
    """Replace a column of any type by its UTC datetime, cut to milliseconds.

    ``formats`` are extra Spark datetime patterns, tried after the shapes above.
    ``trimmed`` says that ``trim_collapse`` has been applied already. The session
    time zone must be UTC (see ``session.configure``).

    The text passes through several projections. Each uses the one before more
    than once, so Spark keeps them apart and computes each once per row; written
    as one expression, the layers would multiply to a tree of thousands of nodes.
    """
    dtype = dtype_of(df, column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return replace_columns(
            df, {column: _milliseconds(col(column).cast("timestamp"))}
        )
    c = col(column)
    text = as_text(c, dtype)
    if formats:
        df = df.withColumn(_TEXT, text if trimmed else trim_collapse(text))
    others = [F.try_to_timestamp(F.col(_TEXT), F.lit(f)) for f in formats]
    for layer in (
        text if trimmed else trim_collapse(_brief(text)),
        _spread(c, day_first),
        _canonical(c),
        _milliseconds(F.coalesce(_cast(c), *others)),
    ):
        df = replace_columns(df, {column: layer})
    return df.drop(_TEXT)
