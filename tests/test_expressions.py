"""Literal vectors for the date and text expressions."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare import combine_columns, date_normalize, date_only, split_column
from tablecare import remove_columns, rename_single, trim_collapse
from tablecare.functions.columns import col
from tablecare.functions.text import (
    WHITE_SPACE,
    as_text,
    count_outside_quotes,
    strip_edges,
)
from tablecare.operators.text import split_width


def values(df, name):
    return [r[0] for r in df.select(col(name)).collect()]


DATES = [
    ("2022-03-22", datetime(2022, 3, 22)),
    ("Mar 1, 2019", datetime(2019, 3, 1)),
    ("Mar 1,2019", datetime(2019, 3, 1)),
    ("March 1st, 2019", datetime(2019, 3, 1)),
    ("garbage", None),
    (None, None),
    ("", None),
    ("   ", None),
    ("2022-03-22T10:15:59.673918", datetime(2022, 3, 22, 10, 15, 59, 673000)),
    ("1969-12-31T23:59:59.9999", datetime(1969, 12, 31, 23, 59, 59, 999000)),
    ("2021-02-13T03:04:00", datetime(2021, 2, 13, 3, 4)),
    ("Sept 5 2021", datetime(2021, 9, 5)),
    ("sept. 5, 2021 3:04 pm", datetime(2021, 9, 5, 15, 4)),
    ("Sept 5 2021 12:00 a.m.", datetime(2021, 9, 5)),
    ("2020/11/15", datetime(2020, 11, 15)),
    ("2020.11.15 9:05", datetime(2020, 11, 15, 9, 5)),
    ("June 30, 2020", datetime(2020, 6, 30)),
    ("MAY 5 2020", datetime(2020, 5, 5)),
    ("5 September 2021", datetime(2021, 9, 5)),
    ("1st of March, 2019", datetime(2019, 3, 1)),
    ("1-Mar-2019", datetime(2019, 3, 1)),
    ("Tuesday, March 1, 2019 10:00:00", datetime(2019, 3, 1, 10)),
    ("Fri, 5 Mar 2021 08:00:00 GMT", datetime(2021, 3, 5, 8)),
    ("  Mar \t 1,   2019 ", datetime(2019, 3, 1)),
    ("2021-01-01T23:30:00-02:00", datetime(2021, 1, 2, 1, 30)),
    ("2021-01-01 23:30 +0200", datetime(2021, 1, 1, 21, 30)),
    ("2021-01-01 23:30+02", datetime(2021, 1, 1, 21, 30)),
    ("2021-01-01 23:30 UTC", datetime(2021, 1, 1, 23, 30)),
    ("2021-01-01T23:30:00Z", datetime(2021, 1, 1, 23, 30)),
    ("20220322", datetime(2022, 3, 22)),
    ("20220322T101559", datetime(2022, 3, 22, 10, 15, 59)),
    ("3/22/2022", datetime(2022, 3, 22)),
    ("22/3/2022", datetime(2022, 3, 22)),
    ("3/4/2022 11:15:59.25 AM", datetime(2022, 3, 4, 11, 15, 59, 250000)),
    ("Mar 1," + " " * 500 + "2019", datetime(2019, 3, 1)),
    (
        "Tuesday,  1st of March, 2019 at 10:00:00 p.m. UTC",
        datetime(2019, 3, 1, 22),
    ),
    (
        "\t".join(["Tuesday,", "1st", "of", "March,", "2019", "at", "10:00:00"]) + " " * 80,
        datetime(2019, 3, 1, 10),
    ),
    ("2020-01-02 and a long story that goes on for more than sixty-four bytes", None),
    ("2022-Mar-05", datetime(2022, 3, 5)),
    ("2022-anf-05", None),
    ("2022-xyz-05", None),
    ("anf 5 2022", None),
    # impossible, partial or relative values are not dates
    ("2022-02-30", None),
    ("2022-13-01", None),
    ("Feb 30, 2022", None),
    ("12:30", None),
    ("T10:00", None),
    ("now", None),
    ("today", None),
    ("12345", None),
    ("2022", None),
    ("March 2019", None),
    ("Janember 5 2020", None),
    ("1/2/22", None),
]


def test_date_normalize_vectors(table):
    df = table("i int, d string", *[(i, d) for i, (d, _) in enumerate(DATES)])
    out = date_normalize(df, "d")
    assert out.schema["d"].dataType == T.TimestampNTZType()
    got = dict(out.collect())
    assert {DATES[i][0]: got[i] for i in got} == dict(DATES)


def test_date_only_vectors(table):
    df = table("i int, d string", *[(i, d) for i, (d, _) in enumerate(DATES)])
    out = date_only(df, "d")
    assert out.schema["d"].dataType == T.DateType()
    got = dict(out.collect())
    expected = {d: m.date() if m else None for d, m in DATES}
    assert {DATES[i][0]: got[i] for i in got} == expected


def test_day_first_and_extra_formats(table):
    df = table("d string", ("3/4/2022",), ("4/22/2022",), ("22|03|2022",))
    assert values(date_only(df, "d", day_first=True), "d") == [
        date(2022, 4, 3),
        date(2022, 4, 22),
        None,
    ]
    assert values(date_only(df, "d", formats=["dd|MM|yyyy"]), "d")[2] == date(2022, 3, 22)


def test_dates_of_typed_columns(table):
    df = table(
        "t timestamp_ntz, d date, n bigint",
        (datetime(2022, 3, 22, 10, 15, 59, 673918), date(2019, 3, 1), 20220322),
    )
    assert values(date_normalize(df, "t"), "t") == [
        datetime(2022, 3, 22, 10, 15, 59, 673000)
    ]
    assert values(date_normalize(df, "d"), "d") == [datetime(2019, 3, 1)]
    assert values(date_only(df, "t"), "t") == [date(2022, 3, 22)]
    assert values(date_only(df, "n"), "n") == [date(2022, 3, 22)]


def test_trim_collapse(table):
    df = table(
        "a string, n bigint",
        ("  salt   and pepper ", 1),
        ("\tone\t two ", 2),
        (" no break em　 ", 3),
        ("", 4),
        (" \n ", 5),
        (None, 6),
        ("plain text", 7),
        ("tab\tonly", 8),
    )
    out = trim_collapse(df, ["a"])
    assert values(out, "a") == [
        "salt and pepper",
        "one two",
        "no break em",
        "",
        "",
        None,
        "plain text",
        "tab only",
    ]
    assert values(out, "n") == list(range(1, 9))
    assert values(trim_collapse(df, ["n"]), "n")[0] == "1"


def test_all_unicode_white_space(table):
    spaces = [c for c in map(chr, range(0x10000)) if c.isspace() and not "\x1c" <= c <= "\x1f"]
    assert sorted(spaces) == sorted(WHITE_SPACE)
    df = table("i int, a string", *[(i, f"{c}x{c}{c}y{c}") for i, c in enumerate(spaces)])
    assert set(values(trim_collapse(df, ["a"]), "a")) == {"x y"}
    assert set(values(split_column(df, "a", "x"), "a_1")) == {""}
    df = table("i int, a string", *[(i, f"{c}é{c}ü{c}{c}") for i, c in enumerate(spaces)])
    edges = df.select(strip_edges(F.col("a")).alias("a"))
    assert values(edges, "a") == [f"é{c}ü" for c in spaces]


def test_combine_columns(table):
    df = table(
        "first string, last string, n bigint", ("Ida", "Fox", 1), (None, "Fox", 2)
    )
    out = combine_columns(df, ["first", "last"], "full")
    assert out.columns == ["first", "last", "n", "full"]
    assert values(out, "full") == ["Ida Fox", "Fox"]
    out = combine_columns(df, ["last", "n"], "x y.z", "-")
    assert values(out, "x y.z") == ["Fox-1", "Fox-2"]


def test_split_on_blank_delimiter(table):
    df = table(
        "name string", ("  Ida    Fox ",), ("\tJo \n van Dam\t",), ("",), (None,)
    )
    for delimiter in ("", " ", "\t"):
        out = split_column(df, "name", delimiter)
        assert out.columns == ["name_1", "name_2", "name_3"]
        assert values(out, "name_1") == ["Ida", "Jo", None, None]
        assert values(out, "name_2") == ["Fox", "van", None, None]
        assert values(out, "name_3") == [None, "Dam", None, None]


def test_split_moves_pieces_to_the_end(table):
    df = table("name string, n bigint", ("Ida Fox", 1), ("Jo van Dam", 2), ("Z", 3))
    out = split_column(df, "name", " ")
    assert out.columns == ["n", "name_1", "name_2", "name_3"]
    assert [tuple(r) for r in out.where("n = 3").collect()] == [(3, "Z", None, None)]


def test_split_on_exact_delimiter(table):
    df = table("v string", (" x-y - z ",), ("-u",), ("v-",))
    out = split_column(df, "v", "-")
    assert [tuple(r) for r in out.collect()] == [
        ("x", "y ", " z"),
        ("", "u", None),
        ("v", "", None),
    ]


@pytest.mark.parametrize("delimiter", [".", "|", "\\", "^", "$", "::", ".*", "\\E", "ab"])
def test_split_delimiter_is_never_a_pattern(table, delimiter):
    df = table("v string", (delimiter.join(["x", "y", "z"]),), ("w",))
    out = split_column(df, "v", delimiter)
    assert [tuple(r) for r in out.collect()] == [("x", "y", "z"), ("w", None, None)]


@pytest.mark.parametrize("text,delimiter", [("aaaa", "aa"), ("aaa", "aa"), ("", ","), (",", ",")])
def test_width_agrees_with_the_split(table, text, delimiter):
    df = table("v string", (text,))
    width = split_width(df, "v", delimiter)
    array = df.select(F.size(F.split("v", F.lit(rf"\Q{delimiter}\E"), -1))).first()[0]
    assert width == array


def test_split_width_limits(table):
    df = table("v string", ("a-b-c",), (None,))
    with pytest.raises(ValueError, match="max_width"):
        split_column(df, "v", "-", max_width=2)
    assert split_column(df, "v", "-", width=4).columns == ["v_1", "v_2", "v_3", "v_4"]
    with pytest.raises(Exception, match="more than 2 pieces"):
        split_column(df, "v", "-", width=2).collect()
    clash = table("v string, v_1 string", ("a", "b"))
    with pytest.raises(ValueError, match="already exist"):
        split_column(clash, "v")
    assert split_column(table("v string", (None,)), "v").columns == ["v_1"]


def test_remove_and_rename(table):
    df = table("a bigint, `b.c` bigint, `d``e` bigint", (1, 2, 3))
    assert remove_columns(df, ["a", "b.c"]).columns == ["d`e"]
    assert rename_single(df, "b.c", "B").columns == ["a", "B", "d`e"]


def test_case_differs_between_columns(table):
    df = table("Name string, name string", (" A ", " b "))
    out = trim_collapse(df, ["name"])
    assert [tuple(r) for r in out.collect()] == [(" A ", "b")]


def test_text_of_doubles(table):
    numbers = [0.0, 1.0, 1234.5, 12345678.9, 1e7, 123456789012345.6, 0.00025, 1e-5, -2.5e9]
    df = table("x double", *[(n,) for n in numbers], (None,), (1e17,))
    got = values(df.select(as_text(F.col("x"), T.DoubleType()).alias("t")), "t")
    assert got == [
        "0.0",
        "1.0",
        "1234.5",
        "12345678.9",
        "10000000.0",
        "123456789012345.6",
        "0.00025",
        "0.00001",
        "-2500000000.0",
        None,
        "1.0E17",
    ]


def test_separators_outside_quotes(table):
    long = '"' + 'x,""' * 50_000 + '",2'
    df = table("r string", (long,), ('a,b,c',), ('"x,y",z',), ('"say ""hi, you""",2,3',), ("a",))
    got = values(df.select(count_outside_quotes(F.col("r"), ",").alias("n")), "n")
    assert got == [1, 2, 1, 2, 0]
