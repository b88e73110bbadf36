"""Records of delimited text: quotes over lines and splits, blank lines, charsets."""

import csv
import io
import random

import duckdb
import pytest

from tablecare.functions.columns import ROW_ORDER
from tablecare.plans.run import run_recipe
from tablecare.sinks.table import write_table
from tablecare.sources.records import cells, ends_inside
from tablecare.sources.table import read_table

SETTINGS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture(params=["300", "64m"])
def splits(spark, request):
    before = [spark.conf.get(s) for s in SETTINGS]
    cost = "100" if request.param == "300" else "4m"
    for setting, value in zip(SETTINGS, (request.param, cost), strict=True):
        spark.conf.set(setting, value)
    yield request.param
    for setting, value in zip(SETTINGS, before, strict=True):
        spark.conf.set(setting, value)


def put(folder, text, name="t.csv", codec="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(codec))
    return str(path)


def tricky(seed, count):
    """Rows with quotes, separators and line breaks, some longer than a split."""
    rng = random.Random(seed)
    values = ["x", '5" pipe', "li\nne", 'q"q', "", "g,h", 'e"\n"\nf', '"', "\n\n", "é,\r\nü", '","']
    return [
        (i, rng.choice(values) if rng.random() < 0.95 else 'w,"\n' * rng.randrange(400))
        for i in range(count)
    ]


def as_csv(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def test_ends_inside():
    cases = {
        "a,b": False, '"a': True, '"a"': False, 'a"b': False, '5" pipe,"x': True, '"a""': True,
        '"a"""': False, '"a"b"c': False, '"a"b,"c': True, ',,"': True, '""': False, "": False,
        'x","y': True,
    }
    for line, inside in cases.items():
        assert ends_inside(line, False, ",") is inside
    assert ends_inside("a,b", True, ",") and not ends_inside('a",b', True, ",")
    assert ends_inside('a","b', True, ",") and not ends_inside('a"x"y', True, ",")
    assert cells('a,"b ""c"", d",,5" pipe', ",") == ["a", 'b "c", d', "", '5" pipe']


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("options", [{}, {"types": "string"}, {"row_order": True}])
def test_rows_do_not_depend_on_splits(spark, tmp_path, splits, options, end):
    rows = tricky(len(end), 150)
    (tmp_path / "t.csv").mkdir()
    put(tmp_path / "t.csv", as_csv([("n", "t"), *rows[:90]], end), "a.csv")
    put(tmp_path / "t.csv", "﻿" + as_csv([("n", "t"), *rows[90:]], end), "b.csv")
    df = read_table(spark, str(tmp_path / "t.csv"), **options)
    if options.get("row_order"):
        # the order of the files, also for records that were put together
        df = df.orderBy(ROW_ORDER)
        assert [(int(r["n"]), r["t"] or "") for r in df.collect()] == rows
    assert sorted((int(r["n"]), r["t"] or "") for r in df.collect()) == rows


def test_a_run_looks_again_where_records_go_over_splits(spark, tmp_path, splits):
    rows = tricky(7, 120)
    source = put(tmp_path, as_csv([("n", "t"), *rows]))
    out = str(tmp_path / "out.parquet")
    run_recipe(spark, 'rename_single(column="t", new_name="u")', source, out)
    found = spark.read.parquet(out).collect()
    assert sorted((r["n"], r["u"] or "") for r in found) == rows


def test_a_quote_that_is_never_closed_is_refused(spark, tmp_path, splits):
    path = put(tmp_path, "a,b\n1,2\n" * 1 + '3,"x\n' + "4,5\n" * 300)
    with pytest.raises(Exception, match="never closed"):
        read_table(spark, path, multiline=True).count()


def test_one_column_keeps_its_blank_lines(spark, table, tmp_path, splits):
    rows = [("a",), (None,), ("b",), (None,), ("",), ("c d",)]
    path = str(tmp_path / "one.csv")
    write_table(table("v string", *rows).coalesce(1), path)
    found = read_table(spark, path, row_order=True).orderBy(ROW_ORDER).select("v").collect()
    assert [tuple(r) for r in found] == rows
    said = duckdb.sql(
        f"select v from read_csv('{path}/part-*', header = true, delim = ',', quote = '\"', "
        "allow_quoted_nulls = false, auto_detect = false, columns = {'v': 'varchar'})"
    ).fetchall()
    assert said == rows
    # more columns: a blank line is no row
    assert read_table(spark, put(tmp_path, "a,b\n\n1,2\n\n")).count() == 1


def test_short_and_surplus_rows(spark, tmp_path, splits):
    path = put(tmp_path, 'a,b,c\n1,2\n"x,y,z",5" pipe\n,,\n')
    assert [tuple(r) for r in read_table(spark, path).collect()] == [
        ("1", "2", None), ("x,y,z", '5" pipe', None), (None, None, None),
    ]
    path = put(tmp_path, 'a,b\n1,2\n"x\ny",2,3\n', "many.csv")
    with pytest.raises(Exception, match="more than 2 fields"):
        read_table(spark, path, types="string").select("b").collect()


def test_swapped_headers_are_refused(spark, tmp_path):
    put(tmp_path, "x,y,y\n1,2,3\n", "a.csv")
    put(tmp_path, "y,y,x\n1,2,3\n", "b.csv")
    with pytest.raises(Exception, match="headers of files differ"):
        read_table(spark, str(tmp_path), "csv", types="string").collect()


@pytest.mark.parametrize("suffix,separator", [("csv", ","), ("tsv", "\t")])
def test_bytes_that_are_no_utf8_fail(spark, tmp_path, suffix, separator):
    path = put(tmp_path, f"a{separator}b\nKunġom{separator}1\n", f"t.{suffix}", "iso8859-3")
    with pytest.raises(Exception, match="no UTF-8; see charset_census"):
        read_table(spark, path).collect()
    found = read_table(spark, path, encoding="ISO-8859-3").collect()
    assert [tuple(r) for r in found] == [("Kunġom", 1)]
    # a charset that is named is read as told
    assert read_table(spark, path, encoding="UTF-8").first()["a"] == "Kun�om"
