"""Reading and writing files: fidelity, typing and the fallback to text."""

import json
from datetime import date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablecare import format_of, read_table, write_table
from tablecare.functions.columns import ROW_ORDER, visible
from tablecare.sinks.table import default_destination
from tests.test_recipe import STAFF, STAFF_SCHEMA


def kinds(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def tuples(df):
    return [tuple(r) for r in df.collect()]


def csv(tmp_path, text, name="in.csv"):
    path = tmp_path / name
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


@pytest.mark.parametrize("suffix", ["csv", "tsv", "txt", "jsonl", "parquet", "xlsx"])
def test_round_trip(spark, table, tmp_path, suffix):
    df = table(STAFF_SCHEMA, *STAFF).coalesce(1)
    out = str(tmp_path / f"staff.{suffix}")
    write_table(df, out)
    back = read_table(spark, out)
    assert back.columns == df.columns
    numeric = suffix not in ("parquet", "jsonl", "xlsx")
    assert kinds(back)["id"] == ("bigint" if numeric else "string")
    expected = [(int(r[0]) if numeric else r[0], *r[1:]) for r in STAFF]
    assert sorted(tuples(back)) == expected


def test_formats_by_suffix():
    assert format_of("a.CSV") == "csv"
    assert format_of("/x/a.txt") == "tsv"
    assert format_of("s3a://b/*.ndjson") == "jsonl"
    assert format_of("a.pq") == format_of("a.parq/") == "parquet"
    with pytest.raises(ValueError, match=".wacz"):
        format_of("a.wacz")


def test_unknown_formats_are_refused(spark, table, tmp_path):
    with pytest.raises(ValueError, match="wacz"):
        write_table(table("a int", (1,)), str(tmp_path / "o.csv"), "wacz")
    with pytest.raises(ValueError, match="wacz"):
        read_table(spark, "x.csv", "wacz")


def test_csv_details(spark, tmp_path):
    path = csv(
        tmp_path,
        b"\xef\xbb\xbf" + '"id","a b",c\r\n1,"x ""y"", z",  edge \r\n2,"two\nlines",\r\n'
        '3,"",2020-01-02\r\n4\r\n'.encode(),
    )
    df = read_table(spark, path)
    assert kinds(df) == {"id": "bigint", "a b": "string", "c": "string"}
    assert tuples(df) == [
        (1, 'x "y", z', "  edge "),
        (2, "two\nlines", None),
        (3, "", "2020-01-02"),
        (4, None, None),
    ]


def test_surplus_fields_fail(spark, tmp_path):
    path = csv(tmp_path, 'a,b\n1,2\n1,2,3,4\n')
    with pytest.raises(Exception, match="more than 2 fields"):
        read_table(spark, path).collect()
    with pytest.raises(Exception, match="more than 2 fields"):
        read_table(spark, path, types="string").count()
    trailing = csv(tmp_path, 'a,b\n1,"x,y"\n2,3,\n', "t.csv")
    with pytest.raises(Exception, match="more than 2 fields"):
        read_table(spark, trailing, types="string").count()


def test_literals(spark, tmp_path):
    path = csv(
        tmp_path,
        "i,d,b,s,pad,huge,none\n"
        "1,1.5,true,1d, 1,99999999999999999999,\n"
        "-2,3,FALSE,t,2,1,\n"
        "+3,1e3,,1,3,2,\n".replace("+3", "3"),
    )
    df = read_table(spark, path)
    assert kinds(df) == {
        "i": "bigint",
        "d": "double",
        "b": "boolean",
        "s": "string",
        "pad": "string",
        "huge": "double",
        "none": "string",
    }
    assert tuples(df.select("i", "d", "b"))[2] == (3, 1000.0, None)


def odd_one(tmp_path, at, rows=900):
    """Prices by part; the part of row ``at`` is a word."""
    parts = (("spare" if i == at else str(7 * i), f"{i}.25") for i in range(rows))
    return csv(tmp_path, "part,price\n" + "".join(f"{p},{x}\n" for p, x in parts))


@pytest.mark.parametrize("at", [0, 199])
def test_a_word_in_the_window_types_its_column(spark, tmp_path, at):
    df = read_table(spark, odd_one(tmp_path, at), typing_rows=200)
    assert kinds(df) == {"part": "string", "price": "double"}
    assert df.count() == 900


@pytest.mark.parametrize("at", [200, 899])
def test_a_word_after_the_window(spark, tmp_path, at):
    path = odd_one(tmp_path, at)
    df = read_table(spark, path, typing_rows=200)
    assert kinds(df) == {"part": "string", "price": "string"}
    assert df.where("part = 'spare'").first()["price"] == f"{at}.25"
    own = read_table(spark, path, typing_rows=200, fallback="column")
    assert kinds(own) == {"part": "string", "price": "double"}
    with pytest.raises(Exception, match="LATE_VALUE"):
        read_table(spark, path, typing_rows=200, late="fail").count()


def test_many_small_files_are_one_window(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    for i in range(70):
        (folder / f"{i:04}.csv").write_text(f"a,b\n{'x' if i == 69 else i},{i}\n")
    assert kinds(read_table(spark, str(folder))) == {"a": "string", "b": "bigint"}


def test_surplus_fields_are_seen_whatever_is_selected(spark, tmp_path):
    path = csv(tmp_path, "a,b,c\n" + "1,2,3\n" * 50 + "1,2,3,4\n")
    with pytest.raises(Exception, match="more than 3 fields"):
        read_table(spark, path, types="string", multiline=False).select("a").collect()


def test_json_keys_come_in_the_order_of_their_first_line(spark, tmp_path):
    path = tmp_path / "k.jsonl"
    path.write_text('{"m": 1}\n' * 150 + '{"z": 1, "b": 2}\n')
    assert read_table(spark, str(path)).columns == ["m", "z", "b"]


JSON_LINES = [
    '{"a": 2.0}', '{"a": 10}', '{"a": 1.5, "b": NaN}', '{"b": 123456789012345678901}', '[{"a": 1}, {"c": 2}]',
    '{"o": {}}', '{"p": [{}], "a": null}', '{"o": {"k.e`y": 1, "<x": {"OBJECT<": [], "d": 1.25}}}', '{"n": null}',
    '{"o": {"x": [1, 2.5, null]}}', '{"o": 5, "big": 1e300}', '{"t": "2020-01-02", "b": true}', "{}", "", "{'q': 1}",
]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(JSON_LINES), min_size=1, max_size=6))
def test_json_types_are_those_of_the_reader(spark, tmp_path_factory, lines):
    path = tmp_path_factory.mktemp("json") / "x.jsonl"
    path.write_text("\n".join(lines) + "\n")
    expected = spark.read.json(str(path))
    df = read_table(spark, str(path))
    assert kinds(df) == kinds(expected)
    assert sorted(map(repr, df.select(expected.columns).collect())) == sorted(map(repr, expected.collect()))


def test_json_schema_takes_one_read(spark, tmp_path, monkeypatch):
    path = tmp_path / "x.jsonl"
    path.write_text('{"z": 1, "o": {"b": [1, 2.5], "a": null}}\n{"z": 2.5, "é": "x"}\n')
    monkeypatch.setattr("tablecare.sources.jsonlines._merged", None)  # the way with a second read
    df = read_table(spark, str(path))
    assert df.dtypes == [("z", "double"), ("o", "struct<a:string,b:array<double>>"), ("é", "string")]


def test_json_lines_that_are_no_utf8_fail(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_bytes('{"a": "Kunjom"}\n{"a": "Ħal"}\n'.encode("iso8859-3"))
    with pytest.raises(Exception, match="name a charset"):
        read_table(spark, str(path)).collect()


def test_paths_of_several_formats_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="differ in format"):
        read_table(spark, [csv(tmp_path, "a\n1\n"), f"{tmp_path}/x.parquet"])


def test_window_spans_leading_files(spark, tmp_path):
    csv(tmp_path, "id,x\n1,1\n", "a.csv")
    csv(tmp_path, "id,x\nz,2.5\n", "b [1] +1%20.csv")
    df = read_table(spark, str(tmp_path), "csv", late="fail")
    assert kinds(df) == {"id": "string", "x": "double"}
    assert sorted(tuples(df)) == [("1", 1.0), ("z", 2.5)]


def test_headers_must_agree(spark, tmp_path):
    csv(tmp_path, "a,b\n1,2\n", "a.csv")
    csv(tmp_path, "b,a\n1,2\n", "b.csv")
    with pytest.raises(Exception):
        read_table(spark, str(tmp_path), "csv", types="string").collect()


def test_odd_headers(spark, tmp_path):
    path = csv(tmp_path, 'a,,a,"b ""c"", d",a\n1,2,3,4,5\n')
    df = read_table(spark, path)
    assert df.columns == ["a", "unnamed_2", "a_duplicated_0", 'b "c", d', "a_duplicated_1"]
    assert tuples(df) == [(1, 2, 3, 4, 5)]
    with pytest.raises(ValueError, match="header"):
        read_table(spark, csv(tmp_path, "", "empty.csv"))
    assert read_table(spark, csv(tmp_path, "a,b\n", "only.csv")).count() == 0
    spanning = csv(tmp_path, '"a\nb",c\n1,2\n', "span.csv")
    assert read_table(spark, spanning).columns == ["a\nb", "c"]


def test_given_types(spark, tmp_path):
    path = csv(tmp_path, "a,b\n1,2\n3,x\n")
    df = read_table(spark, path, types={"a": "double"})
    assert tuples(df) == [(1.0, "2"), (3.0, "x")]


def test_large_files_are_split_also_where_quotes_span_lines(spark, tmp_path):
    plain = csv(tmp_path, "a,b\n" + '1,"x,y"\n' * 5000, "plain.csv")
    spanning = csv(tmp_path, "a,b\n" + '1,"x\ny"\n' * 5000, "spanning.csv")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        split = read_table(spark, plain, row_order=True)
        assert split.rdd.getNumPartitions() > 2 and split.count() == 5000
        found = read_table(spark, spanning)
        assert found.rdd.getNumPartitions() > 2 and found.where("b = 'x\ny'").count() == 5000
        ordered = csv(tmp_path, "n\n" + "".join(f"{i}\n" for i in range(20_000)), "n.csv")
        df = read_table(spark, ordered, row_order=True)
        assert [r["n"] for r in df.orderBy(ROW_ORDER).collect()] == list(range(20_000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folder_tree(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    csv(tmp_path / "x", "a\n1\n")
    csv(tmp_path / "x" / "y", "a\n2\n")
    df = read_table(spark, str(tmp_path), "csv", recursive=True)
    assert sorted(tuples(df)) == [(1,), (2,)]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "in.jsonl"
    path.write_text(
        '{"z": 1, "a": "2020-01-02", "n": {"k": [1, 2]}}\n{"z": 2.5, "later": true}\n'
    )
    df = read_table(spark, str(path), row_order=True)
    assert visible(df) == ["z", "a", "n", "later"]
    assert kinds(df)["a"] == "string" and kinds(df)["z"] == "double"
    path.write_text('{"z": 1}\nnot json\n')
    with pytest.raises(Exception):
        read_table(spark, str(path)).collect()


def test_datetimes_in_text_formats_are_whole_seconds(spark, table, tmp_path):
    moment = datetime(2022, 3, 22, 10, 15, 59, 673000)
    df = table("d timestamp_ntz, e date", (moment, date(2020, 1, 2)), (None, None))
    for suffix in ("csv", "tsv", "jsonl"):
        out = str(tmp_path / f"x.{suffix}")
        write_table(df, out)
        back = read_table(spark, out)
        assert kinds(back) == {"d": "string", "e": "string"}
        assert set(tuples(back)) == {("2022-03-22T10:15:59", "2020-01-02"), (None, None)}
    for suffix in ("parquet", "xlsx"):
        out = str(tmp_path / f"x.{suffix}")
        write_table(df.where("d is not null"), out)
        back = read_table(spark, out)
        assert kinds(back)["d"] == "timestamp_ntz" and back.first()["d"] == moment


def test_text_output_is_exact(spark, table, tmp_path):
    df = table("a string, x double", ("  Quay ", 1e7), ('say "x", y', 0.0001), ("", None))
    out = str(tmp_path / "o.csv")
    write_table(df, out, single_file=True)
    (part,) = [p for p in (tmp_path / "o.csv").glob("part-*.csv")]
    assert part.read_text() == (
        'a,x\n  Quay ,10000000.0\n"say ""x"", y",0.0001\n"",\n'
    )
    out = str(tmp_path / "o.jsonl")
    write_table(df, out, single_file=True)
    (part,) = [p for p in (tmp_path / "o.jsonl").glob("part-*.json")]
    assert [json.loads(s) for s in part.read_text().splitlines()][2] == {"a": "", "x": None}


def test_overwriting(spark, table, tmp_path):
    out = str(tmp_path / "o.parquet")
    df = table("a int", (1,))
    write_table(df, out)
    with pytest.raises(FileExistsError):
        write_table(df, out)
    write_table(table("a int", (2,)), out, overwrite=True)
    assert tuples(read_table(spark, out)) == [(2,)]
    # a failed write leaves the old table alone, and no rubbish
    broken = df.selectExpr("cast(raise_error('no') as int) as a")
    with pytest.raises(Exception, match="no"):
        write_table(broken, out, overwrite=True)
    assert tuples(read_table(spark, out)) == [(2,)]
    with pytest.raises(Exception, match="no"):
        write_table(broken, str(tmp_path / "new.parquet"))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["o.parquet"]
    # replacing a table by what is read from it
    write_table(read_table(spark, out).selectExpr("a + 1 as a"), out, overwrite=True)
    assert tuples(read_table(spark, out)) == [(3,)]


def test_hidden_order_is_never_written(spark, table, tmp_path):
    out = str(tmp_path / "o.csv")
    write_table(table("a int", (1,)), out)
    df = read_table(spark, out, row_order=True)
    assert ROW_ORDER in df.columns
    write_table(df, str(tmp_path / "p.csv"))
    assert read_table(spark, str(tmp_path / "p.csv")).columns == ["a"]


def test_default_destination():
    assert default_destination("/d/members.csv") == "/d/members-normalized.csv"
    assert default_destination("hdfs://h/d/m.parquet/") == "hdfs://h/d/m-normalized.parquet"
    assert default_destination("m.tsv") == "m-normalized.tsv"
