"""Text in legacy charsets: census and exact reading."""

import pytest

from tablecare import read_table, write_table
from tablecare.functions.columns import visible
from tablecare.sources.charset import charset_census, paths_by_charset

MALTESE = "Kunjom,Ilsien,Dett\nĊikku,Il-Ħamrun,2020-01-02\nĠorġ,Iż-Żejtun,2019-03-01\n"
ARABIC = "الاسم,المدينة,التعيين\nسمر خالد,تونس,2020-01-02\nمصعب,الرياض,2019-03-01\n"
JAPANESE = "氏名,都市,入社日\n鈴木 一郎,仙台市,2020-01-02\n高橋,東京,2019-03-01\n"
GREEK = "Kunjom,Μηνη\nĊikku,Ηράκλειο\n"


def expected(text, separator=","):
    header, *rows = [line.split(separator) for line in text.strip().split("\n")]
    return header, [tuple(r) for r in rows]


@pytest.mark.parametrize(
    "text,charset,codec",
    [
        (MALTESE, "ISO-8859-3", "iso8859_3"),
        (ARABIC, "windows-1256", "cp1256"),
        (JAPANESE, "x-SJIS_0213", "shift_jis_2004"),
        (GREEK, "UTF-16", "utf-16"),
        (GREEK, "UTF-8", "utf-8-sig"),
        (GREEK, None, "utf-8"),
    ],
)
@pytest.mark.parametrize("suffix,separator", [("csv", ","), ("tsv", "\t")])
def test_delimited_text(spark, tmp_path, text, charset, codec, suffix, separator):
    path = tmp_path / f"x.{suffix}"
    path.write_bytes(text.replace(",", separator).encode(codec))
    df = read_table(spark, str(path), encoding=charset)
    header, rows = expected(text)
    assert df.columns == header
    assert [tuple(r) for r in df.collect()] == rows


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.ndjson"
    path.write_bytes(
        '{"اسم": "مصعب", "المسار": "تونس"}\n{"اسم": "سلمي", "المسار": "الرياض"}\n'.encode("cp1256")
    )
    df = read_table(spark, str(path), encoding="windows-1256")
    assert [r["اسم"] for r in df.collect()] == ["مصعب", "سلمي"]
    groups = paths_by_charset(charset_census(spark, str(path), ["windows-1256"]))
    df = read_table(spark, str(path), charsets=groups)
    assert [r["المسار"] for r in df.collect()] == ["تونس", "الرياض"]


@pytest.mark.parametrize("charset,python", [("ISO-8859-3", "iso8859-3"), ("UTF-8", "utf-8")])
def test_json_keys_keep_their_order_in_any_charset(spark, tmp_path, charset, python):
    path = tmp_path / "x.jsonl"
    path.write_bytes('{"ħz": 1, "ġb": "ċ"}\n{"a": 2.5, "ħz": 3}\n'.encode(python))
    df = read_table(spark, str(path), encoding=charset)
    assert df.columns == ["ħz", "ġb", "a"]
    assert sorted(tuple(r) for r in df.fillna("").collect()) == [(1, "ċ", None), (3, "", 2.5)]
    later = tmp_path / "y.jsonl"
    later.write_text('{"new": 1, "ħz": 2.5}\n')
    df = read_table(spark, "", "jsonl", charsets={charset: [str(path)], None: [str(later)]})
    assert df.dtypes == [("ħz", "double"), ("ġb", "string"), ("a", "double"), ("new", "bigint")]


def test_json_lines_in_utf16(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_bytes('{"z": 1, "a": "Ηρά \\"x\\", ειο"}\n\n{"z": 2, "a": "仙台市"}\n'.encode("utf-16"))
    groups = paths_by_charset(charset_census(spark, str(path)))
    assert list(groups) == ["UTF-16"]
    df = read_table(spark, str(path), charsets=groups)
    assert df.columns == ["z", "a"]
    assert [tuple(r) for r in df.collect()] == [(1, 'Ηρά "x", ειο'), (2, "仙台市")]


@pytest.fixture
def mixed(tmp_path):
    """The same columns from four offices, each in its own charset."""
    folder = tmp_path / "mixed files"
    folder.mkdir()
    offices = {
        "malta 1.csv": ("id,name\n1,Ċikku Ħaż-Żebbuġ\n", "iso8859_3"),
        "tunis+2.csv": ("id,name\n2,سمر خالد\n", "cp1256"),
        "utf8.csv": ("id,name\n3,Ηράκλειο 仙台市\n", "utf-8"),
        "utf16.csv": ("id,name\n4,Ηράκλειο\n", "utf-16"),
    }
    for name, (text, codec) in offices.items():
        (folder / name).write_bytes(text.encode(codec))
    return str(folder)


def test_census(spark, mixed):
    census = charset_census(spark, mixed, ["ISO-8859-3", "windows-1256"])
    found = {r["path"].rsplit("/", 1)[1]: r for r in census.collect()}
    assert found["utf8.csv"]["utf8"] and found["utf8.csv"]["charset"] == "UTF-8"
    assert found["utf16.csv"]["charset"] == "UTF-16"
    assert found["malta%201.csv"]["charset"] == "ISO-8859-3"
    # any bytes decode as windows-1256, so this file is ambiguous, and says so
    assert found["malta%201.csv"]["ambiguous"]
    assert not any(r["undecodable"] for r in found.values())
    assert "windows-1256" in found["tunis+2.csv"]["possible"]


def test_read_by_census(spark, mixed):
    census = charset_census(
        spark,
        mixed,
        ["ISO-8859-3", "windows-1256"],
        overrides={"%/tunis%": "windows-1256"},
    )
    df = read_table(spark, mixed, "csv", charsets=paths_by_charset(census), row_order=True)
    assert visible(df) == ["id", "name"]
    assert dict(df.select(*visible(df)).collect()) == {
        1: "Ċikku Ħaż-Żebbuġ",
        2: "سمر خالد",
        3: "Ηράκλειο 仙台市",
        4: "Ηράκλειο",
    }


def test_undecodable_bytes_are_replaced(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a,b\n1,x\x81\xff\n")
    census = charset_census(spark, str(tmp_path), ["US-ASCII", "Shift_JIS"])
    row = census.first()
    assert (row["utf8"], row["possible"], row["charset"]) == (False, [], "UTF-8")
    assert row["undecodable"]
    df = read_table(spark, str(tmp_path), "csv", charsets=paths_by_charset(census))
    assert df.first()["b"].startswith("x�")


def test_unknown_charsets_fail_early(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a\n")
    with pytest.raises(LookupError):
        charset_census(spark, str(tmp_path), ["no-such-charset"])


def test_writing_in_a_charset(spark, table, tmp_path):
    out = str(tmp_path / "o.csv")
    write_table(table("n string", ("Ċikku",)), out, encoding="ISO-8859-3")
    assert read_table(spark, out, encoding="ISO-8859-3").first()["n"] == "Ċikku"
