"""Whole runs from files to files, their record, and their failures."""

import pytest
from datetime import datetime

from tablecare import StepError, read_table, run_recipe, write_table
from tablecare.__main__ import main

TIDY = (
    "# tidy\n"
    'trim_collapse(columns=["Unit", "Remarks"])\n'
    'date_normalize(column="Start Date")\n'
)


@pytest.fixture
def staff(tmp_path):
    path = tmp_path / "staff.csv"
    path.write_text(
        "id,Start Date,Unit,Remarks\n"
        '1,2021-05-04,  Field Crew ,  Mia  Rey  \n2,"Jan 9, 2018",Desk,""\n'
    )
    return path


def test_default_destination(spark, staff, tmp_path):
    report = run_recipe(spark, TIDY, str(staff))
    assert report.destination == str(tmp_path / "staff-normalized.csv")
    assert (report.rows_in, report.rows_out) == (2, 2)
    assert report.null_counts == {"Start Date": 0, "Unit": 0, "Remarks": 0}
    out = read_table(spark, report.destination).orderBy("id").collect()
    assert [r["Unit"] for r in out] == ["Field Crew", "Desk"]
    assert [r["Start Date"] for r in out] == ["2021-05-04T00:00:00", "2018-01-09T00:00:00"]


def test_other_format_keeps_real_types(spark, staff, tmp_path):
    out = str(tmp_path / "done" / "clean.parquet")
    run_recipe(spark, TIDY, str(staff), out)
    back = read_table(spark, out).orderBy("id")
    assert back.first()["Start Date"] == datetime(2021, 5, 4)
    assert not (tmp_path / "staff-normalized.csv").exists()


@pytest.mark.parametrize("suffix", ["csv", "tsv", "jsonl", "parquet", "xlsx"])
def test_every_format_in_and_out(spark, staff, tmp_path, suffix):
    source = str(tmp_path / f"in.{suffix}")
    write_table(read_table(spark, str(staff)), source)
    recipe = TIDY + 'dedup_rows(columns=["Unit"], keep="last")\n'
    report = run_recipe(spark, recipe, source)
    assert report.destination == str(tmp_path / f"in-normalized.{suffix}")
    back = read_table(spark, report.destination).orderBy("id").collect()
    assert [r["Unit"] for r in back] == ["Field Crew", "Desk"]
    with pytest.raises(ValueError, match="destination"):
        run_recipe(spark, recipe, str(tmp_path / f"*.{suffix}"))


@pytest.mark.parametrize(
    "recipe,problem",
    [
        ('trim_collapse(columns=["Unit"])\ntrim_collapse(columns=["Absent"])', "step 2 of 2"),
        ("sort_rows(by=1)", "unknown operation 'sort_rows'"),
    ],
)
def test_refused_recipes_write_nothing(spark, staff, tmp_path, recipe, problem):
    with pytest.raises(StepError, match=problem):
        run_recipe(spark, recipe, str(staff))
    assert [p.name for p in tmp_path.iterdir()] == ["staff.csv"]


def test_failing_jobs_write_nothing(spark, staff, tmp_path):
    staff.write_text(staff.read_text() + "3,x,y,z,surplus\n")
    with pytest.raises(Exception, match="more than 4 fields"):
        run_recipe(spark, TIDY, str(staff))
    assert [p.name for p in tmp_path.iterdir()] == ["staff.csv"]


def test_late_values_turn_the_run_to_text(spark, tmp_path):
    source = tmp_path / "late.csv"
    lines = [f"{i},{i % 7}\n" for i in range(12_000)] + ["late,1\n"]
    source.write_text("id,k\n" + "".join(lines))
    recipe = 'rename_single(column="k", new_name="key")'
    report = run_recipe(spark, recipe, str(source), str(tmp_path / "o.parquet"))
    assert report.rows_out == 12_001
    back = read_table(spark, report.destination)
    assert {f.dataType.simpleString() for f in back.schema} == {"string"}
    report = run_recipe(
        spark, recipe, str(source), str(tmp_path / "p.parquet"), fallback="column"
    )
    kinds = [f.dataType.simpleString() for f in read_table(spark, report.destination).schema]
    assert kinds == ["string", "bigint"]


def test_file_order_decides_what_is_kept(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\nx,1\nx,2\ny,3\n")
    (tmp_path / "b.csv").write_text("k,v\ny,4\n")
    recipe = 'dedup_rows(columns=["k"], keep="last")'
    report = run_recipe(
        spark,
        recipe,
        str(tmp_path / "*.csv"),
        str(tmp_path / "o.parquet"),
        lineage=str(tmp_path / "lineage"),
    )
    assert (report.rows_in, report.rows_out) == (4, 2)
    back = read_table(spark, report.destination)
    assert sorted(map(tuple, back.collect())) == [("x", 2), ("y", 4)]
    recipe = "dedup_rows()"
    report = run_recipe(
        spark, recipe, str(tmp_path / "*.csv"), str(tmp_path / "p.parquet")
    )
    assert (report.rows_in, report.rows_out) == (None, 4)


def test_lineage_gets_a_row_per_run(spark, staff, tmp_path):
    table = str(tmp_path / "lineage")
    recipe = TIDY + 'split_column(column="Remarks")\n'
    for _ in range(2):
        report = run_recipe(spark, recipe, str(staff), lineage=table)
    assert report.null_counts == {"Start Date": 0, "Unit": 0, "Remarks_1": 1, "Remarks_2": 1}
    rows = spark.read.parquet(table).collect()
    assert len({r["run_id"] for r in rows}) == 2
    assert len({r["recipe_hash"] for r in rows}) == 1
    row = rows[0]
    assert row["source"] == [str(staff)] and row["rows_out"] == 2
    assert 'split_column(column="Remarks", width=2)' in row["recipe"]


def test_command_line(spark, staff, tmp_path, capsys):
    recipe = tmp_path / "tidy.txt"
    recipe.write_text(TIDY)
    out = str(tmp_path / "o.tsv")
    assert main([str(staff), "--recipe", str(recipe), "--output", out]) == 0
    shown = capsys.readouterr()
    assert 'trim_collapse(columns=["Unit", "Remarks"])' in shown.out
    assert "2 rows" in shown.err and out in shown.err
    assert read_table(spark, out).count() == 2
    assert main([str(staff), "--recipe", str(tmp_path / "missing.txt")]) == 1
    assert "missing.txt" in capsys.readouterr().err
    recipe.write_text('trim_collapse(columns=["Nope"])')
    assert main([str(staff), "--recipe", str(recipe)]) == 1
    assert "step 1 of 1" in capsys.readouterr().err


def test_job_has_the_options_of_a_read(spark, tmp_path, capsys):
    folder = tmp_path / "in" / "deep"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_bytes("kodiċi,isem\n007, Ġorġ  B \n".encode("iso8859-3"))
    recipe = tmp_path / "r.txt"
    recipe.write_text('trim_collapse(columns=["isem"])\n', encoding="utf-8")
    out = str(tmp_path / "out.parquet")
    job = [str(tmp_path / "in"), "--recipe", str(recipe), "--format", "csv", "--output", out]
    assert main(job + ["--recursive"]) == 1
    assert "name a charset" in capsys.readouterr().err
    job += ["--recursive", "--charset", "ISO-8859-3"]
    assert main(job) == 0
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(7, "Ġorġ B")]
    for types in ("string", '{"kodiċi": "string", "isem": "string"}'):
        assert main(job + ["--types", types]) == 0
        assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("007", "Ġorġ B")]
    assert main(job + ["--keep-existing"]) == 1
    assert "exists" in capsys.readouterr().err
    copy = str(tmp_path / "copy")
    job = [out, "--recipe", str(recipe), "--output", copy]
    assert main(job + ["--output-format", "jsonl"]) == 0
    assert [r.isem for r in read_table(spark, copy, "jsonl").collect()] == ["Ġorġ B"]
    assert main(job + ["--charset", "UTF-16"]) == 1
    assert "no option encoding" in capsys.readouterr().err
