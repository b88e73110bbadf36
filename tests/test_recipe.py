"""Recipe text, schema checks and folding."""

import pytest
from datetime import date, datetime

from tablecare import (
    Step,
    StepError,
    apply_recipe,
    clean,
    parse_recipe,
    read_recipe,
    recipe_text,
    write_recipe,
)
from tablecare.plans.operations import OPERATIONS, Shape, check_steps
from tablecare.plans.recipe import parse_line

STAFF = [
    ("1", "2021-05-04", "  Field Crew ", ""),
    ("2", "Jan 9, 2018", "Desk", " "),
    ("3", "", "Field   Crew  North", "Mia  Rey"),
    ("4", "Sept 14 2020", "Desk", ""),
]
STAFF_SCHEMA = "id string, `Start Date` string, Unit string, Remarks string"


@pytest.fixture
def staff(table):
    return table(STAFF_SCHEMA, *STAFF)


def test_known_operations():
    assert set(OPERATIONS) == {
        "date_normalize",
        "date_only",
        "trim_collapse",
        "combine_columns",
        "split_column",
        "remove_columns",
        "dedup_rows",
        "rename_single",
    }


def test_a_written_recipe_is_comments_then_steps():
    text = recipe_text([Step("remove_columns", {"columns": ["x"]}), Step("f")], ["from orders", ""])
    comments = [x for x in text.splitlines() if x.startswith("#")]
    assert comments[-1] == "# from orders" and len(comments) == 2
    assert text.endswith('remove_columns(columns=["x"])\nf()\n')


@pytest.mark.parametrize(
    "step",
    [
        Step("trim_collapse", {"columns": ["Unit", 'odd "one", (1)']}),
        Step("split_column", {"column": "Remarks", "delimiter": ""}),
        Step("dedup_rows", {"columns": [], "keep": "first"}),
        Step("rename_single", {"column": "名前", "new_name": "naïve 😀"}),
        Step("noted", {"a": None, "b": True, "c": 1.5, "d": {"e": [1]}}),
        Step("bare", {}),
    ],
)
def test_lines_round_trip(step):
    assert parse_line(step.line()) == step
    step.line().encode("ascii")


def test_lenient_spacing():
    assert parse_line(' f( a = 1 ,b=[2, 3],) ') == Step("f", {"a": 1, "b": [2, 3]})
    assert parse_line("f(a=1, a=2)") == Step("f", {"a": 2})
    assert parse_line("f( )") == Step("f")


@pytest.mark.parametrize(
    "line,reason",
    [
        ("open(a=1", "not a step"),
        ("f(a=bare_word)", "'a' is not JSON"),
        ("f(a=__import__('os'))", "'a' is not JSON"),
        ("f(a=1 b=2)", "comma"),
        ("f(1)", "name=value"),
        ("two words(a=1)", "not a step"),
    ],
)
def test_bad_lines(line, reason):
    with pytest.raises(ValueError, match=reason):
        parse_line(line)


def test_recipe_files(tmp_path, spark):
    path = tmp_path / "steps.recipe"
    steps = [Step("combine_columns", {"columns": ["p", "q"], "new_name": "ß"}), Step("g")]
    write_recipe(str(path), steps, ["naïve"])
    assert path.read_bytes().isascii()
    assert read_recipe(str(path)) == read_recipe(path.as_uri(), spark) == steps
    path.write_text("\n  # indented comment\n\tg()\ng(1)\n")
    with pytest.raises(ValueError, match="steps.recipe line 4: expected name=value"):
        read_recipe(str(path))


def test_apply_and_partial_replay(staff):
    recipe = (
        'trim_collapse(columns=["Unit", "Remarks"])\ndate_normalize(column="Start Date")\n'
    )
    done = apply_recipe(staff, recipe).df
    assert [r["Unit"] for r in done.collect()] == [
        "Field Crew",
        "Desk",
        "Field Crew North",
        "Desk",
    ]
    assert [r["Remarks"] for r in done.collect()] == ["", "", "Mia Rey", ""]
    assert [r["Start Date"] for r in done.collect()] == [
        datetime(2021, 5, 4),
        datetime(2018, 1, 9),
        None,
        datetime(2020, 9, 14),
    ]
    one = apply_recipe(staff, recipe, upto=1).df
    assert [r["Start Date"] for r in one.collect()] == [r[1] for r in STAFF]
    assert one.first()["Unit"] == "Field Crew"
    none = apply_recipe(staff, recipe, upto=0).df
    assert none.collect() == staff.collect()


def test_names_dates_and_renames(table):
    df = table(
        "member bigint, `Whole Name` string, Branch string, `Since` string",
        (71, "Ada Byron", "  North  Quay ", "2016-02-29"),
        (72, None, None, None),
    )
    recipe = """
        # source: members.csv
        date_normalize(column="Since")
        trim_collapse(columns=["Whole Name", "Branch"])
        split_column(column="Whole Name", delimiter="")
        rename_single(column="Whole Name_1", new_name="Given")
        rename_single(column="Whole Name_2", new_name="Family")
    """
    cleaned = apply_recipe(df, recipe)
    assert cleaned.df.columns == [
        "member",
        "Branch",
        "Since",
        "Given",
        "Family",
    ]
    assert [tuple(r) for r in cleaned.df.collect()] == [
        (71, "North Quay", datetime(2016, 2, 29), "Ada", "Byron"),
        (72, None, None, None, None),
    ]
    # the width found is part of the steps, so that a replay need not look again
    assert cleaned.steps[2].params["width"] == 2
    assert apply_recipe(df, cleaned.steps).df.collect() == cleaned.df.collect()


@pytest.mark.parametrize(
    "line,reason",
    [
        ('date_normalize(column="nope")', "no column 'nope'"),
        ("date_normalize(column=7)", "no column 7"),
        ("date_normalize()", "'column' is missing"),
        ('date_normalize(column="__row_order__")', "no column"),
        ('trim_collapse(columns=["Unit", "nope"])', "no column 'nope'"),
        ("trim_collapse(columns=[])", "at least 1"),
        ('trim_collapse(columns="Unit")', "list of columns"),
        ('combine_columns(columns=["Unit"], new_name="x")', "at least 2"),
        ('combine_columns(columns=["Unit", "Unit"], new_name="x")', "at least 2"),
        ('combine_columns(columns=["Unit", "id"], new_name="Remarks")', "already exists"),
        ('combine_columns(columns=["Unit", "id"], new_name="")', "new column name"),
        ('combine_columns(columns=["Unit", "id"])', "'new_name' is missing"),
        ('rename_single(column="Unit", new_name="id")', "already exists"),
        ('rename_single(column="nope", new_name="x")', "no column 'nope'"),
        ('remove_columns(columns=["nope"])', "no column 'nope'"),
        ("remove_columns(columns=[])", "at least 1"),
        ('dedup_rows(columns=["id"], keep="any")', "keep must be"),
        ('split_column(column="Unit", width=0)', "width"),
        ("sort_rows(by=1)", "unknown operation 'sort_rows'"),
    ],
)
def test_refused_steps_are_named(staff, line, reason):
    recipe = 'trim_collapse(columns=["Unit"])\n' + line
    with pytest.raises(StepError, match="step 2 of 2.*" + reason):
        apply_recipe(staff, recipe)


def test_check_follows_names_through_steps(staff):
    good = """
        rename_single(column="Unit", new_name="Team")
        combine_columns(columns=["Team", "id"], new_name="Label")
        remove_columns(columns=["Team"])
        split_column(column="Label")
        trim_collapse(columns=["Label_1"])
        rename_single(column="Label_2", new_name="Team")
        dedup_rows(columns=["Team"], order_by=["id"])
    """
    check_steps(Shape.of(staff), parse_recipe(good))
    with pytest.raises(StepError, match="step 2 of 2.*'Unit'"):
        apply_recipe(
            staff,
            'remove_columns(columns=["Unit"])\ntrim_collapse(columns=["Unit"])',
        )


def test_piece_that_the_data_does_not_have(staff):
    recipe = 'split_column(column="Unit")\ntrim_collapse(columns=["Unit_9"])'
    with pytest.raises(StepError, match="step 2 of 2.*Unit_9"):
        apply_recipe(staff, recipe)


def test_empty_recipe_and_defaults(staff, table):
    with pytest.raises(ValueError, match="no steps"):
        apply_recipe(staff, "# nothing\n")
    out = clean(staff, 'combine_columns(columns=["id", "Unit"], new_name="x")')
    assert out.collect()[1]["x"] == "2 Desk"
    assert clean(staff.union(staff), "dedup_rows()").count() == 4
    nested = table("a array<int>, b string, c string", ([1], "x", "y"))
    with pytest.raises(StepError, match="no text form"):
        apply_recipe(nested, 'trim_collapse(columns=["a"])')


def test_unknown_extra_parameters_are_ignored(staff):
    out = clean(staff, 'trim_collapse(columns=["Unit"], colour="red")')
    assert out.first()["Unit"] == "Field Crew"


def test_cleaning_is_not_repeated(table):
    df = table("a string, d string", (" x   y ", "Mar  1, 2019 "), (None, " "))
    recipe = """
        trim_collapse(columns=["a", "d"])
        trim_collapse(columns=["a"])
        rename_single(column="a", new_name="b")
        split_column(column="b")
        trim_collapse(columns=["b_1", "b_2"])
        date_only(column="d")
    """
    out = apply_recipe(df, recipe).df
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(?U)\\s+") == 2  # once per column
    assert [tuple(r) for r in out.collect()] == [
        (date(2019, 3, 1), "x", "y"),
        (None, None, None),
    ]
    # what a later step makes of a column is cleaned again
    recipe = """
        trim_collapse(columns=["a"])
        combine_columns(columns=["a", "d"], new_name="c", separator="  ")
        remove_columns(columns=["a"])
        rename_single(column="c", new_name="a")
        trim_collapse(columns=["a"])
    """
    assert [r["a"] for r in clean(df, recipe).collect()] == ["x y Mar 1, 2019", ""]
