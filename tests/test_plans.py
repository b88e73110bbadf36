"""What the plans look like: no Python, few shuffles, pruned scans."""

import re

import pytest

import __spark_entry__ as registered
from tablecare import apply_recipe, clean, dedup_rows, preview, profile

PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")
NO_SHUFFLE = [
    "q_date_normalize",
    "q_date_only",
    "q_trim_collapse",
    "q_combine",
    "q_combine_double",
    "q_split_whitespace",
    "q_split_exact",
    "q_remove",
    "q_rename",
    "q_text_datetime",
]
ONE_SHUFFLE = ["q_dedup_first", "q_dedup_last", "q_dedup_all", "q_dedup_documents"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def nodes(text, name):
    return len(re.findall(rf"\b{name}\b", text))


@pytest.mark.parametrize("name", [*NO_SHUFFLE, *ONE_SHUFFLE, "q_profile", "q_preview"])
def test_operators_stay_in_the_jvm(spark, sf_dir, name):
    text = plan(registered.queries()[name](spark, sf_dir))
    assert not any(node in text for node in PYTHON)


@pytest.mark.parametrize("name", NO_SHUFFLE)
def test_column_operators_do_not_shuffle(spark, sf_dir, name):
    assert nodes(plan(registered.queries()[name](spark, sf_dir)), "Exchange") == 0


@pytest.mark.parametrize("name", ONE_SHUFFLE)
def test_dedup_shuffles_once_and_reduces_before(spark, sf_dir, name):
    text = plan(registered.queries()[name](spark, sf_dir))
    assert nodes(text, "Exchange") == 1
    before = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in before or "HashAggregate" in before


def test_profile_reads_once(spark, sf_dir):
    text = plan(profile(spark.read.parquet(f"{sf_dir}/orders.parquet")))
    assert nodes(text, "FileScan") == 1 and nodes(text, "Exchange") == 1


def test_sampled_profile_sorts_nothing_globally(spark, sf_dir):
    text = plan(registered.q_profile_sampled(spark, sf_dir))
    assert "rangepartitioning" not in text
    # one for the nulls, one for the samples of all columns
    assert nodes(text, "FileScan") == 2
    assert "WindowGroupLimit" in text


def test_preview_is_a_top_k(spark, sf_dir):
    text = plan(preview(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderkey"]))
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text.split("TakeOrderedAndProject")[1]


def test_removed_columns_leave_the_scan(spark, sf_dir):
    text = plan(registered.q_remove(spark, sf_dir))
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "c_acctbal" not in schema and "c_nationkey" not in schema


def test_filters_reach_the_scan_through_a_recipe(spark, sf_dir):
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    cleaned = clean(
        customer,
        'trim_collapse(columns=["c_name"])\nrename_single(column="c_custkey", new_name="k")',
    )
    text = plan(cleaned.where("k > 10").select("k"))
    assert "GreaterThan(c_custkey,10)" in text
    assert "c_name" not in re.search(r"ReadSchema: struct<(.*?)>", text).group(1)


def test_chains_are_one_stage(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = plan(apply_recipe(part, registered.PART_RECIPE).df)
    assert nodes(text, "Exchange") == 0
    assert nodes(text, "FileScan") == 1


def test_row_order_is_read_only_when_needed(spark, sf_dir, tmp_path):
    from tablecare import read_table

    path = f"{sf_dir}/events.parquet"
    assert "row_index" not in plan(read_table(spark, path))
    assert "row_index" in plan(
        dedup_rows(read_table(spark, path, row_order=True), ["user_id"])
    )

