"""T7, its order rules, and what it sends over the shuffle."""

import pytest
from pyspark.sql import functions as F

from tablecare import dedup_rows, read_table
from tablecare.functions.columns import ROW_ORDER


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_subset_and_all(table):
    df = table("a bigint, b bigint", (1, 1), (1, 2), (2, 2))
    assert rows(dedup_rows(df, ["a"], "first", ["b"])) == [(1, 1), (2, 2)]
    assert rows(dedup_rows(df, ["a"], "last", ["b"])) == [(1, 2), (2, 2)]
    assert dedup_rows(df, []).count() == 3
    assert dedup_rows(df.union(df), []).count() == 3
    assert dedup_rows(df.union(df), ["b", "a"]).count() == 3


def test_null_keys_are_one_group(table):
    df = table("k string, v bigint", (None, 1), (None, 2), ("x", 3))
    assert rows(dedup_rows(df, ["k"], "first", ["v"])) == [("x", 3), (None, 1)]


def test_row_without_order_is_refused(table):
    df = table("a bigint, b bigint", (1, 1))
    with pytest.raises(ValueError, match="order_by"):
        dedup_rows(df, ["a"])
    with pytest.raises(ValueError, match="keep"):
        dedup_rows(df, ["a"], "any", ["b"])


def test_map_keys_are_refused(spark):
    df = spark.sql("select map('a', 1) as m, 1 as n")
    with pytest.raises(ValueError, match="map"):
        dedup_rows(df, [])
    assert dedup_rows(df, ["n"], "first", ["n"]).count() == 1


def test_source_order_of_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n" + "".join(f"{i % 3},{i}\n" for i in range(9)))
    (tmp_path / "b.csv").write_text("k,v\n" + "".join(f"{i % 3},{i}\n" for i in range(9, 18)))
    df = read_table(spark, str(tmp_path), "csv", row_order=True)
    first = dedup_rows(df, ["k"], "first").drop(ROW_ORDER)
    last = dedup_rows(df, ["k"], "last").drop(ROW_ORDER)
    assert rows(first) == [(0, 0), (1, 1), (2, 2)]
    assert rows(last) == [(0, 15), (1, 16), (2, 17)]


def test_whole_rows_keep_their_order_for_later_steps(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,1\n1,1\n1,2\n")
    df = read_table(spark, str(tmp_path / "a.csv"), row_order=True)
    distinct = dedup_rows(df, [])
    assert ROW_ORDER in distinct.columns and distinct.count() == 2
    assert rows(dedup_rows(distinct, ["k"], "last").drop(ROW_ORDER)) == [(1, 2)]


def test_hot_key_matches_brute_force(spark):
    """A third of all rows share one key."""
    df = spark.range(30_000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 500).alias("k"),
        F.col("id").alias("n"),
    )
    first, last = {}, {}
    for n in range(30_000):
        k = -1 if n % 3 == 0 else n % 500
        first.setdefault(k, n)
        last[k] = n
    assert dict(dedup_rows(df, ["k"], "first", ["n"]).collect()) == first
    assert dict(dedup_rows(df, ["k"], "last", ["n"]).collect()) == last
