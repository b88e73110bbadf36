"""Recipes over streams agree with batch once all input has been read."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecare import StepError, apply_recipe, clean, dedup_rows, read_table, write_table
from tablecare.streaming.latest import compact, keep_last, read_last
from tablecare.streaming.recipes import compact_stream_run, read_stream_run, run_stream
from tablecare.streaming.tables import dedup_first, read_stream, write_stream

RECIPE = """
    trim_collapse(columns=["p_name"])
    split_column(column="p_name", width=3)
    combine_columns(columns=["p_brand", "p_size"], new_name="label", separator="-")
    remove_columns(columns=["p_type"])
    rename_single(column="p_name_1", new_name="first")
"""


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def finish(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.fixture
def events(spark, sf_dir, tmp_path):
    """Events in six files, so that a stream takes several batches."""
    path = str(tmp_path / "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(6).write.parquet(path)
    return spark.read.parquet(path), path


def test_recipe_on_a_stream(spark, sf_dir, tmp_path):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    stream = read_stream(spark, sf_dir, "parquet", part.schema, glob="part.parquet")
    out = str(tmp_path / "o")
    finish(
        write_stream(
            apply_recipe(stream, RECIPE).df, out, "parquet", str(tmp_path / "c")
        )
    )
    assert rows(spark.read.parquet(out)) == rows(clean(part, RECIPE))


def test_text_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text('id,d\n1,"Mar 1, 2019"\n2,\n')
    (source / "b.csv").write_text('id,d\n3,""\n4,2020/01/02\n')
    schema = T.StructType().add("id", T.LongType()).add("d", T.StringType())
    stream = read_stream(spark, str(source), "csv", schema)
    out = str(tmp_path / "o")
    cleaned = apply_recipe(stream, 'date_normalize(column="d")').df
    finish(write_stream(cleaned, out, "csv", str(tmp_path / "c")))
    assert rows(read_table(spark, out, "csv")) == [
        (1, "2019-03-01T00:00:00"),
        (2, None),
        (3, None),
        (4, "2020-01-02T00:00:00"),
    ]


@pytest.mark.parametrize("line,problem", [("5,x,y", "more than 2"), ("x,y", "LATE_VALUE")])
def test_text_that_does_not_fit_fails_the_stream(spark, tmp_path, line, problem):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(f"id,d\n1,2\n{line}\n")
    schema = T.StructType().add("id", T.LongType()).add("d", T.StringType())
    stream = read_stream(spark, str(tmp_path / "in"), "csv", schema)
    writer = write_stream(stream, str(tmp_path / "o"), "parquet", str(tmp_path / "c"))
    with pytest.raises(Exception, match=problem):
        finish(writer)


def test_json_stream(spark, table, tmp_path):
    source = str(tmp_path / "in.jsonl")
    write_table(table("a bigint, s string", (1, " x "), (2, None)), source)
    schema = T.StructType().add("a", T.LongType()).add("s", T.StringType())
    stream = read_stream(spark, source, "jsonl", schema)
    cleaned = apply_recipe(stream, 'trim_collapse(columns=["s"])').df
    out = str(tmp_path / "o")
    finish(write_stream(cleaned, out, "jsonl", str(tmp_path / "c")))
    assert rows(read_table(spark, out, "jsonl")) == [(1, "x"), (2, None)]


def test_steps_that_a_stream_cannot_do(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/part.parquet").schema
    stream = read_stream(spark, sf_dir, "parquet", schema, glob="part.parquet")
    with pytest.raises(StepError, match="needs a width"):
        apply_recipe(stream, 'split_column(column="p_name")')
    with pytest.raises(StepError, match="streams"):
        apply_recipe(stream, "dedup_rows()")
    with pytest.raises(ValueError, match="cannot be streamed"):
        read_stream(spark, sf_dir, "xlsx", schema)


def test_keep_first_by_arrival(spark, events, tmp_path):
    batch, path = events
    stream = read_stream(spark, path, "parquet", batch.schema, max_files_per_trigger=1)
    out = str(tmp_path / "o")
    keys = ["user_id", "event_type"]
    first = dedup_first(stream, keys, "ts", "3650 days")
    finish(write_stream(first, out, "parquet", str(tmp_path / "c")))
    kept = spark.read.parquet(out)
    assert kept.count() == batch.select(*keys).distinct().count()
    assert kept.select(*keys).distinct().count() == kept.count()


def test_keep_last(spark, events, tmp_path):
    batch, path = events
    stream = read_stream(spark, path, "parquet", batch.schema, max_files_per_trigger=1)
    keys, order, log = ["user_id", "event_type"], ["event_id"], str(tmp_path / "log")
    query = finish(keep_last(stream, keys, order, log, str(tmp_path / "c")))
    assert len(query.recentProgress) > 1
    expected = rows(dedup_rows(batch, keys, "last", order))
    assert rows(read_last(spark, log, keys, order)) == expected
    compact(spark, log, str(tmp_path / "log2"), keys, order)
    assert rows(spark.read.parquet(str(tmp_path / "log2")).drop("__batch__")) == expected
    assert rows(read_last(spark, str(tmp_path / "log2"), keys, order)) == expected


DEDUP_RECIPE = """
    date_normalize(column="ts")
    rename_single(column="event_type", new_name="kind")
    dedup_rows(columns=["user_id", "kind"], keep="last", order_by=["event_id"])
    remove_columns(columns=["props"])
    dedup_rows(columns=["kind"], keep="first", order_by=["user_id"])
"""


@pytest.mark.parametrize("recipe", [DEDUP_RECIPE, 'remove_columns(columns=["event_id", "ts", "value", "props"])\ndedup_rows()', 'trim_collapse(columns=["props"])'])
def test_run_with_dedup_equals_the_batch(spark, events, tmp_path, recipe):
    batch, path = events
    log, lineage = str(tmp_path / "log"), str(tmp_path / "lineage")

    def run():
        stream = read_stream(spark, path, "parquet", batch.schema, max_files_per_trigger=2)
        finish(run_stream(stream, recipe, log, str(tmp_path / "c"), lineage))

    run()
    assert rows(read_stream_run(spark, log, recipe)) == rows(clean(batch, recipe))
    compact_stream_run(spark, log, recipe)
    assert rows(read_stream_run(spark, log, recipe)) == rows(clean(batch, recipe))
    # a restart takes new files up where the first run ended
    more = batch.limit(300).withColumn("event_id", F.col("event_id") + 10**6)
    more.repartition(3).write.mode("append").parquet(path)
    whole = spark.read.parquet(path)
    run()
    run()
    assert rows(read_stream_run(spark, log, recipe)) == rows(clean(whole, recipe))
    compact_stream_run(spark, log, recipe)
    compact_stream_run(spark, log, recipe)
    assert rows(read_stream_run(spark, log, recipe)) == rows(clean(whole, recipe))
    kept = sorted(p.name.split("-")[0] for p in (tmp_path / "log").iterdir())
    assert kept == ["base=2", "base=4", "batch=3", "batch=4"]
    record = spark.read.parquet(lineage)
    assert sorted(r.batch_id for r in record.collect()) == [0, 1, 2, 3, 4]
    assert record.agg(F.sum("rows_in")).first()[0] == whole.count()


def test_a_repeated_batch_replaces_itself(spark, events, tmp_path):
    """A stream whose last commit is lost runs that batch again, also after a compaction."""
    batch, path = events
    log, progress = str(tmp_path / "log"), tmp_path / "c"
    for _ in range(2):
        stream = read_stream(spark, path, "parquet", batch.schema, max_files_per_trigger=3)
        finish(run_stream(stream, DEDUP_RECIPE, log, str(progress), str(tmp_path / "lineage")))
        compact_stream_run(spark, log, DEDUP_RECIPE)
        for name in ("1", ".1.crc"):
            (progress / "commits" / name).unlink()
    assert rows(read_stream_run(spark, log, DEDUP_RECIPE)) == rows(clean(batch, DEDUP_RECIPE))
    assert spark.read.parquet(str(tmp_path / "lineage")).count() == 2


def test_stream_runs_that_are_refused(spark, events, tmp_path):
    batch, path = events
    stream = read_stream(spark, path, "parquet", batch.schema)
    for recipe, problem in (
        ('dedup_rows(columns=["user_id"])', "order_by"),
        ('split_column(column="props")', "needs a width"),
        ('trim_collapse(columns=["none"])', "none"),
    ):
        with pytest.raises(StepError, match=problem):
            run_stream(stream, recipe, str(tmp_path / "l"), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="no batch"):
        read_stream_run(spark, str(tmp_path / "l"), "dedup_rows()")
