"""Every registered query against its DuckDB counterpart, on whole tables."""

import glob
import math
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as registered  # noqa: E402


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return list(value) if isinstance(value, (list, tuple)) else value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


OWN = [name for name in registered.queries() if name.startswith("q_")]


def test_every_query_has_an_oracle():
    assert set(OWN) <= set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, sf_dir, name):
    df = registered.queries()[name](spark, sf_dir)
    oracle = duck.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in oracle.description]
    assert sorted(df.columns) == sorted(columns)
    mine = _table(df.columns, map(tuple, df.collect()))
    theirs = _table(columns, oracle.fetchall())
    assert len(mine) == len(theirs) > 0
    assert mine == theirs


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def test_documents_are_written_as_csv_by_many_tasks(spark, sf_dir, tmp_path, monkeypatch):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    documents.repartition(4, "doc_id").write.parquet(f"{tmp_path}/sf/documents.parquet")
    monkeypatch.setattr(registered, "scratch_path", lambda _, name: f"{tmp_path}/{name}")
    found = registered.q_csv_splits(spark, f"{tmp_path}/sf")
    assert len(glob.glob(f"{tmp_path}/splits.csv/part-*")) == 4
    rows = documents.select("doc_id", "text", "lang").collect()
    assert _table(found.columns, found.collect()) == _table(found.columns, rows)
