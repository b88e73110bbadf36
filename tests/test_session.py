"""Results do not depend on the session they are asked in."""

from datetime import datetime

import pandas as pd
import pytest

from tablecare import date_normalize, rename_single, write_table
from tablecare.session import REQUIRED_SETTINGS, configure, scratch_path


@pytest.fixture
def foreign(spark):
    """A session with other settings, as somebody else may have made it."""
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    spark.conf.set("spark.sql.caseSensitive", "false")
    yield spark
    configure(spark)


def test_operators_set_what_they_need(foreign):
    df = foreign.createDataFrame([("2020-01-01T10:00:00+02:00",)], "d string")
    assert date_normalize(df, "d").first()["d"] == datetime(2020, 1, 1, 8)
    assert {k: foreign.conf.get(k) for k in REQUIRED_SETTINGS} == REQUIRED_SETTINGS


def test_names_that_differ_in_case(foreign):
    df = foreign.range(1).selectExpr("id as a")
    assert rename_single(df, "a", "B").columns == ["B"]
    assert foreign.conf.get("spark.sql.caseSensitive") == "true"


def test_times_in_the_gap_of_a_local_clock(foreign, tmp_path):
    df = foreign.sql("select timestamp_ntz'2021-03-14 02:30:00' as t")
    write_table(df, str(tmp_path / "o.csv"))
    back = foreign.read.csv(str(tmp_path / "o.csv"), header=True)
    assert back.first()["t"] == "2021-03-14T02:30:00"


class Session:
    """As much of a session as ``scratch_path`` asks for."""

    def __init__(self, master, **settings):
        self.conf = self
        self.get = settings.get
        self.sparkContext = self
        self.master = master


def test_scratch_is_below_the_shared_folder():
    shared = Session("yarn", **{"spark.checkpoint.dir": "hdfs://h/scratch/"})
    one, two = scratch_path(shared, "x"), scratch_path(shared, "x")
    assert one != two and one.startswith("hdfs://h/scratch/x-")


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_path(Session("yarn"), "x")
    assert "/x-" in scratch_path(Session("local[2]"), "x")


def test_batches_for_python_are_bounded_by_bytes(spark):
    """Ten thousand whole texts would make a batch of 100 MB."""
    configure(spark)
    texts = spark.range(3000, numPartitions=1).selectExpr("repeat('x', 10000) text")

    def sizes(batches):
        for batch in batches:
            yield pd.DataFrame({"n": [int(batch["text"].str.len().sum())]})

    held = [r.n for r in texts.mapInPandas(sizes, "n long").collect()]
    assert sum(held) == 30_000_000
    assert max(held) <= 5 << 20
