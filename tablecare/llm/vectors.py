"""What the vector operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measurable(vectors: DataFrame) -> DataFrame:
    """The rows whose ``embedding`` (as doubles) is not null or empty, has no null or
    non-finite component, and is not zero."""
    rows = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    infinite = float("inf")
    good = (
        (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: F.coalesce(F.abs(x) < infinite, F.lit(False)))
        & F.exists("embedding", lambda x: x != 0)
    )
    return rows.where(F.coalesce(good, F.lit(False)))


def usable(vectors: DataFrame) -> DataFrame:
    """The ``measurable`` rows that are as long as most (ties: the shorter)."""
    rows = measurable(vectors)
    sizes = rows.groupBy(F.size("embedding").alias("size")).count()
    usual = sizes.orderBy(F.desc("count"), "size").select("size").first()
    return rows.where(F.size("embedding") == (usual["size"] if usual else 0))
