"""Keep the last row per key of a stream.

Each micro-batch reduces its rows to one per key and writes them to its own
partition of a log table. Writing a batch again replaces that partition, so a
restart after a failure changes nothing. Readers take the last row per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tablecare.operators.dedup import dedup_rows

_BATCH = "__batch__"


def keep_last(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    log: str,
    checkpoint: str,
) -> DataStreamWriter:
    """Log the last row per key of each micro-batch; call ``start`` on the result."""

    def append(batch: DataFrame, batch_id: int) -> None:
        last = dedup_rows(batch, columns, "last", order_by)
        last.write.mode("overwrite").parquet(f"{log}/{_BATCH}={batch_id}")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)


def read_last(
    spark: SparkSession, log: str, columns: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """The last row per key over all batches logged so far."""
    rows = spark.read.parquet(log).drop(_BATCH)
    return dedup_rows(rows, columns, "last", order_by)


def compact(
    spark: SparkSession,
    log: str,
    target: str,
    columns: Sequence[str],
    order_by: Sequence[str],
) -> None:
    """Write the current last rows as a log of their own, one row per key."""
    rows = read_last(spark, log, columns, order_by)
    rows.write.mode("errorifexists").parquet(f"{target}/{_BATCH}=-1")
