"""A whole recipe, deduplication included, over a stream, with a record of each batch.

A recipe is cut after its first deduplication. Each micro-batch runs the first part and
writes its rows, one per key, to a folder of its own in a log; ``read_stream_run``
deduplicates once more over all of them and applies the rest, so that the result is
that of a batch run over all input so far. Deduplicating parts before the whole changes
nothing, since ``order_by`` and the columns after it decide which row of a key stays.

The log is ``batch=<id>`` folders and ``base=<id>-...`` folders, which stand for all
batches up to theirs. A folder counts once it is complete. ``compact_stream_run`` writes a
base beside a running stream and deletes what the base before it stood for already, so
that a log holds the keys at most twice, and the latest batches.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tablecare.functions.columns import col
from tablecare.plans.operations import Shape, StepError, check_steps
from tablecare.plans.recipe import Step, recipe_hash
from tablecare.plans.run import apply_recipe, as_steps, write_observed
from tablecare.session import configure
from tablecare.sinks.publish import locate

BATCH_LINEAGE_SCHEMA = (
    "query_id string, batch_id bigint, recipe_hash string, recipe string, log string, rows_in bigint, "
    "rows_out bigint, null_counts map<string,bigint>, finished_at timestamp_ntz"
)
_FOLDER = re.compile(r"(batch|base)=(\d+)(?:-[0-9a-f]+)?")


def _cut(steps: Sequence[Step]) -> int:
    """How many steps a micro-batch runs: up to the first deduplication."""
    return next((n for n, s in enumerate(steps, start=1) if s.key == "dedup_rows"), len(steps))


def run_stream(
    df: DataFrame,
    recipe: str | Sequence[Step],
    log: str,
    checkpoint: str,
    lineage: str | None = None,
) -> DataStreamWriter:
    """Run a recipe over a stream into a log; call ``start`` on the result.

    The recipe is checked before the stream starts. Splits up to the first deduplication
    need a width, deduplications of a key an ``order_by``. A batch that is
    repeated after a failure replaces its folder and its row of ``lineage``, a
    table with a row per batch.
    """
    configure(df.sparkSession)
    steps = as_steps(recipe)
    check_steps(Shape.of(df), steps)
    head = steps[: _cut(steps)]
    for number, step in enumerate(steps, start=1):
        keyed = step.key == "dedup_rows" and step.params.get("columns")
        if keyed and not step.params.get("order_by"):
            raise StepError(f"step {number}: on a stream, name the order of rows (order_by)")
        if step in head and step.key == "split_column" and step.params.get("width") is None:
            raise StepError(f"step {number}: a split on a stream needs a width")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write = partial(_replace, path=f"{log}/batch={batch_id}")
        counts = write_observed(batch, head, write, count_source=lineage is not None)
        if lineage:
            row = (
                spark.sparkContext.getLocalProperty("sql.streaming.queryId"),
                batch_id,
                recipe_hash(steps),
                "\n".join(s.line() for s in steps),
                log,
                *counts,
                datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None),
            )
            record = spark.createDataFrame([row], BATCH_LINEAGE_SCHEMA).coalesce(1)
            _replace(record.drop("batch_id"), f"{lineage}/batch_id={batch_id}")

    return df.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)


def _replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _folders(spark: SparkSession, log: str) -> list[tuple[str, int, str]]:
    """Kind, last batch and name of the complete folders, in order of their batches."""
    file_system, root = locate(spark, log)
    if not file_system.exists(root):
        return []
    jvm = spark.sparkContext._jvm
    names = [s.getPath().getName() for s in file_system.listStatus(root)]
    found = [(m[1], int(m[2]), n) for n in names if (m := _FOLDER.fullmatch(n))]
    return sorted(
        f for f in found
        if file_system.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{f[2]}/_SUCCESS"))
    )


def _current(spark: SparkSession, log: str) -> tuple[DataFrame, int]:
    """The rows that stand for all batches so far, and the last of these batches."""
    folders = _folders(spark, log)
    bases = [f for f in folders if f[0] == "base"]
    since = bases[-1][1] if bases else -1
    batches = [f for f in folders if f[0] == "batch" and f[1] > since]
    if not bases and not batches:
        raise ValueError(f"no batch has been written to {log} yet")
    names = [f[2] for f in [*bases[-1:], *batches]]
    schema = spark.read.parquet(f"{log}/{names[0]}").schema
    rows = spark.read.schema(schema).parquet(*[f"{log}/{n}" for n in names])
    return rows, max([since, *(f[1] for f in batches)])


def read_stream_run(spark: SparkSession, log: str, recipe: str | Sequence[Step]) -> DataFrame:
    """The result of the recipe over all batches in the log so far."""
    configure(spark)
    steps = as_steps(recipe)
    rows, _ = _current(spark, log)
    cut = _cut(steps)
    rest = steps[cut - 1 :] if steps[cut - 1].key == "dedup_rows" else ()
    return apply_recipe(rows, rest).df if rest else rows


def compact_stream_run(spark: SparkSession, log: str, recipe: str | Sequence[Step]) -> None:
    """Put the batches so far into one base, also while the stream runs.

    Readers that began before stay valid, as only folders that the previous base stands
    for are deleted.
    """
    configure(spark)
    steps = as_steps(recipe)
    before = [f for f in _folders(spark, log) if f[0] == "base"]
    rows, last = _current(spark, log)
    if before and before[-1][1] == last:
        return
    cut = _cut(steps)
    if steps[cut - 1].key == "dedup_rows":
        rows = apply_recipe(rows, steps[cut - 1 : cut]).df
    name = f"base={last}-{uuid.uuid4().hex}"
    rows.select(*[col(c) for c in rows.columns]).write.parquet(f"{log}/{name}")
    if before:
        file_system, root = locate(spark, log)
        jvm = spark.sparkContext._jvm
        for kind, batch, old in _folders(spark, log):
            if batch < before[-1][1] or kind == "batch" and batch == before[-1][1]:
                file_system.delete(jvm.org.apache.hadoop.fs.Path(f"{root}/{old}"), True)
