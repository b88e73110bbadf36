"""Fold a recipe into one plan, run it, and keep a record."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablecare.functions.columns import ROW_ORDER, col, visible
from tablecare.functions.text import is_blank_delimiter
from tablecare.operators.text import piece_names, split_width
from tablecare.plans.operations import (
    OPERATIONS,
    Shape,
    StepError,
    check_step,
    check_steps,
)
from tablecare.plans.recipe import Step, parse_recipe, recipe_hash
from tablecare.session import configure, configured
from tablecare.sinks.table import default_destination, write_table
from tablecare.sources.files import Paths, as_list
from tablecare.sources.formats import SEPARATORS, format_of
from tablecare.sources.table import read_table
from tablecare.sources.typing import LATE_VALUE

LINEAGE_SCHEMA = (
    "run_id string, recipe_hash string, recipe string, source array<string>, "
    "destination string, rows_in bigint, rows_out bigint, "
    "null_counts map<string,bigint>, finished_at timestamp_ntz"
)


def as_steps(recipe: str | Sequence[Step]) -> tuple[Step, ...]:
    steps = parse_recipe(recipe) if isinstance(recipe, str) else recipe
    if not steps:
        raise ValueError("the recipe contains no steps")
    return tuple(steps)


def _trimmed_after(step: Step, params: dict[str, Any], trimmed: set[str]) -> set[str]:
    """Columns known to be trimmed and collapsed once a step has been applied."""
    if step.key == "trim_collapse":
        return trimmed | set(params["columns"])
    if step.key == "remove_columns":
        return trimmed - set(params["columns"])
    if step.key == "combine_columns" or step.key == "dedup_rows":
        return trimmed
    column = params["column"]
    if step.key == "rename_single":
        moved = {params["new_name"]} if column in trimmed else set()
        return trimmed - {column} | moved
    if step.key == "split_column" and is_blank_delimiter(params["delimiter"]):
        return trimmed - {column} | set(piece_names(column, params["width"]))
    return trimmed - {column}


def _without_repeats(
    step: Step, params: dict[str, Any], trimmed: set[str]
) -> dict[str, Any]:
    """Arguments that spare an operator the cleaning an earlier step has done."""
    if step.key == "trim_collapse":
        return {"columns": [c for c in params["columns"] if c not in trimmed]}
    if step.key in ("date_normalize", "date_only", "split_column"):
        return {**params, "trimmed": params["column"] in trimmed}
    return params


def _fold(df: DataFrame, steps: Sequence[Step]) -> tuple[DataFrame, tuple[Step, ...]]:
    """Apply accepted steps; each split without a width is measured once."""
    done = []
    trimmed: set[str] = set()
    for number, step in enumerate(steps, start=1):
        params = check_step(Shape.of(df), step, number, len(steps))
        if step.key == "dedup_rows" and df.isStreaming:
            raise StepError(f"step {number}: deduplicate streams with streaming.tables")
        if step.key == "split_column" and params["width"] is None:
            if df.isStreaming:
                raise StepError(f"step {number}: a split on a stream needs a width")
            column = params["column"]
            params["width"] = split_width(
                df, column, params["delimiter"], column in trimmed
            )
            step = replace(step, params={**step.params, "width": params["width"]})
            # now that the pieces have names, they may clash with others
            check_step(Shape.of(df), step, number, len(steps))
        try:
            spared = _without_repeats(step, params, trimmed)
            df = OPERATIONS[step.key].apply(df, **spared)
        except ValueError as problem:
            title = OPERATIONS[step.key].title
            raise StepError(
                f"step {number} of {len(steps)} ({title}) failed: {problem}"
            ) from problem
        trimmed = _trimmed_after(step, params, trimmed)
        done.append(step)
    return df, tuple(done)


@dataclass(frozen=True)
class Cleaned:
    """A table with a recipe applied to it; lazy apart from split widths."""

    df: DataFrame
    steps: tuple[Step, ...]


@configured
def apply_recipe(
    df: DataFrame, recipe: str | Sequence[Step], upto: int | None = None
) -> Cleaned:
    """Apply the recipe, or its first ``upto`` steps, all-or-nothing.

    The whole recipe is checked against the schema before any job. The returned
    steps carry the widths found, so that a replay scans nothing again.
    """
    steps = as_steps(recipe)
    check_steps(Shape.of(df), steps)
    folded, done = _fold(df, steps[:upto])
    return Cleaned(folded, done + steps[len(done) :])


def clean(df: DataFrame, recipe: str | Sequence[Step]) -> DataFrame:
    """``apply_recipe`` for a caller who only wants the table."""
    cleaned = apply_recipe(df, recipe).df
    return cleaned.drop(ROW_ORDER)


def _wants_row_order(steps: Sequence[Step]) -> bool:
    """Whether some deduplication may pick one of several different rows."""
    return any(
        s.key == "dedup_rows" and s.params.get("columns") and not s.params.get("order_by")
        for s in steps
    )


@dataclass(frozen=True)
class RunReport:
    run_id: str
    destination: str
    steps: tuple[Step, ...]
    rows_in: int | None  # not counted if that took another pass over text files
    rows_out: int
    null_counts: dict[str, int]


def _touched(steps: Sequence[Step]) -> set[str]:
    names: set[str] = set()
    for step in steps:
        p = step.params
        names |= {p.get("column"), p.get("new_name"), *(p.get("columns") or ())}
        if step.key == "split_column":
            names |= {f"{p['column']}_{i + 1}" for i in range(p["width"])}
    return names - {None}


def write_observed(
    source: DataFrame,
    steps: tuple[Step, ...],
    write: Callable[[DataFrame], None],
    count_source: bool,
) -> tuple[int | None, int, dict[str, int]]:
    """Write and count in the same job: no further pass over the data."""
    shuffles = any(s.key == "dedup_rows" for s in steps)
    seen_in, seen_out = Observation(), Observation()
    rows_in = None
    if not shuffles:
        source = source.observe(seen_in, F.count(F.lit(1)).alias("rows"))
    elif count_source:
        # metrics of a shuffle stage may be counted again when it is repeated
        # after the loss of an executor, so this takes a count of its own
        rows_in = source.count()
    result = _fold(source, steps)[0]
    touched = [c for c in visible(result) if c in _touched(steps)]
    nulls = [
        F.count_if(col(c).isNull()).alias(f"nulls_{i}") for i, c in enumerate(touched)
    ]
    write(result.observe(seen_out, F.count(F.lit(1)).alias("rows"), *nulls))
    found = seen_out.get
    if not shuffles:
        rows_in = seen_in.get["rows"]
    return (
        rows_in,
        found["rows"],
        {c: found[f"nulls_{i}"] for i, c in enumerate(touched)},
    )


def run_recipe(
    spark: SparkSession,
    recipe: str | Sequence[Step],
    source: Paths,
    destination: str | None = None,
    source_format: str | None = None,
    destination_format: str | None = None,
    overwrite: bool = True,
    lineage: str | None = None,
    **read_options,
) -> RunReport:
    """Read a path, glob or list of them, apply the recipe, write the result.

    Nothing is written unless every step fits the table. Text is read with
    optimistic types: only if a late value breaks them is the job run again,
    with all columns as text. ``lineage`` is a Parquet table that gets one row
    per run. Other options are those of the source.
    """
    configure(spark)
    steps = as_steps(recipe)
    source_format = source_format or format_of(as_list(source))
    if destination is None:
        if len(as_list(source)) > 1 or set("*?[{") & set(as_list(source)[0]):
            raise ValueError("several sources need a destination of their own")
        destination = default_destination(as_list(source)[0])
        destination_format = destination_format or source_format
    destination_format = destination_format or format_of(destination)
    options = dict(read_options)
    if source_format in SEPARATORS:
        options.setdefault("late", "fail")

    def attempt(options: dict) -> tuple[tuple[Step, ...], tuple]:
        table = read_table(
            spark, source, source_format, _wants_row_order(steps), **options
        )
        check_steps(Shape.of(table), steps)
        resolved = _fold(table, steps)[1]
        return resolved, write_observed(
            table,
            resolved,
            lambda df: write_table(df, destination, destination_format, overwrite),
            count_source=lineage is not None or source_format == "parquet",
        )

    try:
        resolved, counts = attempt(options)
    except PySparkException as problem:
        if LATE_VALUE not in str(problem) or options.get("late") != "fail":
            raise
        if options.get("fallback", "file") == "file":
            options["types"] = "string"
        else:
            options["late"] = "scan"
        resolved, counts = attempt(options)
    report = RunReport(uuid.uuid4().hex, destination, resolved, *counts)
    if lineage:
        append_lineage(spark, lineage, report, as_list(source))
    return report


def append_lineage(
    spark: SparkSession, table: str, report: RunReport, source: Sequence[str]
) -> None:
    """One row about a finished run."""
    row = (
        report.run_id,
        recipe_hash(report.steps),
        "\n".join(s.line() for s in report.steps),
        list(source),
        report.destination,
        report.rows_in,
        report.rows_out,
        report.null_counts,
        datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None),
    )
    spark.createDataFrame([row], LINEAGE_SCHEMA).coalesce(1).write.mode(
        "append"
    ).parquet(table)
