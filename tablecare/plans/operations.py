"""The operations a recipe can name: parameters, schema check, application."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablecare.functions.columns import ROW_ORDER, visible
from tablecare.functions.text import has_text_form
from tablecare.operators.columns import remove_columns, rename_single
from tablecare.operators.dates import date_normalize, date_only
from tablecare.operators.dedup import KEEP_CHOICES, dedup_rows
from tablecare.operators.text import (
    MAX_WIDTH,
    combine_columns,
    piece_names,
    split_column,
    trim_collapse,
)
from tablecare.plans.recipe import Step


class StepError(ValueError):
    """A step that cannot be performed on this table."""


@dataclass
class Shape:
    """Column names and types a table would have; needs no job to follow.

    The pieces of a split are unknown until its width is: until then any
    ``{column}_{n}`` counts as present.
    """

    types: dict[str, T.DataType]
    open_splits: set[str] = field(default_factory=set)

    @classmethod
    def of(cls, df: DataFrame) -> Shape:
        return cls({c: df.schema[c].dataType for c in visible(df)})

    def _may_be_piece(self, name: str) -> bool:
        prefix, _, number = name.rpartition("_")
        return prefix in self.open_splits and bool(re.fullmatch(r"[1-9]\d*", number))

    def column(self, name: Any) -> str:
        if isinstance(name, str) and name != ROW_ORDER:
            if name in self.types:
                return name
            if self._may_be_piece(name):
                self.types[name] = T.StringType()
                return name
        raise StepError(f"there is no column {name!r}")

    def columns(self, names: Any, at_least: int = 1) -> list[str]:
        if not isinstance(names, (list, tuple)):
            raise StepError(f"expected a list of columns, not {names!r}")
        found = [self.column(n) for n in names]
        if len(set(found)) < at_least:
            raise StepError(f"needs at least {at_least} different column(s)")
        return found

    def text_columns(self, names: Any, at_least: int = 1) -> list[str]:
        found = self.columns(names, at_least)
        for name in found:
            if not has_text_form(self.types[name]):
                kind = self.types[name].simpleString()
                raise StepError(f"column {name!r} of type {kind} has no text form")
        return found

    def new_name(self, name: Any) -> str:
        if not isinstance(name, str) or not name:
            raise StepError("a new column name is required")
        if name in self.types or name == ROW_ORDER:
            raise StepError(f"a column {name!r} already exists")
        return name


def _flag(value: Any, name: str) -> None:
    if not isinstance(value, bool):
        raise StepError(f"{name} must be true or false")


def _check_date(shape: Shape, p: dict[str, Any], result: T.DataType) -> None:
    column = shape.column(p["column"])
    shape.text_columns([column])
    _flag(p["day_first"], "day_first")
    if not isinstance(p["formats"], (list, tuple)):
        raise StepError("formats must be a list of datetime patterns")
    shape.types[column] = result


def _check_trim(shape: Shape, p: dict[str, Any]) -> None:
    for column in shape.text_columns(p["columns"]):
        shape.types[column] = T.StringType()


def _check_combine(shape: Shape, p: dict[str, Any]) -> None:
    shape.text_columns(p["columns"], at_least=2)
    if not isinstance(p["separator"], str):
        raise StepError("separator must be text")
    shape.types[shape.new_name(p["new_name"])] = T.StringType()


def _check_split(shape: Shape, p: dict[str, Any]) -> None:
    column = shape.text_columns([p["column"]])[0]
    if not isinstance(p["delimiter"], str):
        raise StepError("delimiter must be text")
    width = p["width"]
    if width is not None and (not isinstance(width, int) or width < 1):
        raise StepError("width must be a whole number of at least 1")
    most = p["max_width"]
    if not isinstance(most, int) or most < 1:
        raise StepError("max_width must be a whole number of at least 1")
    del shape.types[column]
    if width is None:
        shape.open_splits.add(column)
    else:
        for name in piece_names(column, width):
            shape.types[shape.new_name(name)] = T.StringType()


def _check_remove(shape: Shape, p: dict[str, Any]) -> None:
    for column in set(shape.columns(p["columns"])):
        del shape.types[column]


def _check_dedup(shape: Shape, p: dict[str, Any]) -> None:
    keys = shape.columns(p["columns"], at_least=0) or list(shape.types)
    shape.columns(p["order_by"], at_least=0)
    if p["keep"] not in KEEP_CHOICES:
        raise StepError(f"keep must be one of {', '.join(KEEP_CHOICES)}")
    maps = [k for k in keys if isinstance(shape.types[k], T.MapType)]
    if maps:
        raise StepError(f"map columns cannot be compared: {maps}")


def _check_rename(shape: Shape, p: dict[str, Any]) -> None:
    column = shape.column(p["column"])
    if p["new_name"] == column:
        return
    new_name = shape.new_name(p["new_name"])
    shape.types = {
        new_name if name == column else name: dtype
        for name, dtype in shape.types.items()
    }


_REQUIRED = object()


@dataclass(frozen=True)
class Operation:
    """``defaults`` lists all parameters; other ones in a recipe are ignored."""

    key: str
    title: str
    defaults: dict[str, Any]
    check: Callable[[Shape, dict[str, Any]], None]
    apply: Callable[..., DataFrame]

    def complete(self, params: dict[str, Any]) -> dict[str, Any]:
        full = {n: params.get(n, default) for n, default in self.defaults.items()}
        for name, value in full.items():
            if value is _REQUIRED:
                raise StepError(f"parameter {name!r} is missing")
        return full


def _operation(key, title, check, apply, **defaults) -> Operation:
    return Operation(key, title, defaults, check, apply)


# The keys are fixed values: recipes are written with them.
OPERATIONS: dict[str, Operation] = {
    op.key: op
    for op in (
        _operation(
            "date_normalize",
            "normalize datetimes",
            lambda shape, p: _check_date(shape, p, T.TimestampNTZType()),
            date_normalize,
            column=_REQUIRED,
            day_first=False,
            formats=(),
        ),
        _operation(
            "date_only",
            "normalize dates",
            lambda shape, p: _check_date(shape, p, T.DateType()),
            date_only,
            column=_REQUIRED,
            day_first=False,
            formats=(),
        ),
        _operation(
            "trim_collapse",
            "trim white space",
            _check_trim,
            trim_collapse,
            columns=_REQUIRED,
        ),
        _operation(
            "combine_columns",
            "combine columns",
            _check_combine,
            combine_columns,
            columns=_REQUIRED,
            separator=" ",
            new_name=_REQUIRED,
        ),
        _operation(
            "split_column",
            "split a column",
            _check_split,
            split_column,
            column=_REQUIRED,
            delimiter="",
            width=None,
            max_width=MAX_WIDTH,
        ),
        _operation(
            "remove_columns",
            "remove columns",
            _check_remove,
            remove_columns,
            columns=_REQUIRED,
        ),
        _operation(
            "dedup_rows",
            "deduplicate rows",
            _check_dedup,
            dedup_rows,
            columns=(),
            keep="first",
            order_by=(),
        ),
        _operation(
            "rename_single",
            "rename a column",
            _check_rename,
            rename_single,
            column=_REQUIRED,
            new_name=_REQUIRED,
        ),
    )
}


def check_step(shape: Shape, step: Step, number: int, total: int) -> dict[str, Any]:
    """Complete parameters of a step; ``shape`` moves on to its result."""
    operation = OPERATIONS.get(step.key)
    if operation is None:
        raise StepError(f"step {number} of {total}: unknown operation {step.key!r}")
    try:
        params = operation.complete(step.params)
        operation.check(shape, params)
    except StepError as problem:
        raise StepError(
            f"step {number} of {total} ({operation.title}) failed: {problem}"
        ) from None
    return params


def check_steps(shape: Shape, steps: Sequence[Step]) -> None:
    """Accept or refuse a whole recipe from the schema alone; runs no job."""
    for number, step in enumerate(steps, start=1):
        check_step(shape, step, number, len(steps))
