"""Clean tabular data at scale: recipes of column and row operations on Spark."""

import sys

from pyspark import cloudpickle

from tablecare.functions.columns import ROW_ORDER
from tablecare.operators.columns import remove_columns, rename_single
from tablecare.operators.dates import date_normalize, date_only
from tablecare.operators.dedup import dedup_rows
from tablecare.operators.preview import preview
from tablecare.operators.profile import profile
from tablecare.operators.text import combine_columns, split_column, trim_collapse
from tablecare.plans.operations import StepError
from tablecare.plans.recipe import (
    Step,
    parse_recipe,
    read_recipe,
    recipe_text,
    write_recipe,
)
from tablecare.plans.run import Cleaned, RunReport, apply_recipe, clean, run_recipe
from tablecare.session import configure
from tablecare.sinks.table import write_table
from tablecare.sources.formats import format_of
from tablecare.sources.table import read_table

# The few Python functions that run in tasks travel with them, so that executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ROW_ORDER",
    "Cleaned",
    "RunReport",
    "Step",
    "StepError",
    "apply_recipe",
    "clean",
    "combine_columns",
    "configure",
    "date_normalize",
    "date_only",
    "dedup_rows",
    "format_of",
    "parse_recipe",
    "preview",
    "profile",
    "read_recipe",
    "read_table",
    "recipe_text",
    "remove_columns",
    "rename_single",
    "run_recipe",
    "split_column",
    "trim_collapse",
    "write_recipe",
    "write_table",
]
