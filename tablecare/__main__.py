"""``spark-submit``-able run of a recipe: ``python -m tablecare FILE --recipe R``."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from tablecare.plans.recipe import read_recipe
from tablecare.plans.run import as_steps, run_recipe
from tablecare.sources.formats import format_of


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tablecare", description=__doc__)
    parser.add_argument("source", help="file, folder or glob to clean")
    parser.add_argument("-s", "--recipe", required=True, help="recipe file")
    parser.add_argument("-o", "--output", help="default: beside the source")
    parser.add_argument("--format", help="source format, if its suffix does not tell")
    parser.add_argument("--lineage", help="Parquet table that gets a row per run")
    parser.add_argument("--charset", help="of text sources, if not UTF-8")
    parser.add_argument(
        "--types", help='of delimited sources: "string", or JSON of a type name per column'
    )
    parser.add_argument(
        "--fallback", choices=("file", "column"), help="what becomes text when a late value misfits"
    )
    parser.add_argument("--recursive", action="store_true", help="read folders below the source")
    parser.add_argument("--output-format", help="if the suffix of the output does not tell")
    parser.add_argument("--keep-existing", action="store_true", help="fail if the output exists")
    return parser.parse_args(argv)


def _read_options(given: argparse.Namespace) -> dict[str, Any]:
    """The options that were given, refused where the source's format has no such."""
    fmt = given.format or format_of(given.source)
    types = given.types
    if types is not None and types.lstrip().startswith("{"):
        types = json.loads(types)
    options = {
        "encoding": given.charset,
        "types": types,
        "fallback": given.fallback,
        "recursive": given.recursive or None,
    }
    options = {name: value for name, value in options.items() if value is not None}
    known = {"jsonl": {"encoding", "recursive"}, "parquet": {"recursive"}, "xlsx": {"types", "recursive"}}
    unknown = set(options) - known.get(fmt, set(options))
    if unknown:
        raise ValueError(f"{fmt} sources have no option {', '.join(sorted(unknown))}")
    return options


def main(argv: Sequence[str] | None = None) -> int:
    given = _arguments(argv)
    spark = SparkSession.builder.appName("tablecare").getOrCreate()
    try:
        steps = as_steps(read_recipe(given.recipe, spark))
        report = run_recipe(
            spark,
            steps,
            given.source,
            given.output,
            source_format=given.format,
            destination_format=given.output_format,
            overwrite=not given.keep_existing,
            lineage=given.lineage,
            **_read_options(given),
        )
    except (OSError, ValueError, PySparkException) as problem:
        print(f"{given.source}: {problem}", file=sys.stderr)
        return 1
    print(*[s.line() for s in report.steps], sep="\n")
    print(
        f"{len(steps)} step(s), {report.rows_out} rows written to {report.destination}",
        file=sys.stderr,
    )
    return 0


if __name__ == "__main__":
    sys.exit(main())
