"""A3: a small, repeatable random sample to look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecare.functions.columns import ROW_ORDER, col, hidden, visible
from tablecare.functions.text import as_text
from tablecare.session import configured

PREVIEW_ROWS = 250  # fixed size of a preview

_STEPS = 1 << 52  # distinct values of a uniform number


@configured
def preview(
    df: DataFrame,
    key: Sequence[str] = (),
    seed: int = 42,
    rows: int = PREVIEW_ROWS,
) -> DataFrame:
    """``rows`` random rows, the same ones for the same seed; all if fewer.

    With a unique ``key``, rows are ranked by a hash of key and seed: a top-k, so each
    task sends at most ``rows`` rows and nothing else is sorted or shuffled. Without
    one, rows are known by what they hold, so that the sample does not depend on how
    files are split; see ``_by_content``. The sample comes in key or source order.
    """
    if key:
        identity = F.concat_ws(":", *[as_text(col(k), df.schema[k].dataType) for k in key])
        rank = F.md5(F.concat(identity, F.lit(f":{seed}")))
        ties = [col(k) for k in key]
        return df.orderBy(rank, *ties).limit(rows).orderBy(*ties)
    if not hidden(df):
        raise ValueError("preview needs a unique key, or a table read with row order")
    return _by_content(df, seed, rows).orderBy(F.col(ROW_ORDER))


def _exponential(turn: Column, seed: int) -> Column:
    """An exponential random number, fixed by content, turn and seed."""
    uniform = F.pmod(F.xxhash64("content", turn, F.lit(seed)), F.lit(_STEPS)) + 0.5
    return -F.log(uniform / _STEPS)


def _by_content(df: DataFrame, seed: int, rows: int) -> DataFrame:
    """A uniform sample in which equal rows share a random state.

    Were each of n equal rows given an exponential random rank, the gaps between the
    sorted ranks would be exponential too, with means 1/n, 1/(n-1) and so on: a count
    is enough to draw the ranks of all copies. Per distinct content a hash and a
    count are shuffled, combined within tasks first. Contents whose first rank is not
    among the ``rows`` smallest have no row in the sample, so that at most ``rows``
    contents are followed up, and their rows are found in a second read.
    """
    held = F.to_json(F.struct(*[col(c) for c in visible(df)]), {"ignoreNullFields": "false"})
    known = df.select(F.xxhash64(held).alias("content"), F.struct("*").alias("row"))
    counted = known.groupBy("content").agg(F.count("*").alias("n"))
    first = _exponential(F.lit(1).cast("long"), seed) / F.col("n")
    leading = counted.orderBy(first, "content").limit(rows)
    turns = F.sequence(F.lit(1).cast("long"), F.least("n", F.lit(rows).cast("long")))
    ranks = F.aggregate(
        turns,
        F.array().cast("array<double>"),
        lambda sums, turn: F.concat(
            sums,
            F.array(
                F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0.0))
                + _exponential(turn, seed) / (F.col("n") - turn + 1)
            ),
        ),
    )
    drawn = leading.select("content", F.explode(ranks).alias("rank"))
    drawn = drawn.orderBy("rank", "content").limit(rows)
    # at most ``rows`` pairs of numbers go to the tasks
    wanted = F.broadcast(drawn.groupBy("content").agg(F.count("*").alias("wanted")))
    in_order = Window.partitionBy("content").orderBy(F.col(f"row.{ROW_ORDER}"))
    copies = known.join(wanted, "content").withColumn("copy", F.row_number().over(in_order))
    # the constant bound lets tasks drop further copies before the shuffle
    return copies.where((F.col("copy") <= rows) & (F.col("copy") <= F.col("wanted"))).select("row.*")
