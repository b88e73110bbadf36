"""Mixing sources to target weights, in DataFrame operations only.

The share of each source is raised to an exponent and normalised: 1 keeps the
natural mixture, 0 makes all sources equal. The exponent is found by bisection; the
weights are then realised source by source as whole permutations of its documents
(passes) and, for what is left of its budget, the leading blocks of one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablecare.llm.tables import Scratch
from tablecare.session import configure

#: halvings of the exponent's interval
_STEPS = 20


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measured(sources: DataFrame, exponent: float) -> tuple[float, float]:
    """Entropy of the weights in bits, and how often the most repeated source is read
    when the least repeated one is read once."""
    power = F.pow("share", F.lit(exponent))
    whole = F.sum(power)
    entropy = (F.log2(whole) - F.sum(power * F.log2(power)) / whole).alias("entropy")
    reads = power / F.col("share")
    row = sources.agg(entropy, (F.max(reads) / F.min(reads)).alias("repeats")).first()
    return row["entropy"], row["repeats"]


def temperature(
    sources: DataFrame, max_repeats: float | None = None, min_entropy: float | None = None
) -> float:
    """The exponent from 0 to 1 for the shares of ``sources`` (``share``).

    With ``max_repeats`` the smallest one at which no source is read more than that
    many times as often as another; with ``min_entropy`` (bits) the largest one whose
    weights reach it (0 if none does).
    """
    if (max_repeats is None) == (min_entropy is None):
        raise ValueError("give max_repeats or min_entropy")
    low, high = 0.0, 1.0

    def flat_enough(exponent: float) -> bool:
        entropy, repeats = _measured(sources, exponent)
        return entropy >= min_entropy if max_repeats is None else repeats > max_repeats

    # both are false from some exponent on
    if flat_enough(high):
        return high
    if not flat_enough(low):
        return low
    for _ in range(_STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if flat_enough(middle) else (low, middle)
    return low if max_repeats is None else high


def _order_key(seed: int, copy: Column, source: Column, doc_id: Column) -> Column:
    """Where a pass puts a document: MD5, so that other engines can tell as well."""
    parts = (F.lit(seed), copy, source, doc_id)
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.md5(text.cast("binary"))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 12), 16, 10).cast("long"), blocks)


def _cuts(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Per source the block in which its last pass ends and the last key it takes there.

    ``rows``: source, key, block, tokens, rest. Blocks are summed before anything is
    ordered; one by one are ordered only the rows of the block that is cut.
    """
    sums = rows.groupBy("source", "block").agg(
        F.sum("tokens").alias("sum"), F.first("rest").alias("rest")
    )
    after = F.sum("sum").over(Window.partitionBy("source").orderBy("block"))
    cut = (
        sums.withColumn("after", after)
        .where("after > rest")
        .groupBy("source")
        .agg(F.min_by(F.struct("block", (F.col("after") - F.col("sum")).alias("before")), "block").alias("cut"))
        .select(F.col("source").alias("of"), F.col("cut.block").alias("cut_block"), "cut.before")
    )
    cut = scratch.keep(cut)
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("cut_block"))
    inside = rows.join(cut, same)
    # rows with equal keys are taken or left together
    taken = F.col("before") + F.sum("tokens").over(Window.partitionBy("of").orderBy("key"))
    last = inside.withColumn("taken", taken).groupBy("of").agg(
        F.max(F.when(F.col("taken") <= F.col("rest"), F.col("key"))).alias("cut_key")
    )
    # null-safe, for the null source
    found = last.withColumnRenamed("of", "also")
    return cut.join(found, F.col("of").eqNullSafe(F.col("also"))).select("of", "cut_block", "cut_key")


def mix(
    docs: DataFrame, max_repeats: float | None = 2.0, min_entropy: float | None = None,
    budget: float | None = None, block_rows: int = 10_000, seed: int = 1,
) -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, with the ``weight`` of
    the source, the ``exponent``, ``copy`` (the pass, from 0), ``block`` and ``order_key``:
    a pass goes through its source by block, then key.

    ``budget`` is the number of tokens of the mixture; by default the smallest one that
    reads every source at least once whole, so that no document is lost. The last,
    partial pass of a source takes documents in order until the next would not fit.

    A null source is a source of its own, an empty one another. Documents without
    tokens come with their source; sources without any tokens come along once, at
    weight 0. Repeated rows are dealt like any other; those with one doc_id and source
    have one place. Null doc_ids share a place. The added names replace columns of the
    same name. An empty table gives an empty one.

    No window spans the documents of a source: a pass permutes in blocks by a hash,
    and whether a document belongs to it follows from its key and where it is cut.
    """
    spark = configure(docs.sparkSession)
    scratch = Scratch(spark, "mixing")
    rows = scratch.keep(docs.select("doc_id", "source", token_count(F.col("text")).alias("tokens")))
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("total"), F.count("*").alias("docs"))
    totals = scratch.keep(totals)
    corpus = totals.agg(F.sum("total")).first()[0] or 0
    share = F.col("total") / F.lit(float(corpus or 1))
    sources = totals.withColumn("share", share)
    counted = sources.where("total > 0")
    exponent = temperature(counted, max_repeats, min_entropy) if corpus else 1.0
    power = F.pow("share", F.lit(exponent))
    whole, once = counted.agg(F.sum(power), F.max(F.col("total") / power)).first()
    quota = F.lit(once) * power if budget is None else F.lit(float(budget)) * power / F.lit(whole)
    held = F.col("total") > 0
    # a quota that is a whole number of passes but for rounding is one
    passes = F.when(held, F.floor(F.col("quota") / F.col("total") + 1e-9)).otherwise(1)
    rest = F.when(held, F.col("quota") - F.col("passes") * F.col("total")).otherwise(0.0)
    plan = (
        sources.withColumn("weight", F.when(held, power / F.lit(whole)).otherwise(0.0))
        .withColumn("quota", quota)
        .withColumn("passes", passes.cast("long"))
        .withColumn("rest", F.greatest(rest, F.lit(0.0)))
        .withColumn("blocks", F.ceil(F.col("docs") / block_rows).cast("long"))
        .select(F.col("source").alias("of"), "weight", "passes", "rest", "blocks")
    )
    plan = scratch.keep(plan)
    last_key = _order_key(seed, F.col("passes"), F.col("source"), F.col("doc_id"))
    last_pass = (
        rows.join(_sized(plan), F.col("source").eqNullSafe(F.col("of")))
        .where("rest > 0")
        .withColumn("key", last_key)
        .withColumn("block", _block(F.col("key"), F.col("blocks")))
        .select("source", "key", "block", "tokens", "rest")
    )
    cuts = _cuts(last_pass, scratch).withColumnRenamed("of", "cut_of")
    plan = plan.join(cuts, F.col("of").eqNullSafe(F.col("cut_of")), "left").drop("cut_of")
    plan = Scratch(spark, "mixture").keep(plan)
    scratch.drop()
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ADDED]
    key = _order_key(seed, F.col("copy"), F.col("doc.source"), F.col("doc.doc_id"))
    in_last = (F.col("block") < F.col("cut_block")) | (
        (F.col("block") == F.col("cut_block")) & (F.col("order_key") <= F.col("cut_key"))
    )
    return (
        docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
        .join(_sized(plan), F.col("doc.source").eqNullSafe(F.col("of")))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("copy"))
        .withColumn("order_key", key)
        .withColumn("block", _block(F.col("order_key"), F.col("blocks")))
        .where((F.col("copy") < F.col("passes")) | in_last)
        .select(*own, "weight", F.lit(exponent).alias("exponent"), "copy", "block", "order_key")
    )


#: the columns ``mix`` adds
ADDED = ("weight", "exponent", "copy", "block", "order_key")
#: bytes up to which the plan of all sources is sent to every task
_SMALL = 8 << 20


def _sized(plan: DataFrame) -> DataFrame:
    """The plan, to be broadcast if it is small; else Spark shuffles both sides and
    splits the partitions of hot sources."""
    size = plan.agg(F.sum(F.coalesce(F.octet_length("of"), F.lit(0)) + 100)).first()[0]
    return F.broadcast(plan) if (size or 0) <= _SMALL else plan
