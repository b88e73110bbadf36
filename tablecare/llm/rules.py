"""A quality classifier: a sparse ensemble of rules over text statistics.

Small boosted trees are grown on a bounded sample of labelled rows; every path from
a root is a rule, a conjunction of comparisons. A logistic regression with an L1
penalty keeps few of them, and these become one Spark column expression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecare.session import configure

#: labelled rows that a model is fitted on at most unless another number is asked for
SAMPLE_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of the whole text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.char_length(text), F.lit(1))
    words = F.split(F.trim(text), r"\s+")
    n_words = F.size(words)

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    lines = F.regexp_count(text, F.lit("\n")) + 1
    return {
        "chars": F.char_length(text).cast("double"),
        "word_chars": chars / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "line_words": n_words / lines,
        "upper": share(r"\p{Lu}"),
        "symbols": share(r"[^\p{L}\p{N}\s.,]"),
        "bars": share(r"\|"),
        "bangs": share("!"),
        "digits": share(r"\p{N}"),
        "stops": share(r"[.,]"),
        "unspaced": share(r"[.,;:!?]\p{L}"),
    }


#: (statistic, is it above, threshold)
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """Rules with weights; ``score`` is a Spark expression over the statistics."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        terms = [F.lit(self.intercept)]
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, above, threshold in conditions:
                holds &= F.col(name) > threshold if above else F.col(name) <= threshold
            terms.append(F.when(holds, weight).otherwise(0.0))
        # summed in pairs: a chain of hundreds is too deep for the code generator
        while len(terms) > 1:
            pairs = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)]
            terms = pairs + terms[2 * len(pairs) :]
        return 1 / (1 + F.exp(-terms[0]))


def _grow(bins: np.ndarray, residual: np.ndarray, weight: np.ndarray, rows: np.ndarray,
          depth: int, least: int) -> tuple | float:
    """A regression tree over binned statistics: (column, bin, low side, high side)."""
    value = float(residual[rows].sum() / (weight[rows].sum() + 1.0))
    if not depth or len(rows) < 2 * least:
        return value
    best, where = 1e-6, None
    all_sum, all_weight = residual[rows].sum(), weight[rows].sum()
    for column in range(bins.shape[1]):
        held = bins[rows, column]
        sums = np.cumsum(np.bincount(held, residual[rows], 64))[:-1]
        weights = np.cumsum(np.bincount(held, weight[rows], 64))[:-1]
        counts = np.cumsum(np.bincount(held, minlength=64))[:-1]
        gain = sums**2 / (weights + 1) + (all_sum - sums) ** 2 / (all_weight - weights + 1) - all_sum**2 / (all_weight + 1)
        gain[(counts < least) | (len(rows) - counts < least)] = -1
        if gain.max() > best:
            best, where = gain.max(), (column, int(gain.argmax()))
    if where is None:
        return value
    low = bins[rows, where[0]] <= where[1]
    grown = [_grow(bins, residual, weight, rows[side], depth - 1, least) for side in (low, ~low)]
    return (*where, *grown)


def _predict(tree: tuple | float, bins: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(bins), tree)
    low = bins[:, tree[0]] <= tree[1]
    return np.where(low, _predict(tree[2], bins), _predict(tree[3], bins))


def _paths(tree: tuple | float, above: tuple = ()) -> Iterator[tuple]:
    """Every node but the root, as its conditions (column, is it above, bin)."""
    if above:
        yield above
    if not isinstance(tree, float):
        yield from _paths(tree[2], (*above, (tree[0], False, tree[1])))
        yield from _paths(tree[3], (*above, (tree[0], True, tree[1])))


def _shorter(path: tuple) -> tuple:
    """At most one bound per column and side, in a fixed order."""
    bounds: dict = {}
    for column, above, at in path:
        known = bounds.get((column, above))
        bounds[column, above] = at if known is None else (max(known, at) if above else min(known, at))
    return tuple((column, above, at) for (column, above), at in sorted(bounds.items()))


def _lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights by accelerated proximal gradient steps."""
    n = len(y)
    # the largest eigenvalue of the small square bounds the curvature
    size = 4 * n / (float(np.linalg.eigvalsh(x.T @ x)[-1]) + n) if x.shape[1] else 4.0
    w, b, w_ahead, b_ahead, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(x @ w_ahead + b_ahead, -30, 30))) - y
        step = w_ahead - size * (x.T @ error) / n
        w_next = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0)
        b_next = b_ahead - size * error.mean()
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        w_ahead = w_next + (t - 1) / t_next * (w_next - w)
        b_ahead = b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return b, w


def fit_rules(
    names: list[str], x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3,
    rate: float = 0.3, penalty: float = 2e-4,
) -> RuleModel:
    """Trees, their paths as rules, and the weights of those that the penalty leaves."""
    if not len(y) or y.min() == y.max():
        # nothing to tell apart: the smoothed share of the label
        share = (float(y.sum()) + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(share / (1 - share))), ())
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, 64)[1:-1])) for column in x.T]
    bins = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T, strict=True)], 1)
    margin = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    every, rules = np.arange(len(y)), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(bins, y - p, p * (1 - p), every, depth, max(2, len(y) // 1000))
        if isinstance(tree, float):
            break
        margin += rate * _predict(tree, bins)
        rules |= dict.fromkeys(map(_shorter, _paths(tree)))
    rules = [r for r in rules if all(at < len(cuts[c]) for c, _, at in r)]

    def holds(rule: tuple) -> np.ndarray:
        return np.all([(bins[:, c] > at) if above else (bins[:, c] <= at) for c, above, at in rule], axis=0)

    held = np.stack([holds(r) for r in rules], 1).astype(np.float32) if rules else np.zeros((len(y), 0))
    intercept, weights = _lasso(held, y.astype(np.float32), penalty)
    kept = [
        (tuple((names[c], above, float(cuts[c][at])) for c, above, at in rule), float(w))
        for rule, w in zip(rules, weights, strict=True)
        if abs(w) > 1e-9
    ]
    return RuleModel(float(intercept), tuple(kept))


def held_out(doc_id: Column) -> Column:
    """Is the document kept from learning? False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Fit on the labelled documents that are not held out, ``sample_rows`` of them at
    most, those with the smallest hash of their id.

    Rows with a null id or label, or without a document, are not used; an id with
    different labels counts once for each, and rows that repeat an id count as one
    (that with the smallest statistics); without any use the score is 0.5.
    """
    configure(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), "quality")
    known = known.distinct().orderBy(F.xxhash64("_id"), "quality").limit(sample_rows)
    # at most ``sample_rows`` pairs of numbers go to the tasks, and as many rows come back
    taught = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
    taken = F.struct(*(c.alias(n) for n, c in statistics(F.col("text")).items()))
    taught = taught.groupBy("_id", "quality").agg(F.min(taken).alias("taken")).select("quality", "taken.*")
    rows = taught.toPandas()
    names = [n for n in rows.columns if n != "quality"]
    # in one order, whatever the partitions were
    rows = rows.sort_values([*names, "quality"])
    return fit_rules(names, rows[names].to_numpy(float), rows["quality"].to_numpy(int))


def score_quality(docs: DataFrame, model: RuleModel) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (replacing columns of those names).

    Null and empty texts are scored by their statistics like any other."""
    own = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("score", "predicted")]
    # as a generated row: a later filter by the score is not pushed below it, where
    # every rule would take the statistics of the text anew
    taken = F.struct(*(c.alias(n) for n, c in statistics(F.col("text")).items()))
    measured = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        F.explode(F.array(taken)).alias("taken"),
    ).select("doc", "taken.*")
    score = measured.withColumn("_score", model.score())
    return score.select(
        *own, F.col("_score").alias("score"),
        F.when(F.col("_score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
