"""Row-wise functions over score arrays.

All of them are array expressions of a fixed size, so a plan over a thousand classes
is as small as one over three.  Of a longer array the first ``k`` entries count; one
with fewer fails the query.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often it is named."""
    return F.transform(F.array(value), body)[0]


def _items(x: Column, k: int) -> Column:
    """The first k entries."""
    short = F.raise_error(F.concat(F.lit(f"{k} scores are needed, found "), F.size(x).cast("string")))
    return F.when(F.size(x) < k, short).otherwise(F.slice(x, 1, k))


def _total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, v: a + v)


def _exps(x: Column, k: int) -> Column:
    """exp(v - top) of each entry: nothing overflows."""
    return _let(_items(x, k), lambda v: _let(F.array_max(v), lambda top: F.transform(v, lambda e: F.exp(e - top))))


def softmax(x: Column, k: int) -> Column:
    """Logits to probabilities."""
    return _let(_exps(x, k), lambda e: _let(_total(e), lambda total: F.transform(e, lambda v: v / total)))


def argmax_label(x: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def confidence(probs: Column) -> Column:
    """The largest probability of the row."""
    return F.array_max(probs)


def one_hot(label: Column, k: int) -> Column:
    """1.0 at the label's position, 0.0 elsewhere (``argmax_label`` is the inverse)."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(label == i, 1.0).otherwise(0.0))


def class_at(index: Column, classes: Sequence[int]) -> Column:
    """The class value at a 0-based index."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), (index + 1).cast("int"))


def normalize_scores(x: Column, k: int) -> Column:
    """Divide by the row sum; a row that sums to zero becomes all zeros."""
    def shares(v: Column, total: Column) -> Column:
        return F.transform(v, lambda e: F.when(total == 0, 0.0).otherwise(e / F.nullif(total, F.lit(0.0))))

    return _let(_items(x, k), lambda v: _let(_total(v), lambda total: shares(v, total)))


def weighted(scores: Column, weights: Sequence[float | Column], k: int) -> Column:
    """Each score times the weight of its class."""
    return F.zip_with(_items(scores, k), F.array(*[F.lit(w).cast("double") for w in weights]), lambda v, w: w * v)


def weighted_posterior(probs: Column, weights: Sequence[float | Column], k: int) -> Column:
    """Class-weighted, renormalised probabilities.

    A row whose weighted scores all cancel to zero takes the weights themselves,
    left unnormalised.
    """
    w = F.array(*[F.lit(v).cast("double") for v in weights])

    def shares(v: Column, total: Column) -> Column:
        return F.when(total == 0, w).otherwise(F.transform(v, lambda e: e / F.nullif(total, F.lit(0.0))))

    return _let(weighted(probs, weights, k), lambda v: _let(_total(v), lambda total: shares(v, total)))


def nll(logits: Column, label: Column, k: int) -> Column:
    """Negative log-likelihood of the label under softmax(logits), in log-sum-exp form."""
    norm = F.log(_total(_exps(logits, k))) + F.array_max(F.slice(logits, 1, k))
    return norm - F.element_at(logits, (label + 1).cast("int"))


def bce(probs: Column, label: Column, k: int) -> Column:
    """Sum over the k one-hot outputs of the binary cross-entropy, logs clamped at -100."""
    # ln(0) is NULL in Spark, so the clamp is spelled out
    def clamped(p: Column) -> Column:
        return F.when(p <= 0, F.lit(-100.0)).otherwise(F.greatest(F.log(p), F.lit(-100.0)))

    terms = F.transform(_items(probs, k), lambda p, i: F.when(label == i, -clamped(p)).otherwise(-clamped(1 - p)))
    return _total(terms)
