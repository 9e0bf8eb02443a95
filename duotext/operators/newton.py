"""Logistic models by Newton steps: they start from given weights, can be tied to them, and sum their statistics in the tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotext.functions import scores as sc

#: Beyond so many weights the matrix of second derivatives gets too large for a task's sums; ``fit_linear_probe`` has no such limit.
MOST_WEIGHTS = 2_000
_HALVINGS = 30


@dataclass(frozen=True)
class Logistic:
    """Weights of a softmax model: one row per class, the intercept first.  Two classes have one row, that of class 1."""

    weights: np.ndarray
    features: str = "features"
    iterations: int = 0

    @property
    def classes(self) -> int:
        return max(2, len(self.weights))

    def probs(self) -> Column:
        """The probabilities of all classes, as an expression over the feature vector."""
        x = F.concat(F.array(F.lit(1.0)), vector_to_array(F.col(self.features)))
        rows = self.weights if len(self.weights) > 1 else np.stack([np.zeros_like(self.weights[0]), self.weights[0]])

        def margin(row: np.ndarray) -> Column:
            products = F.zip_with(x, F.lit(row.tolist()).cast("array<double>"), lambda a, b: a * b)
            return F.aggregate(products, F.lit(0.0), lambda total, v: total + v)

        return sc.softmax(F.array(*[margin(row) for row in rows]), self.classes)


def _statistics(train: DataFrame, weights: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """(gradient, second derivatives, loss, number of rows) of the summed log loss at ``weights``.

    Each task adds up its rows and sends its sums; they are added per position, map-side
    combined, so that what arrives here is as large as the weights' square.
    """
    rows, width = weights.shape
    size = rows * width
    upper = np.triu_indices(size)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gradient, second, loss, total = np.zeros(size), np.zeros((size, size)), 0.0, 0.0
        for batch in batches:
            if not len(batch):
                continue
            y, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            x = batch.column(2).flatten().to_numpy().reshape(len(batch), width - 1)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            margins = x @ weights.T
            if rows == 1:
                margins = np.concatenate([np.zeros_like(margins), margins], axis=1)
            top = margins.max(1, keepdims=True)
            p = np.exp(margins - top)
            norm = p.sum(1, keepdims=True)
            p /= norm
            truth = y.astype(int)
            if ((truth < 0) | (truth >= classes)).any():
                raise ValueError(f"a label is not below {classes}")
            loss += float((w * (np.log(norm[:, 0]) + top[:, 0] - margins[np.arange(len(x)), truth])).sum())
            total += float(w.sum())
            first = classes - rows
            error = p - (truth[:, None] == np.arange(classes))
            gradient += ((w[:, None] * error[:, first:]).T @ x).ravel()
            for i in range(rows):
                for j in range(i, rows):
                    pull = w * p[:, first + i] * ((i == j) - p[:, first + j])
                    block = x.T @ (pull[:, None] * x)
                    second[i * width:(i + 1) * width, j * width:(j + 1) * width] += block
        values = np.concatenate([gradient, second[upper], [loss, total]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], ["at", "value"])

    found = train.mapInArrow(sums, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    values = np.zeros(size + len(upper[0]) + 2)
    values[found["at"].to_numpy()] = found["value"].to_numpy()
    second = np.zeros((size, size))
    second[upper] = values[size:-2]
    second = second + np.triu(second, 1).T
    return values[:size].reshape(rows, width), second, float(values[-2]), float(values[-1])


def fit_logistic(
    train: DataFrame, label: str = "label", features: str = "features", C: float = 1.0, classes: int = 2,
    start: Logistic | None = None, center: Logistic | None = None, weight: str | None = None, tol: float = 1e-9,
    max_iter: int = 100,
) -> Logistic:
    """The minimum of the (weighted) summed log loss plus ``|w - center|^2 / (2 C)``, intercepts free.

    ``start``: where the steps begin; as the loss is convex it changes their number, not the result.
    ``center``: weights that the new ones are tied to, zero if not given.  Every step is one pass over
    ``train`` that sums first and second derivatives (iteratively reweighted least squares); a step that
    would raise the loss is halved.  The table should be stored: it is read once per step.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    table = train.select(F.col(label).cast("double").alias("y"), w.alias("w"), vector_to_array(F.col(features)).alias("x"))
    first = table.select(F.size("x").alias("d")).first()
    width = 1 + (first["d"] if first else (start or center).weights.shape[1] - 1 if start or center else 0)
    rows = 1 if classes == 2 else classes
    if rows * width > MOST_WEIGHTS:
        raise ValueError(f"{rows * width} weights are more than {MOST_WEIGHTS}: use fit_linear_probe")
    tied = np.zeros((rows, width)) if center is None else center.weights
    at = (start or center).weights.copy() if start or center else np.zeros((rows, width))
    ridge = np.full((rows, width), 1.0 / C)
    ridge[:, 0] = 0.0

    def around(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        gradient, second, loss, n = _statistics(table, weights, classes)
        apart = weights - tied
        return gradient + ridge * apart, second + np.diag(ridge.ravel()), loss + float((ridge * apart**2).sum()) / 2, n

    gradient, second, loss, n = around(at)
    for step in range(max_iter + 1):
        if np.abs(gradient).max(initial=0.0) <= tol * max(1.0, n):
            return Logistic(at, features, step)
        # intercepts of all classes may move together without any change: the shortest step is taken
        move = np.linalg.lstsq(second, gradient.ravel(), rcond=1e-12)[0].reshape(at.shape)
        for half in range(_HALVINGS):
            found = around(at - move / 2**half)
            if found[2] <= loss + 1e-9 * abs(loss):
                break
        at, (gradient, second, loss, n) = at - move / 2**half, found
    raise RuntimeError(f"the fit has not converged after {max_iter} steps")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
