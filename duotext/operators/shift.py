"""Correction of predictions for label shift (black-box shift correction).

The confusion matrix of a validation set and the distribution of test predictions
give one weight per class; reweighted test probabilities give new predictions.
Two aggregates run on the data; k*k + k numbers reach the driver for the solve.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotext.functions import scores as sc
from duotext.operators import metrics

MAX_CLASSES = 1_000


def solve_weights(joint: np.ndarray, shares: np.ndarray, clip: bool = True) -> tuple[np.ndarray, bool]:
    """Weights w with ``joint @ w = shares``; all zero and flagged if ``joint`` is singular."""
    if np.linalg.matrix_rank(joint) < len(shares):
        return np.zeros(len(shares)), True
    try:
        w = np.linalg.solve(joint, shares)
    except np.linalg.LinAlgError:
        return np.zeros(len(shares)), True
    return (np.maximum(w, 0.0) if clip else w), False


def shift_weights(
    validation: DataFrame, test: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", clip: bool = True
) -> DataFrame:
    """One row per class: ``cls``, weight ``w`` and whether the confusion matrix was ``degenerate``.

    The classes are those of validation labels and predictions together.
    """
    spark = validation.sparkSession
    cells = metrics.cell_counts(validation, y_true, y_pred).limit(MAX_CLASSES**2 + 1).collect()
    classes = sorted({r["y_true"] for r in cells} | {r["y_pred"] for r in cells})
    if not classes or len(classes) > MAX_CLASSES:
        raise ValueError(f"between 1 and {MAX_CLASSES} classes are needed, found {len(classes)}")
    at = {c: i for i, c in enumerate(classes)}
    counts = np.zeros((len(classes), len(classes)))
    for r in cells:
        counts[at[r["y_pred"]], at[r["y_true"]]] = r["n"]
    shares = {r["cls"]: r["share"] for r in metrics.prediction_distribution(test, y_pred, classes).collect()}
    w, degenerate = solve_weights(counts / counts.sum(), np.array([shares[c] for c in classes]), clip)
    rows = [
        F.struct(F.lit(int(c)).alias("cls"), F.lit(float(v)).alias("w"), F.lit(degenerate).alias("degenerate"))
        for c, v in zip(classes, w, strict=True)
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows)))


def clip_negative(weights: DataFrame, w: str = "w") -> DataFrame:
    """Negative weights become 0."""
    return weights.withColumn(w, F.greatest(F.col(w), F.lit(0.0)))


def weight_list(weights: DataFrame) -> tuple[list[int], list[float]]:
    """Classes in ascending order and their weights, on the driver (k rows)."""
    rows = weights.select("cls", "w").limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    rows.sort(key=lambda r: r["cls"])
    return [r["cls"] for r in rows], [r["w"] for r in rows]


def apply_class_weights(
    df: DataFrame, weights: DataFrame, scores: str = "probs", out: str = "weighted"
) -> DataFrame:
    """Each score times the weight of its class.  The k weights are literals of the plan."""
    _, w = weight_list(weights)
    return df.withColumn(out, sc.weighted(F.col(scores), w, len(w)))


def adjust_probs(
    df: DataFrame, weights: DataFrame, scores: str = "probs", out: str = "new_probs", input: str = "probs"
) -> DataFrame:
    """Reweighted, renormalised probabilities; a zero row takes the weights as they are.

    ``input='logits'`` applies softmax first; ``input='logits_raw'`` reweights the
    numbers as given.
    """
    _, w = weight_list(weights)
    return df.withColumn(out, _adjusted(F.col(scores), w, input))


def _adjusted(scores: Column, w: Sequence[float], input: str) -> Column:
    if input not in ("probs", "logits", "logits_raw"):
        raise ValueError("input must be 'probs', 'logits' or 'logits_raw'")
    k = len(w)
    given = sc.softmax(scores, k) if input == "logits" else scores
    return sc.weighted_posterior(given, w, k)


def update_probs(
    df: DataFrame, weights: DataFrame, scores: str = "probs", probs_out: str = "new_probs",
    pred_out: str = "new_pred", input: str = "probs",
) -> DataFrame:
    """New probabilities and the class value with the largest one."""
    classes, w = weight_list(weights)
    moved = df.withColumn(probs_out, _adjusted(F.col(scores), w, input))
    return moved.withColumn(pred_out, sc.class_at(sc.argmax_label(F.col(probs_out)), classes))


def shift_corrected_evaluation(
    validation: DataFrame, test: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
    scores: str = "probs", input: str = "probs",
) -> DataFrame:
    """Binary metrics of the test predictions before and after the correction, in one pass."""
    weights = shift_weights(validation, test, y_true, y_pred)
    moved = update_probs(test, weights, scores, "__probs", "__new", input)
    stages = F.array(
        F.struct(F.lit("before").alias("stage"), F.col(y_pred).cast("int").alias("y_pred")),
        F.struct(F.lit("after").alias("stage"), F.col("__new").cast("int").alias("y_pred")),
    )
    both = moved.select(F.col(y_true).alias("y_true"), F.inline(stages))
    return metrics.summary(both, by="stage", metrics=["f1", "cohen_kappa", "roc_auc"])
