"""Evaluation of predictions.

Every count-based metric starts from one aggregate over (true, predicted) classes:
map-side combined, so hot classes cost nothing, with k*k rows after the shuffle.
What follows is arithmetic on those few rows.  Labels and predictions are not NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duotext.functions import scores as sc
from duotext.functions.hashing import as_list
from duotext.operators.ordering import BUCKET, BUCKET_ROWS, scan_buckets, with_range_bucket


MAX_CLASSES = 1_000  # beyond it k x k tables are refused


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """``top / bottom`` as DOUBLE; ``empty`` where the denominator is zero."""
    value = top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))
    return value if empty is None else F.coalesce(value, F.lit(empty))


# -- counts ----------------------------------------------------------------------

def row_count(df: DataFrame, by: str | Sequence[str] = ()) -> DataFrame:
    """Rows of a table, or of each of its parts."""
    return df.groupBy(*as_list(by)).agg(F.count(F.lit(1)).alias("n"))


def distinct_classes(df: DataFrame, label: str = "label") -> DataFrame:
    """The class values, ascending."""
    return df.select(F.col(label).alias("cls")).distinct().orderBy("cls")


def cell_counts(df: DataFrame, y_true: str, y_pred: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (true, predicted) class; empty cells are absent."""
    return df.groupBy(*by, F.col(y_true).alias("y_true"), F.col(y_pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_counts(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """The full k x k table of counts, zero cells included."""
    cells = cell_counts(df, y_true, y_pred)
    # one row holding the k classes, opened twice: the class grid
    found = cells.select(F.explode(F.array("y_true", "y_pred")).alias("cls")).distinct().limit(MAX_CLASSES + 1)
    many = F.raise_error(F.lit(f"more than {MAX_CLASSES} classes"))
    listed = found.agg(F.array_sort(F.collect_list("cls")).alias("classes"))
    classes = listed.select(F.when(F.size("classes") > MAX_CLASSES, many).otherwise(F.col("classes")).alias("classes"))
    grid = classes.select(F.explode("classes").alias("y_true"), "classes").select(
        "y_true", F.explode("classes").alias("y_pred")
    )
    return grid.join(cells, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n")
    )


def confusion_joint_T(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Share of all rows per (predicted, true) cell: the transposed joint distribution."""
    total = F.sum("n").over(Window.partitionBy())  # k*k rows
    return confusion_counts(df, y_true, y_pred).select(
        "y_pred", "y_true", ratio(F.col("n"), total).alias("share")
    )


def confusion_row_normalized(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Share within each true class; a class without true rows gives zeros."""
    support = F.sum("n").over(Window.partitionBy("y_true"))
    return confusion_counts(df, y_true, y_pred).select(
        "y_true", "y_pred", ratio(F.col("n"), support).alias("share")
    )


def prediction_distribution(df: DataFrame, y_pred: str, classes: Sequence[int]) -> DataFrame:
    """Share of predictions per class of a fixed list; predictions outside it still count as rows."""
    counts = df.groupBy(F.col(y_pred).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    listed = counts.agg(F.sum("n").alias("total")).select(
        "total", F.explode(F.array(*[F.lit(c) for c in classes])).alias("cls")
    )
    return listed.join(counts, "cls", "left").select("cls", ratio(F.coalesce("n", F.lit(0)), F.col("total")).alias("share"))


# -- per class -------------------------------------------------------------------

def one_vs_rest_counts(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: str | Sequence[str] = ()
) -> DataFrame:
    """TP, FP, TN and FN of each class against the rest."""
    by = as_list(by)
    cells = cell_counts(df, y_true, y_pred, by)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("y_true").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("called"),
                 hit.cast("bigint").alias("tp")),
        F.struct(F.col("y_pred").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("called"),
                 F.lit(0).cast("bigint").alias("tp")),
    )
    per_class = cells.select(*by, F.inline(roles)).groupBy(*by, "cls").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("tp").alias("tp")
    )
    total = F.sum("support").over(Window.partitionBy(*by))  # one row per class
    return per_class.select(
        *by, "cls", "tp",
        (F.col("called") - F.col("tp")).alias("fp"),
        (total - F.col("support") - F.col("called") + F.col("tp")).alias("tn"),
        (F.col("support") - F.col("tp")).alias("fn"),
    )


def _quality(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    # F1 as 2TP / (2TP + FP + FN): the same number, zero exactly where P + R is zero
    return {
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "accuracy": ratio(tp + tn, tp + fp + tn + fn),
    }


def precision_recall_f1_accuracy(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: str | Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and one-vs-rest accuracy of every class; 0 for a zero denominator."""
    counts = one_vs_rest_counts(df, y_true, y_pred, by)
    quality = _quality(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    return counts.select(*as_list(by), "cls", *[v.alias(k) for k, v in quality.items()])


# -- whole table -----------------------------------------------------------------

_METRICS = ("accuracy", "weighted_f1", "f1", "cohen_kappa", "roc_auc")


def summary(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: str | Sequence[str] = (),
    metrics: Sequence[str] = _METRICS,
) -> DataFrame:
    """Any of the count-based metrics, one row (or one per ``by`` group).

    ``f1`` and ``roc_auc`` are those of class 1 against the rest.  Kappa is NULL
    where chance agreement is 1, the area is NULL where a class is missing.
    """
    by = as_list(by)
    support = F.col("tp") + F.col("fn")
    n = F.sum(support).cast("double")
    one = F.col("cls") == 1
    quality = _quality(*[F.col(c) for c in ("tp", "fp", "tn", "fn")])
    observed = F.sum("tp") / n
    chance = F.sum(support.cast("double") * (F.col("tp") + F.col("fp"))) / (n * n)
    exprs = {
        "accuracy": ratio(F.sum("tp"), n),
        "weighted_f1": ratio(F.sum(quality["f1"] * support), n),
        "f1": F.coalesce(F.max(F.when(one, quality["f1"])), F.lit(0.0)),
        "cohen_kappa": (observed - chance) / F.nullif(1 - chance, F.lit(0.0)),
        "roc_auc": F.max(F.when(one, (
            ratio(F.col("tp"), support, None) + ratio(F.col("tn"), F.col("tn") + F.col("fp"), None)
        ) / 2)),
    }
    return one_vs_rest_counts(df, y_true, y_pred, by).groupBy(*by).agg(*[exprs[m].alias(m) for m in metrics])


def accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Share of rows predicted right."""
    return df.agg(F.avg((F.col(y_true) == F.col(y_pred)).cast("double")).alias("accuracy"))


def percent_accuracy(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """The same in percent."""
    return accuracy(df, y_true, y_pred).select((100 * F.col("accuracy")).alias("percent_accuracy"))


def weighted_f1(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """F1 per class, averaged by true support."""
    return summary(df, y_true, y_pred, metrics=["weighted_f1"])


def binary_f1(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """F1 of class 1."""
    return summary(df, y_true, y_pred, metrics=["f1"])


def cohen_kappa(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Agreement corrected for chance."""
    return summary(df, y_true, y_pred, metrics=["cohen_kappa"])


def roc_auc_hard(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    """Area under the ROC curve of 0/1 predictions: (true positive rate + true negative rate) / 2."""
    return summary(df, y_true, y_pred, metrics=["roc_auc"])


def roc_auc_scores(
    df: DataFrame, y_true: str = "y_true", score: str = "score", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Exact area under the ROC curve of scores, ties averaged.

    Buckets are cut on the scores themselves, then equal scores collapse in a partial
    aggregate before anything is ranked.  The bucket totals come from a scan of two
    columns, so the data are shuffled for the ranking only.
    """
    raw = df.select(F.col(score).cast("double").alias("__score"), F.col(y_true).alias("__y"))
    bucketed, buckets = with_range_bucket(raw, ["__score"], bucket_rows=bucket_rows)
    counts = [F.count_if(F.col("__y") == 1).alias("__pos"), F.count_if(F.col("__y") != 1).alias("__neg")]
    per_score = bucketed.groupBy(BUCKET, "__score").agg(*counts)
    ranked = scan_buckets(
        per_score, buckets, ["__score"], sums={"__upto": "__neg"}, totals_of=bucketed.groupBy(BUCKET).agg(*counts)
    )
    below = F.col("__upto") - F.col("__neg")
    won = F.sum(F.col("__pos") * (below + F.col("__neg") / 2).cast("double"))
    pairs = F.sum("__pos").cast("double") * F.sum("__neg").cast("double")
    return ranked.agg((won / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def cross_entropy(
    df: DataFrame, k: int, y_true: str = "y_true", scores: str = "scores", double_softmax: bool = False
) -> DataFrame:
    """Mean negative log-likelihood of logits; ``double_softmax`` applies softmax to them first."""
    logits = F.col(scores)
    used = df.withColumn("__x", sc.softmax(logits, k)) if double_softmax else df.withColumn("__x", logits)
    return used.agg(F.avg(sc.nll(F.col("__x"), F.col(y_true), k)).alias("cross_entropy"))


def binary_cross_entropy(df: DataFrame, k: int, y_true: str = "y_true", probs: str = "probs") -> DataFrame:
    """Mean over rows and one-hot outputs of the binary cross-entropy, logs clamped at -100."""
    return df.agg((F.avg(sc.bce(F.col(probs), F.col(y_true), k)) / k).alias("binary_cross_entropy"))


def majority_baseline(df: DataFrame, label: str = "label") -> DataFrame:
    """The largest class (smallest value on ties) and the accuracy of always predicting it."""
    sizes = df.groupBy(F.col(label).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.col("cls"), F.struct("n", (-F.col("cls")).alias("tie")))
    return sizes.agg(best.alias("cls"), ratio(F.max("n"), F.sum("n")).alias("accuracy"))


def batch_mean_metric(
    df: DataFrame, batch: str, metric: str = "accuracy", y_true: str = "y_true", y_pred: str = "y_pred",
    for_class: int = 1, loss: str = "loss",
) -> DataFrame:
    """A metric per batch, then the plain mean over batches; a short last batch weighs the same.

    ``metric`` is ``accuracy``, ``loss``, or ``precision`` / ``recall`` / ``f1`` of ``for_class``.
    """
    t, p = F.col(y_true) == for_class, F.col(y_pred) == for_class
    if metric == "accuracy":
        per_batch = F.avg((F.col(y_true) == F.col(y_pred)).cast("double"))
    elif metric == "loss":
        per_batch = F.avg(loss)
    elif metric in ("precision", "recall", "f1"):
        per_batch = _quality(
            F.count_if(t & p), F.count_if(~t & p), F.count_if(~t & ~p), F.count_if(t & ~p)
        )[metric]
    else:
        raise ValueError(f"unknown metric {metric}")
    return df.groupBy(batch).agg(per_batch.alias("__m")).agg(F.avg("__m").alias(metric))


def batch_mean_report(
    df: DataFrame, batch: str, phase: str = "phase", y_true: str = "y_true", y_pred: str = "y_pred",
    classes: Sequence[int] = (0, 1), loss: str = "loss",
) -> DataFrame:
    """All batch metrics of all phases in one pass: one row per phase with the plain means over its batches of loss,
    accuracy and, for each class c, ``precision_c``, ``recall_c`` and ``f1_c``."""
    measures = {"loss": F.avg(loss), "accuracy": F.avg((F.col(y_true) == F.col(y_pred)).cast("double"))}
    for c in classes:
        t, p = F.col(y_true) == c, F.col(y_pred) == c
        found = _quality(F.count_if(t & p), F.count_if(~t & p), F.count_if(~t & ~p), F.count_if(t & ~p))
        measures |= {f"{m}_{c}": found[m] for m in ("precision", "recall", "f1")}
    per_batch = df.groupBy(phase, batch).agg(*[v.alias(m) for m, v in measures.items()])
    return per_batch.groupBy(phase).agg(*[F.avg(m).alias(m) for m in measures])


def loss_over_dataset(df: DataFrame, batch: str, loss: str = "loss") -> DataFrame:
    """Sum of the batch-mean losses divided by the number of rows."""
    per_batch = df.groupBy(batch).agg(F.avg(loss).alias("__m"), F.count(F.lit(1)).alias("__n"))
    return per_batch.agg((F.sum("__m") / F.sum("__n")).alias("loss"))


def metric_report(
    df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", kind: str = "multiclass",
    batch: str | None = None, loss: str = "loss",
) -> DataFrame:
    """The named metric sets, one row.

    ``multiclass``: accuracy, weighted F1.  ``binary``: kappa, F1, ROC area of hard
    predictions.  ``loss``: loss over the data set, accuracy, F1, ROC area.
    """
    if kind == "multiclass":
        return summary(df, y_true, y_pred, metrics=["accuracy", "weighted_f1"]).withColumnRenamed("weighted_f1", "f1")
    if kind == "binary":
        return summary(df, y_true, y_pred, metrics=["cohen_kappa", "f1", "roc_auc"])
    if kind == "loss":
        if batch is None:
            raise ValueError("kind 'loss' needs the batch column")
        counts = summary(df, y_true, y_pred, metrics=["accuracy", "f1", "roc_auc"])
        return counts.select(loss_over_dataset(df, batch, loss).scalar().alias("loss"), "accuracy", "f1", "roc_auc")
    raise ValueError("kind must be 'multiclass', 'binary' or 'loss'")
