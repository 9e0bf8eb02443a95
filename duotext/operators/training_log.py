"""Training logs: per-epoch statistics, series, and which checkpoint to keep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotext.functions.hashing import as_list
from duotext.functions.text import elapsed
from duotext.operators.ordering import BUCKET_ROWS, earlier_minimum

START_SCORE = 1.0  # fixed value: a first loss must beat this to be saved


def epoch_stats(
    steps: DataFrame, by: str | Sequence[str] = "epoch", phase: str = "phase", loss: str = "loss",
    correct: str = "accuracy", seconds: str = "seconds",
) -> DataFrame:
    """One row per epoch from a step log with phases ``train`` and ``valid``.

    Mean losses of both phases, mean validation accuracy, and the summed step
    seconds of each phase as h:mm:ss.
    """
    train, valid = F.col(phase) == "train", F.col(phase) == "valid"
    return steps.groupBy(*as_list(by)).agg(
        F.avg(F.when(train, F.col(loss))).alias("train_loss"),
        F.avg(F.when(valid, F.col(loss))).alias("valid_loss"),
        F.avg(F.when(valid, F.col(correct))).alias("valid_accuracy"),
        elapsed(F.coalesce(F.sum(F.when(train, F.col(seconds))), F.lit(0.0))).alias("train_time"),
        elapsed(F.coalesce(F.sum(F.when(valid, F.col(seconds))), F.lit(0.0))).alias("valid_time"),
    )


def rows_to_series(log: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """Row records to one series per key, in long form ``(key, <order>, value)``.

    Absent values are left out, as a key missing from a record would be.  The long
    form keeps a series of any length distributed.
    """
    # marked names let the order column be a series as well
    typed = log.select(order, *[F.col(k).cast("double").alias(f"={k}") for k in keys])
    long = typed.unpivot([order], [f"`={k}`" for k in keys], "key", "value")
    return long.where(F.col("value").isNotNull()).select(F.ltrim(F.col("key"), F.lit("=")).alias("key"), order, "value")


def epoch_series(log: DataFrame, metric: str, order: str = "epoch") -> DataFrame:
    """One metric over the epochs, in order."""
    return log.select(order, F.col(metric).alias(metric)).orderBy(order)


def best_so_far(
    stats: DataFrame, loss: str = "valid_loss", order: str = "epoch", run: str | Sequence[str] = (),
    start: float = START_SCORE, out: str = "saved", bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Flag each row whose loss is strictly below every earlier one of its run, and below ``start``."""
    past = earlier_minimum(stats, order, loss, "__past", run, bucket_rows=bucket_rows)
    # least() skips the NULL that the first row of a run has
    better = F.col(loss) < F.least(F.lit(start), F.col("__past"))
    return past.withColumn(out, F.coalesce(better, F.lit(False))).drop("__past")


def select_checkpoint(
    flagged: DataFrame, order: str = "epoch", run: str | Sequence[str] = (), saved: str = "saved"
) -> DataFrame:
    """The row of the last save in each run: the model that is kept."""
    runs = as_list(run)
    rest = [c for c in flagged.columns if c not in (*runs, saved)]
    kept = flagged.where(F.col(saved)).groupBy(*runs).agg(F.max_by(F.struct(*rest), order).alias("__row"))
    return kept.where(F.col("__row").isNotNull()).select(*runs, "__row.*")
