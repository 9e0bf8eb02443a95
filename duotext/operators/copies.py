"""Writing out counted copies of rows without handing one task a hot row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COPIES_PER_TASK = 100_000  # copies of one row that a single task emits at a stretch


def spread_copies(df: DataFrame, count: str, out: str, may_be_hot: bool = True) -> DataFrame:
    """Repeat each row ``count`` times, numbered 0.. in ``out``.

    Rows with very many copies are first cut into chunks and dealt to all tasks;
    the others, which are nearly all, are written where they are.  ``may_be_hot=False``
    skips that for counts known to be moderate.
    """
    zero = F.lit(0).cast("bigint")
    plain = df.where(F.col(count) > 0)
    kept = [c for c in df.columns if c != count]
    if not may_be_hot:
        return plain.select(*kept, F.explode(F.sequence(zero, F.col(count) - 1)).alias(out))
    few = plain.where(F.col(count) <= COPIES_PER_TASK).select(
        *kept, F.explode(F.sequence(zero, F.col(count) - 1)).alias(out)
    )
    first = F.col("__chunk") * COPIES_PER_TASK
    last = F.least(first + COPIES_PER_TASK, F.col(count)) - 1
    many = (
        plain.where(F.col(count) > COPIES_PER_TASK)
        .withColumn("__chunk", F.explode(F.sequence(zero, F.floor((F.col(count) - 1) / COPIES_PER_TASK))))
        .repartition(*kept, "__chunk")
        .select(*kept, F.explode(F.sequence(first, last)).alias(out))
    )
    return few.unionByName(many)
