"""A training log as it arrives: which steps to save, and the statistics of the epochs so far."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duotext.functions.hashing import as_list
from duotext.operators.training_log import START_SCORE, epoch_stats
from duotext.sources import versions


def best_so_far_stream(
    steps: DataFrame, loss: str = "valid_loss", order: str | Sequence[str] = "epoch", run: str | Sequence[str] = "run",
    start: float = START_SCORE, out: str = "saved",
) -> DataFrame:
    """``best_so_far`` of a stream: flag each row whose loss is strictly below every earlier one of its run, and below ``start``.

    The state of a run is its least loss, one number, however long the log is.  A micro-batch
    brings the rows of a run into one task and their order; its size is that of the source's trigger
    (``maxFilesPerTrigger``).  A row that arrives after a later one is judged against all that arrived before it.  A NULL
    or NaN loss is never saved.  For a finite table this is ``best_so_far`` over the given order.
    """
    orders, runs = as_list(order), as_list(run)
    fields = [f for f in steps.schema.fields if f.name != out]
    columns = [f.name for f in fields]

    def judge(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (least,) = state.get if state.exists else (float("inf"),)
        rows = pd.concat(list(parts)).sort_values(orders, kind="stable")
        losses = pd.to_numeric(rows[loss]).to_numpy(np.float64, na_value=np.nan)
        known = np.where(np.isnan(losses), np.inf, losses)
        least_by = np.minimum.accumulate(np.concatenate([[least], known]))
        state.update((float(least_by[-1]),))
        yield rows.assign(**{out: known < np.minimum(least_by[:-1], start)})[[*columns, out]]

    schema = T.StructType([*fields, T.StructField(out, T.BooleanType())])
    return steps.groupBy(*runs).applyInPandasWithState(
        judge, schema, T.StructType([T.StructField("least", T.DoubleType())]), "append", GroupStateTimeout.NoTimeout
    )


def write_flags(flagged: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Start writing flagged rows to a table, each once; started again with the same checkpoint it goes on where it ended."""
    return flagged.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start(path)


def write_epoch_stats(steps: DataFrame, path: str, checkpoint: str, by: str | Sequence[str] = "epoch", **trigger: object) -> StreamingQuery:
    """Start keeping ``epoch_stats`` of all that has arrived as the newest version of the table at ``path`` (see ``versions``).

    The sums per epoch are the state of a streaming aggregation; every micro-batch publishes a whole table by one
    rename, so that readers never see half of one and a batch that is repeated changes nothing.
    """
    stats = epoch_stats(steps, by)

    def publish(table: DataFrame, batch: int) -> None:
        versions.publish(table, path, recipe={"batch": batch})

    writer = stats.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(publish).trigger(**trigger).start()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
