"""CSV files with line breaks inside quotes, read by many tasks per file.

Whether a line begins a record depends on the number of quotes before it in the file.  So each
byte range of a file first counts its quotes; a prefix scan over the ranges tells which of them begin inside a
quoted field; then every range cuts its own lines into records.  Only records that cross a border of ranges are
put together in a shuffle.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotext.runtime import cut_lineage

#: Up to so many ranges, what is known of them is broadcast.
RANGES = 100_000
_OPTIONS = {"quote": '"', "escape": '"', "mode": "FAILFAST"}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines with their file and the start of the range that read them, in order within a range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch, np.ndarray]]:
    """((file, start), rows, quotes per line) of each range that a batch holds lines of."""
    if not len(batch):
        return
    files = batch.column("file").dictionary_encode()
    number, start = files.indices.to_numpy(), batch.column("start").to_numpy()
    borders = [0, *(np.flatnonzero((np.diff(number) != 0) | (np.diff(start) != 0)) + 1).tolist(), len(batch)]
    quotes = pc.count_substring(batch.column("line"), '"').fill_null(0).to_numpy(zero_copy_only=False)
    for a, b in zip(borders, borders[1:], strict=False):
        yield (files.dictionary[int(number[a])].as_py(), int(start[a])), batch.slice(a, b - a), quotes[a:b]


def ranges(lines: DataFrame) -> DataFrame:
    """(file, start, open, began): does the range begin inside a quoted field, and in which range did that record begin?

    ``open`` is the parity of all quotes in the file before the range.  Ranges of a file are few (bytes / range size).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, odd, outside, inside = None, 0, 0, 0
        names = ["file", "start", "odd", "outside", "inside"]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, odd, outside, inside)], names)

        for batch in batches:
            for found, _, quotes in _runs(batch):
                if found != key:
                    if key:
                        yield row()
                    key, odd, outside, inside = found, 0, 0, 0
                before = (odd + np.cumsum(quotes) - quotes) & 1
                inside += int(before.sum())
                outside += int((1 - before).sum())
                odd ^= int(quotes.sum()) & 1
        if key:
            yield row()

    counted = lines.mapInArrow(count, "file string, start bigint, odd bigint, outside bigint, inside bigint")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = cut_lineage(counted, "csv-ranges").withColumn("open", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    # lines that begin a record, given how the range begins
    begins = F.when(F.col("open") == 0, F.col("outside")).otherwise(F.col("inside")) > 0
    began = F.last(F.when(begins, F.col("start")), ignorenulls=True).over(before)
    closed = (F.sum("odd").over(Window.partitionBy("file")) % 2) == 0
    fails = F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("file")))
    return known.select("file", "start", F.when(closed, F.col("open").cast("int")).otherwise(fails).alias("open"), began.alias("began"))


def _cut(lines: DataFrame, names: list[str], pieces: bool) -> DataFrame:
    """(record, file, began, start): whole records of each range, or else the pieces of those that cross a border.

    Lines come with the ``open`` and ``began`` of their range.  The first record of a file must hold ``names``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.string()), ("file", pa.string()), ("began", pa.int64()), ("start", pa.int64())])
        key, odd, began, waiting, first = None, 0, None, [], False

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(("\n".join(waiting), key[0], began, key[1]), schema.types, strict=True)], schema=schema)

        def records(values: pa.Array) -> pa.RecordBatch:
            none = [pa.nulls(len(values), t) for t in schema.types[1:]]
            return pa.RecordBatch.from_arrays([values, *none], schema=schema)

        def header(record: str) -> None:
            found = next(csv.reader([record.removeprefix("﻿")]), [])
            if [x.strip().lower() for x in found] != [x.lower() for x in names]:
                raise ValueError(f"the header of {key[0]} is {found}, not {names}")

        for batch in batches:
            for found, rows, quotes in _runs(batch):
                if found != key:
                    if waiting and pieces:
                        yield piece()
                    key, waiting, first = found, [], found[1] == 0
                    odd = rows.column("open")[0].as_py()
                    began = rows.column("began")[0].as_py() if odd else key[1]
                line = rows.column("line")
                before = (odd + np.cumsum(quotes) - quotes) & 1
                after = (before + quotes) & 1
                odd = int(after[-1])
                whole = (before == 0) & (after == 0)
                joined, at = [], []
                for i in np.flatnonzero(~whole).tolist():
                    if not before[i]:
                        began = key[1]
                    waiting.append(line[i].as_py())
                    if not after[i]:
                        if began == key[1]:
                            joined.append("\n".join(waiting))
                            at.append(i)
                        elif pieces:
                            yield piece()
                        waiting = []
                if pieces:
                    continue
                if first and (whole[0] or joined):
                    first = False
                    if whole[0]:
                        header(line[0].as_py().rstrip("\r"))
                        whole[0] = False
                    else:
                        header(joined.pop(0).rstrip("\r"))
                        del at[0]
                # in the order of the file
                order = np.argsort(np.concatenate([np.flatnonzero(whole), np.array(at, np.int64)]), kind="stable")
                if len(order):
                    yield records(pa.concat_arrays([line.filter(pa.array(whole)), pa.array(joined, pa.string())]).take(pa.array(order)))
        if waiting and pieces:
            yield piece()

    return lines.select("line", "file", "start", "open", "began").mapInArrow(work, "record string, file string, began bigint, start bigint")


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of CSV files with a header, by all tasks that the size of the files allows.

    Fields may hold separators, line breaks and doubled quotes inside quotes; a field that is not quoted
    holds no quote.  Every file's header must name the columns of ``schema`` in order.  A malformed row, another
    header or a quote that is never closed fails the query.  Empty lines are skipped.

    The lines are scanned once for quotes and once for records, and a third time only if a record crosses a border.
    """
    lines = _lines(spark, path)
    known = cut_lineage(ranges(lines), "csv-borders")
    few = known.count() <= RANGES

    def with_border(rows: DataFrame) -> DataFrame:
        if few:  # the order of lines within a range stays
            return rows.join(F.broadcast(known), ["file", "start"])
        return rows.join(known, ["file", "start"]).sortWithinPartitions("file", "start", "at")

    records = _cut(with_border(lines), schema.names, False).select("record")
    if not known.where("open = 1").isEmpty():
        crossing = _cut(with_border(lines), schema.names, True).groupBy("file", "began").agg(
            # the pieces of one record, one per range
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "record"))), lambda p: p["record"]), "\n").alias("record")
        )
        records = records.unionByName(crossing.select("record"))
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    row = F.from_csv(F.rtrim(F.col("record"), F.lit("\r")), fields, _OPTIONS)
    return records.where(F.col("record").rlike("[^\r]")).select(row.alias("row")).select("row.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
