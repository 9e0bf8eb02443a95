"""Readers of labelled-pair files.  Schemas are fixed; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotext.schema import PAIR_SCHEMA, STANCE_SCHEMA, TIER_SPLITS
from duotext.sources.csv_records import read_records


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = PAIR_SCHEMA) -> DataFrame:
    """One JSON object per line; a malformed line fails the query."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    # fields may hold quotes, doubled inside quotes, and (multi_line) line breaks; either way large files are
    # read by many tasks; without multi_line by the plain reader, for which a row broken by a line break fails the query
    if multi_line:
        return read_records(spark, path, schema)
    return (
        spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
        .option("mode", "FAILFAST").option("enforceSchema", False)  # header must match
        .csv(path)
    )


def read_annotated_csv(
    spark: SparkSession, path: str, columns: Sequence[str], usecols: Sequence[str],
    renames: Mapping[str, str] | None = None, multi_line: bool = True,
) -> DataFrame:
    """Some columns of a CSV file with a header, renamed.

    ``multi_line=False`` scans files once instead of twice; no field may hold a line break then.

    ``columns`` are all columns of the file in order, ``usecols`` those to keep;
    the others are not parsed.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return _csv(spark, path, schema, multi_line).select(*usecols).withColumnsRenamed(dict(renames or {}))


def read_csv_splits(
    spark: SparkSession, files: Mapping[str, str], schema: T.StructType = STANCE_SCHEMA, multi_line: bool = True
) -> DataFrame:
    """One CSV file per split into one table with a ``split`` column."""
    parts = [_csv(spark, path, schema, multi_line).withColumn("split", F.lit(split)) for split, path in files.items()]
    return reduce(DataFrame.unionByName, parts)


def read_tiered(
    spark: SparkSession, root: str, pairs: Iterable[tuple[str, str]] = TIER_SPLITS, file_type: str = "jsonl",
    schema: T.StructType = PAIR_SCHEMA, multi_line: bool = True,
) -> DataFrame:
    """``<root>/<tier>/<split>.<type>`` files as one table with ``tier`` and ``split``.

    The two are literals per file, so a filter on them leaves whole files unread.
    """
    if file_type not in ("jsonl", "csv"):
        raise ValueError("file_type must be 'jsonl' or 'csv'")
    def read(path: str) -> DataFrame:
        return read_jsonl(spark, path, schema) if file_type == "jsonl" else _csv(spark, path, schema, multi_line)

    parts = [
        read(f"{root}/{tier}/{split}.{file_type}")
        .withColumn("tier", F.lit(tier)).withColumn("split", F.lit(split))
        for tier, split in pairs
    ]
    return reduce(DataFrame.unionByName, parts)
