"""Stored tables: written once, read many times, one partition per recipe."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duotext.runtime import path_exists
from duotext.sources.versions import newest_of_each

RECIPE_COLUMNS = ["tier", "split", "num_label", "upsampled", "null_ratio"]


def write_artifact(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Store a table; an existing one is kept (and the call fails) unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored table."""
    return spark.read.parquet(path)


def materialize_if_absent(
    spark: SparkSession, path: str, compute: Callable[[], DataFrame], overwrite: bool = False
) -> DataFrame:
    """The stored table if it is complete, else compute, store and re-read it.

    Reading back also cuts the lineage.  A table without its ``_SUCCESS`` mark is
    the rest of a failed write and is replaced.  (``versions.materialize`` also knows when its inputs change.)
    """
    if overwrite or not path_exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_recipe(
    df: DataFrame, root: str, tier: str, split: str, num_label: int = 2, upsampled: bool = False,
    null_ratio: float = 0.0,
) -> None:
    """Store the table of one recipe; other recipes under ``root`` stay as they are."""
    values = dict(zip(RECIPE_COLUMNS, [tier, split, num_label, upsampled, float(null_ratio)], strict=True))
    marked = df.withColumns({c: F.lit(v) for c, v in values.items()})
    (
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RECIPE_COLUMNS).parquet(root)
    )


def read_recipe(spark: SparkSession, root: str, **recipe: object) -> DataFrame:
    """The tables of the recipes that match; partitions of other recipes are not read."""
    unknown = set(recipe) - set(RECIPE_COLUMNS)
    if unknown:
        raise ValueError(f"unknown recipe columns: {sorted(unknown)}")
    # of tables stored in versions, the newest of each recipe
    paths = newest_of_each(spark, root, len(RECIPE_COLUMNS)) or [root]
    # partition values keep their types: a tier called 1 stays a text
    stored = spark.read.option("basePath", root).parquet(*paths)
    kinds = {
        "tier": "string", "split": "string", "num_label": "int", "upsampled": "boolean", "null_ratio": "double", "version": "string",
    }
    schema = T.StructType([T.StructField(f.name, T._parse_datatype_string(kinds[f.name]) if f.name in kinds else f.dataType) for f in stored.schema])
    df = spark.read.schema(schema).option("basePath", root).parquet(*paths).drop("version")
    for column, value in recipe.items():
        df = df.where(F.col(column) == F.lit(value))
    return df
