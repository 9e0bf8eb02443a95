"""Fixed schemas of the labelled-pair tables."""

from __future__ import annotations

from pyspark.sql import types as T

PAIR_SCHEMA = T.StructType([
    T.StructField("context", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("label", T.StringType()),
])

STANCE_SCHEMA = T.StructType([
    T.StructField("all_text", T.StringType()),
    T.StructField("label", T.IntegerType()),
])

# The tier/split files of a corpus; only the gold tier has a test split.
TIER_SPLITS = [("gold", "train"), ("gold", "val"), ("gold", "test"), ("silver", "train"), ("silver", "val")]

# Vector width and text length of the encoded tables.
VECTOR_SIZE = 768
MAX_LENGTH = 512
