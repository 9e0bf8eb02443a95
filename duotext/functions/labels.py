"""Label recoding as Column expressions (all inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_int(label: Column) -> Column:
    """Strict cast of a label text; a text that is no integer fails the query (ANSI mode)."""
    return label.cast("int")


def binarize(label: Column) -> Column:
    """{0, 1} -> 0 and every other class -> 1.  NULL stays NULL."""
    n = label_int(label)
    return F.when(n.isin(0, 1), 0).when(n.isNotNull(), 1)


def neutral_to_zero(label: Column) -> Column:
    """1 -> 0, other classes unchanged, so three classes become the codes {0, 2}."""
    n = label_int(label)
    return F.when(n == 1, 0).otherwise(n)


def letter_to_int(annotation: Column) -> Column:
    """h and n -> 0, any other letter -> 1.  NULL stays NULL."""
    return F.when(annotation.isin("h", "n"), 0).when(annotation.isNotNull(), 1)
