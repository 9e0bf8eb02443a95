"""Text and id-array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the special tokens and the segment marker.
BOS_ID, PAD_ID, EOS_ID, UNK_ID = 0, 1, 2, 3
FIRST_TOKEN_ID = 4
SEPARATOR = " [SEP] "


def tokens(text: Column) -> Column:
    """Lower-cased tokens between runs of white space; NULL text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")


def first_tokens(text: Column, limit: int) -> Column:
    """The first ``limit`` of ``tokens(text)``, without splitting what comes after them.

    One piece more for an empty one in front of leading white space, and one for the rest.
    """
    pieces = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+", limit + 2)
    return F.slice(F.array_remove(pieces, ""), 1, limit)


def joined_pair(context: Column, target: Column) -> Column:
    """``context [SEP] target``; a missing side counts as the empty text."""
    return F.concat(F.coalesce(context, F.lit("")), F.lit(SEPARATOR), F.coalesce(target, F.lit("")))


def truncated_lengths(first: Column, second: Column, budget: int) -> tuple[Column, Column]:
    """Lengths kept of two segments when the longer one gives way token by token.

    Closed form of "drop from the longer segment until both fit": the second keeps
    what the first leaves over, but never has to fall below half of the budget.
    """
    spare = F.greatest(F.lit(budget) - first, F.lit(budget // 2))
    second_cut = F.least(second, spare)
    fits = first + second <= budget
    return (
        F.when(fits, first).otherwise(F.lit(budget) - second_cut).cast("int"),
        F.when(fits, second).otherwise(second_cut).cast("int"),
    )


def padded(ids: Column, length: Column | int) -> Column:
    """The ids followed by pad ids up to ``length``."""
    gap = F.greatest(_as_col(length) - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID), gap.cast("int")))


def attention(ids: Column, length: Column | int) -> Column:
    """1 for each id of the unpadded array, 0 for each pad position."""
    gap = F.greatest(_as_col(length) - F.size(ids), F.lit(0))
    return F.concat(F.array_repeat(F.lit(1), F.size(ids)), F.array_repeat(F.lit(0), gap.cast("int")))


def _as_col(length: Column | int) -> Column:
    return F.lit(length) if isinstance(length, int) else length


def elapsed(seconds: Column) -> Column:
    """``h:mm:ss`` of seconds rounded half to even, days in front from 24 hours on."""
    s = F.bround(seconds.cast("double")).cast("bigint")
    days = F.floor(s / 86400)
    rest = s - days * 86400
    clock = F.format_string(
        "%d:%02d:%02d",
        F.floor(rest / 3600),
        F.floor((rest % 3600) / 60),
        rest % 60,
    )
    # one day either side of zero is singular, as in the usual text form of a duration
    unit = F.when(F.abs(days) == 1, " day, ").otherwise(" days, ")
    return F.when(days == 0, clock).otherwise(F.concat(days.cast("string"), unit, clock))
