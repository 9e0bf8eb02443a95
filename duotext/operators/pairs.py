"""Row-wise operators, filters, key joins and unions on labelled-pair tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duotext.functions import labels, scores, text
from duotext.functions.hashing import as_list
from duotext.operators.copies import spread_copies

TURNS_PER_CHUNK = 1_024  # turns of one thread that a window sorts together


# -- projections -----------------------------------------------------------------

def pair_text(df: DataFrame, context: str = "context", target: str = "target", out: str = "text") -> DataFrame:
    """Replace the two sides by one text, ``context [SEP] target``."""
    return df.withColumn(out, text.joined_pair(F.col(context), F.col(target))).transform(
        drop_columns, [c for c in (context, target) if c != out]
    )


def drop_columns(df: DataFrame, columns: str | Sequence[str] = ("context", "target")) -> DataFrame:
    """Drop columns that later steps do not need."""
    return df.drop(*as_list(columns))


def label_to_int(df: DataFrame, label: str = "label") -> DataFrame:
    """Digit text to INT; anything else fails the query."""
    return df.withColumn(label, labels.label_int(F.col(label)))


def binarize_01(df: DataFrame, label: str = "label") -> DataFrame:
    """{0, 1} -> 0, other classes -> 1."""
    return df.withColumn(label, labels.binarize(F.col(label)))


def merge_neutral(df: DataFrame, label: str = "label") -> DataFrame:
    """1 -> 0, other classes unchanged: the result codes are {0, 2}."""
    return df.withColumn(label, labels.neutral_to_zero(F.col(label)))


def letter_label(df: DataFrame, annotation: str = "label", out: str = "label") -> DataFrame:
    """Annotation letters to classes: h, n -> 0, others -> 1."""
    return df.withColumn(out, labels.letter_to_int(F.col(annotation)))


def select_model_columns(
    df: DataFrame, columns: Sequence[str] = ("input_ids", "attention_mask", "label")
) -> DataFrame:
    """Keep only what a learner reads; the rest is pruned at the scan."""
    return df.select(*columns)


# -- filters ---------------------------------------------------------------------

def silver_minority_only(df: DataFrame, tier: str = "tier", label: str = "label", minority: str = "2") -> DataFrame:
    """All gold rows, and of the silver rows only the minority class."""
    return df.where((F.col(tier) == "gold") | (F.col(label) == minority))


def label_isin(df: DataFrame, values: Sequence = ("h", "n", "c"), label: str = "label") -> DataFrame:
    """Rows whose label is one of ``values``; unlabelled rows go too."""
    return df.where(F.col(label).isin(*values))


def class_partition(df: DataFrame, cls: int, label: str = "label") -> DataFrame:
    """Rows of one class."""
    return df.where(F.col(label) == cls)


def confident_rows(df: DataFrame, threshold: float = 0.8, probs: str = "probs") -> DataFrame:
    """Rows whose largest probability is strictly above the threshold."""
    return df.where(scores.confidence(F.col(probs)) > threshold)


# -- key joins -------------------------------------------------------------------

def attach_predictions(df: DataFrame, predictions: DataFrame, key: str | Sequence[str] = "row_id") -> DataFrame:
    """Add the prediction columns to the rows they belong to (unique keys on both sides)."""
    return df.join(predictions, as_list(key), "inner")


def take_indices(df: DataFrame, wanted: DataFrame, key: str | Sequence[str] = "row_id") -> DataFrame:
    """Rows whose key is listed."""
    return df.join(wanted.select(*as_list(key)), as_list(key), "left_semi")


def remaining_rows(df: DataFrame, taken: DataFrame, key: str | Sequence[str] = "row_id") -> DataFrame:
    """Rows whose key is not listed."""
    return df.join(taken.select(*as_list(key)), as_list(key), "left_anti")


def consecutive_pairs(
    turns: DataFrame, thread: str = "conv_id", turn: str = "turn", body: str = "text"
) -> DataFrame:
    """Each message with the one before it, as ``(thread, turn, context, target)``.

    Threads are cut into chunks of turns, and the last turn of a chunk visits the
    next one too, so a thread of any length spreads over all tasks and each text is
    shuffled once (a self-join would move it twice).  (thread, turn) is unique; a
    turn whose predecessor is missing gives no pair.
    """
    home = F.floor(F.col(turn) / TURNS_PER_CHUNK)
    is_last = F.pmod(F.col(turn), F.lit(TURNS_PER_CHUNK)) == TURNS_PER_CHUNK - 1
    chunks = F.when(is_last, F.array(home, home + 1)).otherwise(F.array(home))
    spread = turns.select(thread, turn, body, F.explode(chunks).alias("__chunk"))
    order = Window.partitionBy(thread, "__chunk").orderBy(turn)
    return (
        spread.withColumn("__before", F.lag(turn).over(order))
        .withColumn("context", F.lag(body).over(order))
        .where((F.col("__before") == F.col(turn) - 1) & (F.col("__chunk") == home))
        .select(thread, turn, "context", F.col(body).alias("target"))
    )


# -- unions ----------------------------------------------------------------------

def union_tiers(gold: DataFrame, silver: DataFrame) -> DataFrame:
    """Gold and silver rows, duplicates kept; ``tier`` is added where it is missing."""
    def marked(df: DataFrame, tier: str) -> DataFrame:
        return df if "tier" in df.columns else df.withColumn("tier", F.lit(tier))

    return marked(gold, "gold").unionByName(marked(silver, "silver"))


def append_pseudo_labels(train: DataFrame, pseudo: DataFrame) -> DataFrame:
    """Training rows and pseudo-labelled rows, told apart by ``origin``."""
    def marked(df: DataFrame, origin: str) -> DataFrame:
        return df if "origin" in df.columns else df.withColumn("origin", F.lit(origin))

    return marked(train, "train").unionByName(marked(pseudo, "pseudo").select(*marked(train, "train").columns))


# -- identity --------------------------------------------------------------------

def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """A stable row key for tables that have none: content hash and copy number.

    Equal rows are counted (combined on the map side, so a row copied a billion
    times is one record per task in the shuffle) and written out again, numbered.  The few
    rows with very many copies are spread over tasks in chunks.
    """
    # flag and length in front of each text, so that no two contents read the same
    def part(c: str) -> Column:
        text = F.col(c).cast("string")
        return F.when(text.isNull(), "0").otherwise(F.concat(F.lit("1:"), F.length(text).cast("string"), F.lit(":"), text))

    digest = F.md5(F.concat(*[part(c) for c in df.columns]))
    # hashed once per distinct row, before the copies are written out
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__digest", digest)
    return spread_copies(counted, "__n", "__copy").select(
        F.concat("__digest", F.lit("-"), F.col("__copy").cast("string")).alias(out), *df.columns
    )
