"""Mixing sources to target weights by hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duotext.llm.texts import stored, words

#: Bits of the hash that one histogram resolves, and how many histograms there are (60 bits).
DIGIT_BITS, DIGITS = 12, 5
#: Up to so many sources, their records are broadcast.
SOURCES = 10_000


def place(seed: int = 0) -> Column:
    """Where a row stands in its source: 60 bits of md5 over the seed and the id, or the text where the id is NULL."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 15), 16, 10).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size) and ``target`` DOUBLE.

    Sources by code point, NULL last, take the weights in turn and share ``share`` times the
    total size; none gets over ``most`` times its size, and what is cut off is shared again
    by weight.  Filling up all sources at once stops them in ascending order of capacity by
    weight, so the common level follows from running sums: it is the highest of those that the
    source at which they end can take.  One row per source is ranked.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    room = sources.select("source", "source_size", turn.alias("weight")).withColumn("most", most * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    full = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    room = room.withColumn("total", share * F.sum("source_size").over(everything))
    room = room.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(full), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(everything)
    return room.withColumn("level", level).select(
        "source", "source_size", F.least("most", F.coalesce(F.col("level") * F.col("weight"), F.col("most"))).alias("target")
    )


def _digit(n: int) -> Column:
    return F.shiftright("place", DIGIT_BITS * (DIGITS - 1 - n)).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))


def _at_source(rows: DataFrame, edge: DataFrame) -> DataFrame:
    """Rows with the columns of their source's record; broadcast if there are at most ``SOURCES`` records."""
    named = edge.withColumnRenamed("source", "source_")
    small = edge.limit(SOURCES + 1).count() <= SOURCES
    return rows.join(F.broadcast(named) if small else named, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def thresholds(sized: DataFrame, weights: Sequence[float], share: float, most: int) -> DataFrame:
    """(source, source_size, target, times, prefix) of a table of (source, size, place).

    Each document of a source is taken ``times`` times, and once more if its place is below
    ``prefix``.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    edge = stored(
        targets(sums, weights, share, most).withColumn("times", F.least(times, F.lit(most)).cast("bigint"))
        .withColumn("left", F.col("target") - F.col("times") * F.col("source_size"))
        .withColumn("below", F.lit(0).cast("bigint")).withColumn("prefix", F.lit(0).cast("bigint"))
    )
    bucket = Window.partitionBy("source").orderBy("digit")
    for n in range(DIGITS):
        # hashes that begin below ``prefix`` are taken, and their size is ``below``; now the bucket ``prefix`` is resolved
        inside = _at_source(sized, edge.select("source", "left", "below", "prefix")).where(
            F.shiftright("place", DIGIT_BITS * (DIGITS - n)) == F.col("prefix")
        )
        sums = inside.groupBy("source", "left", "below", _digit(n).alias("digit")).agg(F.sum("size").alias("size"))
        # the boundary bucket: the first after which the remainder is reached
        cut = sums.withColumn("upto", F.col("below") + F.sum("size").over(bucket)).where("upto >= left").groupBy("source").agg(
            F.min_by(F.struct("digit", (F.col("upto") - F.col("size")).alias("below"), "upto"), "digit").alias("cut")
        ).withColumnRenamed("source", "source_")
        step = F.col("cut.digit")
        if n == DIGITS - 1:  # a bucket is one hash: it is taken if that comes nearer to the target
            step += (F.col("cut.below") + F.col("cut.upto") < 2 * F.col("left")).cast("int")
        edge = stored(
            edge.join(cut, F.col("source").eqNullSafe(F.col("source_")), "left").select(
                "source", "source_size", "target", "times", "left", F.coalesce("cut.below", "below").alias("below"),
                (F.shiftleft("prefix", DIGIT_BITS) + F.coalesce(step, F.lit(0))).alias("prefix"),
            )
        )
    return edge.select("source", "source_size", "target", "times", "prefix")


def _sized(docs: DataFrame, seed: int, size: Column | None) -> DataFrame:
    size = F.size(words(F.col("text"))).cast("bigint") if size is None else size
    return stored(docs.select("doc_id", "source", size.alias("size"), place(seed).alias("place")))


def _copies() -> Column:
    return F.col("times") + (F.col("place") < F.col("prefix")).cast("bigint")


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0,
    size: Column | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row per document.

    Every document of a source is taken as often as its target holds the whole source; for
    the remainder, documents are taken once more in the order of their hash as long as that
    brings the source nearer to its target.  The thresholds are found by histograms: sums by
    source and the first 12 bits of the hash, then by the next 12 bits within the one bucket in
    which the remainder ends, and so on.  Equal hashes (repeated ids) go together.  Nothing
    depends on partitioning, so reruns agree.

    ``size`` defaults to the number of words, 0 for NULL.  Sources without words have target 0.
    Nothing is sorted.  Histograms are combined map-side; each step meets the narrow table of
    sizes with one record per source, broadcast up to ``SOURCES`` of them.
    """
    sized = _sized(docs, seed, size)
    edge = thresholds(sized, weights, share, most)
    return _at_source(sized, edge).select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def sample(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``: each row as often as ``mix`` takes it.

    Documents without words weigh nothing and are taken by the same rule.  Texts of any length are
    only counted and handed on.  The user's columns travel in a struct, whatever they are called.
    """
    edge = thresholds(_sized(docs, seed, None), weights, share, most)
    copies = F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    rows = docs.select("source", place(seed).alias("place"), F.struct("*").alias("row"))
    found = _at_source(rows, edge).withColumn("copies", _copies())
    return found.where("copies > 0").withColumn("copy", F.explode(copies)).select("row.*")
