"""Document fingerprints: threshold-scaled sketches of word shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duotext.llm.texts import leading, let, words

SHINGLE, SCALE = 5, 4
#: Buckets per shuffle partition when documents are brought next to their neighbours.
_BUCKETS = 4
_LOWEST = -(1 << 63)


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct hashes of the text's word shingles that lie in the lowest 1/``scale`` of all hashes.

    The fraction is the same for every text, so a sketch grows with its text, and sketches of texts of
    any length are comparable and mergeable; a short text may retain no hash.  Fewer words than a shingle
    has: their sequence is the one shingle.  NULL and empty texts have the hash of no word.
    """
    limit = _LOWEST + (1 << 64) // scale

    def lowest(w: Column) -> Column:
        count = F.greatest(F.size(w) - (shingle - 1), F.lit(1))
        hashes = F.transform(F.sequence(F.lit(1), count), lambda i: F.xxhash64(F.slice(w, i, shingle)))
        return F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))

    return let(words(text), lowest)


def merged(left: Column, right: Column) -> Column:
    """The sketch of two texts' shingles together, from their sketches alone."""
    return F.array_sort(F.array_union(left, right))


def containment(left: Column, right: Column) -> Column:
    """The greater of the two shares of one text's shingles that the other has, 0 to 1, from sketches of one scale.

    0 if one of them retained no hash.
    """
    least = F.least(F.size(left), F.size(right))
    return F.when(least == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / least)


def shown(s: Column) -> Column:
    """A sketch as text: 16 lowercase hex digits per hash."""
    return F.lower(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def edited(text: Column, other: Column) -> Column:
    """``text`` with its last half (rounded down) replaced by as many first code points of ``other``, or all it has."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """``docs`` with ``next``, a struct of ``columns`` of the row that follows by descending doc_id, after the last the first.

    Ids are cut into ranges by quantiles; as each cut is an id that occurs, the row after a
    range's last is that with the next cut's id, and a copy of it goes along with the range.
    So one shuffle moves each row once, whatever the number of rows.  Rows with equal ids
    follow each other by their columns; NULL ids come last.
    """
    spark = docs.sparkSession
    if buckets is None:
        buckets = _BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets + 1)])
    found = docs.agg(F.percentile_approx("doc_id", shares, 100 * buckets).alias("cuts"), F.max("doc_id").alias("top")).first()
    tops = sorted({*(found["cuts"] or []), found["top"]} - {None}, reverse=True)  # the highest id of each range
    n = max(1, len(tops))
    ends = F.array(*[F.lit(t) for t in reversed(tops)]).cast("array<bigint>")
    # the range of an id is that of the lowest top not below it
    below = leading(n, lambda i: F.get(ends, i) < F.col("doc_id"))
    own = F.when(F.col("doc_id").isNull() | F.lit(not tops), n - 1).otherwise(n - 1 - below)
    first = F.coalesce(F.array_contains(ends, F.col("doc_id")), F.lit(False)) & F.lit(n > 1)
    home = F.struct(own.alias("range"), F.lit(False).alias("guest"))
    guest = F.struct(F.pmod(own - 1, F.lit(n)).alias("range"), F.lit(True).alias("guest"))
    placed = docs.withColumn("__at", F.explode(F.when(first, F.array(home, guest)).otherwise(F.array(home))))
    order = [F.col("__at.guest"), F.col("doc_id").desc_nulls_last(), *columns]
    ranges = Window.partitionBy("__at.range").orderBy(*order)
    row = F.struct(*columns)
    following = F.coalesce(F.lead(row).over(ranges), F.first(row).over(ranges))
    return placed.withColumn("next", following).where(~F.col("__at.guest")).drop("__at")


def fingerprint(docs: DataFrame, shingle: int = SHINGLE, scale: int = SCALE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row per document.

    ``near_*`` is the estimated containment, by sketch, of the document and its edited text
    or the next document.  Equal texts have equal fingerprints and are 1 near, however short; different
    texts of which one retains no hash are 0 near.  Texts are shuffled alone: sketches are made
    where a text has met its next one.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    paired = with_next(base, ["text"]).select("doc_id", "text", F.col("next.text").alias("following")).withColumn("edited", edited(F.col("text"), F.col("following")))
    sketched = paired.select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        (F.col("text") == F.col("edited")).alias("same"), (F.col("text") == F.col("following")).alias("same_next"),
        *[sketch(F.col(c), shingle, scale).alias(c) for c in ("text", "edited", "following")],
    )

    def near(other: str, same: str) -> Column:
        return F.when(F.col(same), 1.0).otherwise(containment(F.col("text"), F.col(other)))

    return sketched.select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("text")).alias("fingerprint"), shown(F.col("edited")).alias("edited_fingerprint"),
        near("edited", "same").alias("near_edited"), near("following", "same_next").alias("near_next"),
    )
